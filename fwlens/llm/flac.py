"""FLAC streams of 8-bit samples, coded and decoded with numpy: many frames advance together, one sample a step.

Decoding follows the format: frame headers and their CRC-8, constant, verbatim, fixed and linear-prediction subframes,
Rice residuals with partitions and escapes, stereo decorrelation, and each frame's CRC-16. Frames are found through the
seek table; between seek points one frame follows the other, so streams without a table decode too. The decoded samples
come as PCM blocks with the sample at which each begins.

The encoder writes mono streams of 8 bits, a seek point for each frame, and takes for each frame the best of three fixed
predictors, a linear predictor of order eight, constant and verbatim.

``store_texts`` writes the streams of texts to a folder, those of common texts once, in pages compressed with zstd, since
headers and seek tables are much alike; ``digests_of_stored`` and ``stored_media`` read that folder, and ``store_pcm`` decodes streams into a folder of PCM blocks with sample offsets.

Defined results: a null text is the empty text; payloads are padded with blanks to a positive multiple of 192 bytes;
equal texts give equal streams, and which of two copies is stored makes no difference; a stream that is damaged gives ``ok`` = false and as much as could be read, a null one
gives no blocks; repeated rows give a row each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, map_arrow, scratch_path, stored, table

BLOCK, RATE, UNIT = 2048, 8000, 192
FRAMES_AT_ONCE = 1024
# fixed values: the fixed predictors' coefficients by order
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
LPC_ORDER, LPC_BITS = 8, 12
#: texts with copies that are stored once, at the most; so the rows that tell which they are fit into a broadcast
COMMON = 1 << 16
SEEK_POINT = np.dtype([("sample", ">u8"), ("byte", ">u8"), ("n", ">u2")])


@functools.cache
def crc_table(bits: int, polynomial: int, steps: int) -> np.ndarray:
    """For each value of the register its value after so many zero bits."""
    x = np.arange(1 << bits, dtype=np.uint32)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for _ in range(steps):
        x = np.where(x & top, (x << 1) ^ polynomial, x << 1) & mask
    return x.astype(np.uint16)


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-16 of each stretch of bytes, two bytes of all stretches a step."""
    two, one = crc_table(16, 0x8005, 16), crc_table(16, 0x8005, 8)
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    at, pairs = starts[order], sizes[order] // 2
    crc = np.zeros(len(starts), np.uint16)
    words = (data[:-1].astype(np.uint16) << 8) | data[1:]
    active = np.searchsorted(-pairs, -np.arange(1, (pairs[0] if len(pairs) else 0) + 1), side="right")
    for step, m in enumerate(active.tolist()):
        crc[:m] = two[crc[:m] ^ words[at[:m] + 2 * step]]
    odd = sizes[order] % 2 == 1
    last = data[np.minimum(at + 2 * pairs, len(data) - 1)]
    # one byte: the register's upper byte and the data byte together, the lower byte moves up
    crc = np.where(odd, one[(crc ^ (last.astype(np.uint16) << 8))], crc)
    out = np.zeros(len(starts), np.uint16)
    out[order] = crc
    return out


def crc8_columns(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The CRC-8 over the columns of a matrix of bytes that have a width."""
    one, crc = crc_table(8, 0x07, 8), np.zeros(len(values), np.int64)
    for k in range(values.shape[1]):
        crc = np.where(widths[:, k] > 0, one[crc ^ (values[:, k] & 0xFF)], crc)
    return crc


def coded_number(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the header's UTF-8-like code: bytes and widths, six columns."""
    values, widths = np.zeros((len(x), 6), np.int64), np.zeros((len(x), 6), np.int64)
    size = 1 + np.sum([x >= 1 << b for b in (7, 11, 16, 21, 26)], axis=0)
    for n in np.unique(size).tolist():
        mine = size == n
        for k in range(n):
            part = x[mine] >> (6 * (n - 1 - k))
            values[mine, k] = part if n == 1 else (part | (0xFF << (8 - n)) & 0xFF) if k == 0 else (part & 0x3F) | 0x80
            widths[mine, k] = 8
    return values, widths


def levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction coefficients from autocorrelations, for many frames at once."""
    a, error = np.zeros((len(r), order)), r[:, 0].copy()
    for i in range(order):
        acc = r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1) if i else r[:, 1]
        k = np.divide(acc, error, out=np.zeros_like(acc), where=error > 0)
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, error = new, error * (1 - k * k)
    return a


def encode_frames(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of equal size, signed samples by row: (bytes, end of each frame)."""
    count, n = x.shape
    x = x.astype(np.int64)
    # residuals of all predictors, zero in the warm-up
    residuals = [x.copy(), np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)]
    residuals[1][:, 1:] = np.diff(x, axis=1)
    residuals[2][:, 2:] = np.diff(x, 2, axis=1)
    orders = np.array([0, 1, 2, LPC_ORDER])
    f = x.astype(np.float64)
    r = np.stack([(f[:, k:] * f[:, : n - k]).sum(axis=1) for k in range(LPC_ORDER + 1)], axis=1)
    a = levinson(r, LPC_ORDER)
    high = np.abs(a).max(axis=1)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(np.maximum(high, 1e-9)) + 1e-9).astype(np.int64), 0, 15)
    limit = 1 << (LPC_BITS - 1)
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit - 1).astype(np.int64)
    guess = sum(q[:, j, None] * x[:, LPC_ORDER - 1 - j : n - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
    residuals[3][:, LPC_ORDER:] = x[:, LPC_ORDER:] - guess
    best = np.argmin([np.abs(e).sum(axis=1) + 8 * o for e, o in zip(residuals, orders, strict=True)], axis=0)
    res = np.choose(best[:, None], residuals)
    order = orders[best]
    u = np.where(res < 0, -2 * res - 1, 2 * res)
    # Rice parameters by partition
    depth = 2 if n % 4 == 0 and n // 4 > LPC_ORDER else 0
    parts = 1 << depth
    size = n // parts
    live = (np.arange(n) >= order[:, None]).reshape(count, parts, size)
    grouped = np.where(live, u.reshape(count, parts, size), 0)
    numbers_in = live.sum(axis=2)
    costs = np.stack([(grouped >> k).sum(axis=2) + numbers_in * (k + 1) for k in range(15)])
    k = costs.argmin(axis=0)
    bits = costs.min(axis=0).sum(axis=1) + 4 * parts + 6 + 8 * order + np.where(best == 3, 9 + LPC_BITS * LPC_ORDER, 0)
    constant = (x == x[:, :1]).all(axis=1)
    verbatim = ~constant & (bits >= 8 * n)
    coded = ~constant & ~verbatim
    lpc = coded & (best == 3)
    # columns: header | its CRC | subframe header | warm-up | precision, shift, coefficients | method | parameters and residuals
    head, head_w = np.zeros((count, 12), np.int64), np.zeros((count, 12), np.int64)
    head[:, :4] = [0xFF, 0xF8, (((BLOCK // 256).bit_length() + 7) << 4 if n == BLOCK else 0x70) | 0x04, 0x02]
    head_w[:, :4] = 8
    head[:, 4:10], head_w[:, 4:10] = coded_number(numbers)
    if n != BLOCK:
        head[:, 10:], head_w[:, 10:] = [(n - 1) >> 8, (n - 1) & 0xFF], 8
    kind = np.where(constant, 0, np.where(verbatim, 1, np.where(lpc, 32 + order - 1, 8 + order)))
    values, widths = [head, crc8_columns(head, head_w)[:, None], 2 * kind[:, None]], [head_w, np.full((count, 1), 8), np.full((count, 1), 8)]
    warm = np.where(constant, 1, np.where(coded, order, 0))
    values.append(x[:, :LPC_ORDER] & 0xFF)
    widths.append(np.where(np.arange(LPC_ORDER) < warm[:, None], 8, 0))
    values.append(np.concatenate([np.full((count, 1), LPC_BITS - 1), shift[:, None], q & ((1 << LPC_BITS) - 1)], axis=1))
    widths.append(np.where(lpc[:, None], [4, 5, *[LPC_BITS] * LPC_ORDER], 0))
    values.append(np.full((count, 1), depth))
    widths.append(np.where(coded[:, None], 6, 0))
    kk = k[:, :, None]
    body = np.concatenate([kk, (1 << kk) | (grouped & ((1 << kk) - 1))], axis=2).reshape(count, -1)
    body_w = np.concatenate([np.full((count, parts, 1), 4), np.where(live, (grouped >> kk) + 1 + kk, 0)], axis=2).reshape(count, -1)
    body_w[constant] = 0
    if verbatim.any():
        raw, raw_w = np.zeros((verbatim.sum(), body.shape[1]), np.int64), np.zeros((verbatim.sum(), body.shape[1]), np.int64)
        raw[:, :n], raw_w[:, :n] = x[verbatim] & 0xFF, 8
        body[verbatim], body_w[verbatim] = raw, raw_w
    values.append(body)
    widths.append(body_w)
    value, width = np.concatenate(values, axis=1), np.concatenate(widths, axis=1)
    # each frame ends on a byte and leaves two for its CRC-16
    pad = (-width.sum(axis=1) % 8 + 16)[:, None]
    value, width = np.concatenate([value, np.zeros((count, 1), np.int64)], axis=1).ravel(), np.concatenate([width, pad], axis=1).ravel()
    end = np.cumsum(width)
    keep = width > 0
    value, end_k = value[keep].astype(np.uint64), end[keep]
    word = (end_k - 1) >> 5
    spread = value << ((31 - (end_k - 1 & 31)).astype(np.uint64))
    total = int(end[-1] + 31 >> 5)
    low = np.bincount(word, (spread & np.uint64(0xFFFFFFFF)).astype(np.float64), total)
    over = np.bincount(np.maximum(word - 1, 0), (spread >> np.uint64(32)).astype(np.float64), total)
    data = (low + over).astype(np.uint32).astype(">u4").view(np.uint8).copy()
    ends = end.reshape(count, -1)[:, -1] // 8
    starts = np.concatenate([[0], ends[:-1]])
    crc = crc16(data, starts, ends - 2)
    data[ends - 2], data[ends - 1] = crc >> 8, crc & 0xFF
    return data, ends


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, a byte of it a sample (less 128)."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    frames = -(-sizes // BLOCK)
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8)
    owner = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = np.repeat(np.cumsum(sizes) - sizes, frames) + number * BLOCK
    size = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    found: list[bytes] = [b""] * len(owner)
    for n in np.unique(size).tolist():
        mine = np.flatnonzero(size == n)
        for a in range(0, len(mine), FRAMES_AT_ONCE):
            some = mine[a : a + FRAMES_AT_ONCE]
            data, ends = encode_frames(samples[begin[some][:, None] + np.arange(n)], number[some])
            raw, at = data.tobytes(), 0
            for k, e in zip(some.tolist(), ends.tolist(), strict=True):
                found[k], at = raw[at:e], e
    out, at = [], 0
    signed = samples.tobytes()
    offset = 0
    for m, payload in zip(frames.tolist(), payloads, strict=True):
        own = found[at : at + m]
        at += m
        lengths = [len(x) for x in own]
        md5 = hashlib.md5(signed[offset : offset + len(payload)]).digest()
        offset += len(payload)
        info = struct.pack(">HH", BLOCK, BLOCK) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | len(payload)).to_bytes(8, "big") + md5
        points = np.zeros(m, SEEK_POINT)
        points["sample"], points["byte"] = np.arange(m) * BLOCK, np.cumsum(lengths) - lengths
        points["n"] = np.minimum(BLOCK, len(payload) - points["sample"].astype(np.int64))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + points.nbytes.to_bytes(3, "big") + points.tobytes() + b"".join(own))
    return out


@dataclass
class Stream:
    """What the metadata blocks of a stream say."""

    first: int = 0  # byte of the first frame
    block: int = 0
    longest: int = 0
    rate: int = 0
    channels: int = 1
    bits: int = 8
    samples: int = 0
    md5: bytes = b""
    points: np.ndarray = field(default_factory=lambda: np.zeros(0, SEEK_POINT))


def read_metadata(media: bytes) -> Stream | None:
    if media[:4] != b"fLaC":
        return None
    s, at, last = Stream(), 4, False
    while not last:
        if at + 4 > len(media):
            return None
        last, kind, size = bool(media[at] & 0x80), media[at] & 0x7F, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and size == 34:
            s.block, s.longest = int.from_bytes(body[2:4], "big"), int.from_bytes(body[7:10], "big")
            packed = int.from_bytes(body[10:18], "big")
            s.rate, s.channels, s.bits, s.samples = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & ((1 << 36) - 1)
            s.md5 = body[18:34]
        elif kind == 3:
            points = np.frombuffer(body[: len(body) // SEEK_POINT.itemsize * SEEK_POINT.itemsize], SEEK_POINT)
            s.points = points[points["sample"] != 0xFFFFFFFFFFFFFFFF]
    s.first = at
    return s if s.block else None


class Bits:
    """Bytes with fast access to numbers at any bit."""

    def __init__(self, data: np.ndarray):
        self.size = 8 * len(data)
        data = np.concatenate([data, np.zeros(16, np.uint8)])
        wide = data.astype(np.int64)
        self.window = (wide[:-4] << 32) | (wide[1:-3] << 24) | (wide[2:-2] << 16) | (wide[3:-1] << 8) | wide[4:]
        # the next set bit at or after each bit
        bits = np.unpackbits(data).view(bool)
        places = np.where(bits, np.arange(len(bits), dtype=np.int32), np.int32(self.size))
        self.next_one = np.minimum.accumulate(places[::-1])[::-1]

    def get(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        at = np.minimum(at, self.size)
        return (self.window[at >> 3] >> (40 - (at & 7) - width)) & ((np.int64(1) << width) - 1)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        x = self.get(at, width)
        return np.where((width > 0) & (x >> np.maximum(width - 1, 0) == 1), x - (np.int64(1) << width), x)


def decode_subframes(bits: Bits, at: np.ndarray, n: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One subframe for each frame, frames in descending order of size: (samples by time and frame, end bit, well formed)."""
    count, most = len(at), int(n.max())
    kind = bits.get(at, 8)
    good = kind < 128
    wasted = np.zeros(count, np.int64)
    flag = kind & 1 == 1
    at = at + 8
    if flag.any():
        run = bits.next_one[np.minimum(at, bits.size)] - at + 1
        wasted = np.where(flag, run, 0)
        at = at + wasted
    width = np.maximum(width - wasted, 1)
    kind = kind >> 1 & 63
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    good &= constant | verbatim | fixed | lpc
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, np.where(constant, 1, 0)))
    order = np.minimum(order, n)
    top = int(order.max())
    x = np.zeros((most, count), np.int64)
    for k in range(top):
        has = order > k
        x[k] = np.where(has, bits.signed(at, width), 0)
        at = at + np.where(has, width, 0)
    coefficients, shift = np.zeros((max(top, 1), count), np.int64), np.zeros(count, np.int64)
    coefficients[0, constant] = 1
    for k in range(1, 5):
        if (mine := fixed & (order == k)).any():
            coefficients[:k, mine] = np.array(FIXED[k])[:, None]
    if lpc.any():
        precision = bits.get(at, 4) + 1
        shift = np.where(lpc, bits.get(at + 4, 5), 0)
        good &= ~lpc | ((precision < 16) & (shift < 16))
        at = at + np.where(lpc, 9, 0)
        for k in range(top):
            has = lpc & (order > k)
            coefficients[k, has] = bits.signed(at[has], precision[has])
            at = at + np.where(has, precision, 0)
    if verbatim.any():
        for k in np.flatnonzero(verbatim).tolist():
            w = int(width[k])
            x[: n[k], k] = bits.signed(at[k] + w * np.arange(n[k]), np.full(n[k], w))
            at[k] += w * n[k]
    coded = fixed | lpc
    if coded.any():
        method, depth = bits.get(at, 2), bits.get(at + 2, 4)
        good &= ~coded | (method < 2)
        at = at + np.where(coded, 6, 0)
        field_bits, size = np.where(method == 1, 5, 4), np.maximum(n >> depth, 1)
        begins = {*order[coded].tolist()}
        for s in np.unique(size[coded]).tolist():
            begins |= {*range(s, most, s)}
        rice, raw = np.zeros(count, np.int64), np.zeros(count, np.int64)
        escape, all_live, any_escape = np.zeros(count, bool), False, False
        actives = np.searchsorted(-n, -np.arange(most), side="left")
        for t in range(most):
            m = int(actives[t])
            live = coded[:m] if t >= top else coded[:m] & (t >= order[:m])
            if t in begins:
                here = live & ((t == order[:m]) | ((t % size[:m] == 0) & (t > order[:m])))
                p = bits.get(at[:m], field_bits[:m])
                is_raw = here & (p == (1 << field_bits[:m]) - 1)
                rice[:m] = np.where(here, p, rice[:m])
                escape[:m] = np.where(here, is_raw, escape[:m])
                at[:m] += np.where(here, field_bits[:m], 0)
                if is_raw.any():
                    raw[:m] = np.where(is_raw, bits.get(at[:m], 5), raw[:m])
                    at[:m] += np.where(is_raw, 5, 0)
                all_live, any_escape = bool(live.all()), bool(escape.any())
            elif t < top:
                all_live = bool(live.all())
            pos, k = at[:m], rice[:m]
            one = bits.next_one[np.minimum(pos, bits.size)]
            u = ((one - pos) << k) | bits.get(one + 1, k)
            e, after = (u >> 1) ^ -(u & 1), one + 1 + k
            if any_escape:
                esc = escape[:m]
                e, after = np.where(esc, bits.signed(pos, raw[:m]), e), np.where(esc, pos + raw[:m], after)
            if all_live and len(live) == m:
                x[t, :m], at[:m] = e, after
            else:
                x[t, :m], at[:m] = np.where(live, e, x[t, :m]), np.where(live, after, pos)
            # prediction from the samples before
            if t >= top > 0:
                x[t, :m] += (coefficients[:top, :m] * x[t - top : t, :m][::-1]).sum(axis=0) >> shift[:m]
            elif t:
                back = min(t, top)
                guess = (coefficients[:back, :m] * x[t - back : t, :m][::-1]).sum(axis=0) >> shift[:m]
                x[t, :m] += np.where(live, guess, 0)
    if constant.any():
        x[:, constant] = x[0, constant]
    return x << wasted, at, good


@dataclass
class Frame:
    stream: int
    start: int  # byte in the stream
    end: int
    first: int  # sample
    ok: bool
    samples: np.ndarray  # by channel and time


def decode_frames(datas: list[memoryview], streams: list[Stream], owners: list[int], starts: list[int]) -> list[Frame]:
    """The frame at the beginning of each stretch of bytes."""
    lengths = np.array([len(d) for d in datas], np.int64)
    data = np.frombuffer(b"".join(datas), np.uint8)
    base = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    h = padded[base[:, None] + np.arange(18)].astype(np.int64)
    good = (h[:, 0] == 0xFF) & (h[:, 1] & 0xFE == 0xF8) & (lengths > 5)
    code, rate, channel, sample = h[:, 2] >> 4, h[:, 2] & 15, h[:, 3] >> 4, h[:, 3] >> 1 & 7
    # the number's length is the count of leading ones in its first byte
    lead = h[:, 4]
    size = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 0, 2, 3, 4, 5, 6], 7)
    good &= size > 0
    size = np.maximum(size, 1)
    number = np.where(size == 1, lead, lead & (0x7F >> size))
    for k in range(1, 7):
        number = np.where(size > k, (number << 6) | (h[:, 4 + k] & 0x3F), number)
    at, rows = 4 + size, np.arange(len(h))
    n = np.select([code == 1, (code >= 2) & (code <= 5), code == 6, code == 7, code >= 8], [192, 576 << np.maximum(code - 2, 0), h[rows, at] + 1, (h[rows, at] << 8 | h[rows, at + 1]) + 1, 256 << np.maximum(code - 8, 0)], 0)
    good &= n > 0
    at = at + np.select([code == 6, code == 7], [1, 2], 0)
    at = at + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    used = np.where(np.arange(18) < at[:, None], 8, 0)
    good &= crc8_columns(h, used) == h[rows, at]
    depth = np.select([sample == 1, sample == 2, sample == 4, sample == 5, sample == 6], [8, 12, 16, 20, 24], np.array([streams[o].bits for o in owners]))
    channels = np.where(channel < 8, channel + 1, 2)
    good &= channel < 11
    out = [Frame(o, s, s, 0, False, np.zeros((1, 0), np.int64)) for o, s in zip(owners, starts, strict=True)]
    order = np.flatnonzero(good)
    order = order[np.argsort(-n[order], kind="stable")]
    if not len(order):
        return out
    bits = Bits(data)
    at, n, depth, channel, channels = ((base + at + 1) * 8)[order], n[order], depth[order], channel[order], channels[order]
    found, fine = [], np.ones(len(order), bool)
    for c in range(int(channels.max())):
        mine = np.flatnonzero(channels > c)
        side = ((channel[mine] == 8) & (c == 1)) | ((channel[mine] == 9) & (c == 0)) | ((channel[mine] == 10) & (c == 1))
        x, end, ok = decode_subframes(bits, at[mine], n[mine], depth[mine] + side)
        at[mine], fine[mine] = end, fine[mine] & ok
        full = np.zeros((int(n.max()), len(order)), np.int64)
        full[:, mine] = x
        found.append(full)
    if len(found) > 1:
        a, b = found[0].copy(), found[1].copy()
        found[1] = np.where(channel == 8, a - b, b)
        found[0] = np.where(channel == 9, a + b, a)
        mid = (a << 1) | (b & 1)
        found[0], found[1] = np.where(channel == 10, (mid + b) >> 1, found[0]), np.where(channel == 10, (mid - b) >> 1, found[1])
    begins, ends = base[order], (at + 7) // 8
    fine &= ends + 2 <= begins + lengths[order]
    safe = np.clip(ends, begins, len(data))
    fine &= crc16(padded, begins, safe) == (padded[safe].astype(np.uint16) << 8 | padded[safe + 1])
    planes = [np.ascontiguousarray(f.T) for f in found]
    for k, i in enumerate(order.tolist()):
        frame, stream = out[i], streams[owners[i]]
        frame.ok, frame.end = bool(fine[k]), starts[i] + int(safe[k] - begins[k]) + 2
        variable = h[i, 1] & 1
        frame.first = int(number[i]) if variable else int(number[i]) * stream.block
        frame.samples = np.stack([p[k, : n[k]] for p in planes[: channels[k]]])
    return out


def decode_streams(medias: list[bytes | None]) -> list[tuple[Stream | None, list[Frame]]]:
    """All frames of each stream, in order. Decoding of a stretch between seek points stops at the first bad frame."""
    streams = [read_metadata(m) if m else None for m in medias]
    cursors: list[tuple[int, int, int]] = []  # stream, byte, where the next cursor begins
    for k, s in enumerate(streams):
        if s:
            begins = sorted({s.first, *(s.first + s.points["byte"].astype(np.int64)).tolist()})
            begins = [b for b in begins if b < len(medias[k])]
            cursors += zip([k] * len(begins), begins, [*begins[1:], len(medias[k])][: len(begins)], strict=True)
    found: list[list[Frame]] = [[] for _ in medias]
    while cursors:
        some, cursors = cursors[-FRAMES_AT_ONCE:], cursors[:-FRAMES_AT_ONCE]
        datas = []
        for k, at, stop in some:
            longest = streams[k].longest or 64 + streams[k].channels * streams[k].block * (streams[k].bits + 8)
            datas.append(memoryview(medias[k])[at : min(stop, at + longest)])
        for (k, _, stop), frame in zip(some, decode_frames(datas, streams, [c[0] for c in some], [c[1] for c in some]), strict=True):
            found[k].append(frame)
            if frame.ok and frame.end < stop:
                cursors.append((k, frame.end, stop))
    return [(s, sorted(f, key=lambda x: x.start)) for s, f in zip(streams, found, strict=True)]


def seek(media: bytes, sample: int) -> Frame | None:
    """The frame that holds a sample, decoded from the nearest seek point before it."""
    s = read_metadata(media)
    if not s or not 0 <= sample < s.samples:
        return None
    k = int(np.searchsorted(s.points["sample"].astype(np.int64), sample, side="right")) - 1
    at = s.first + (int(s.points["byte"][k]) if k >= 0 else 0)
    while at < len(media):
        frame = decode_frames([memoryview(media)[at:]], [s], [0], [at])[0]
        if not frame.ok or sample < frame.first + frame.samples.shape[1]:
            return frame if frame.ok else None
        at = frame.end
    return None


def pcm(frame: Frame, bits: int) -> bytes:
    """Interleaved samples; unsigned for 8 bits, else signed and little-endian, as in WAV files."""
    x = frame.samples.T
    if bits <= 8:
        return (x + 128).astype(np.uint8).tobytes()
    size = (bits + 7) // 8
    return np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :size].tobytes()


def verified(stream: Stream | None, frames: list[Frame]) -> bool:
    """All frames sound and in sequence, and the samples' MD5 as the stream says."""
    if not stream or not all(f.ok for f in frames):
        return False
    at = 0
    for f in frames:
        if f.first != at:
            return False
        at += f.samples.shape[1]
    if at != stream.samples:
        return False
    if not any(stream.md5):
        return True
    size = (stream.bits + 7) // 8
    raw = b"".join(np.ascontiguousarray(f.samples.T.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :size].tobytes() for f in frames)
    return hashlib.md5(raw).digest() == stream.md5


def payload_of(text: str) -> bytes:
    return padded(text.encode())


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def text_media(df: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts (text, no nulls) as FLAC: the columns to keep (all long), n_bytes and media."""
    schema = "".join(f"{c} long, " for c in keep) + "n_bytes long, media binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, media = batch.column("text").to_pylist(), []
        sizes, group, held = [], [], 0
        for t in texts:
            raw = t.encode()
            sizes.append(len(raw))
            group.append(padded(raw))
            held += len(group[-1])
            if held > 1 << 20:
                media += encode_payloads(group)
                group, held = [], 0
        if group:
            media += encode_payloads(group)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return map_arrow(df.select(*keep, "text"), run, schema)


def decoded_batches(batch: pa.RecordBatch, most: int = 1 << 20):
    """(first row, decoded streams) for stretches of a batch of media."""
    medias = batch.column("media").to_pylist()
    a, held = 0, 0
    for b, m in enumerate(medias, 1):
        held += len(m or b"")
        if held > most or b == len(medias):
            yield a, decode_streams(medias[a:b])
            a, held = b, 0


def pcm_blocks(media: DataFrame) -> DataFrame:
    """The decoded blocks of (doc_id, media): each with the sample it begins at and the byte of its frame."""
    schema = "doc_id long, block int, first_sample long, n_samples int, frame_byte long, ok boolean, pcm binary"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        docs, rows = batch.column("doc_id").to_pylist(), []
        for a, found in decoded_batches(batch):
            for k, (stream, frames) in enumerate(found, a):
                rows += [(docs[k], i, f.first, f.samples.shape[1], f.start, f.ok, pcm(f, stream.bits)) for i, f in enumerate(frames)]
        if not rows:
            return None
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return map_arrow(media.select("doc_id", "media"), run, schema)


def describe(raw: bytes, blocks: int) -> str:
    """Blocks, root of the mean square, peak and zero crossings of unsigned 8-bit samples, in whole numbers."""
    x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={blocks};rms={math.isqrt(int((x * x).sum()) // len(x))};peak={int(np.abs(x).max())};crossings={crossings}"


def store_pcm(media: DataFrame, path: str) -> DataFrame:
    """Write the PCM blocks of (doc_id, media) below path, and read them back."""
    pcm_blocks(media).write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.parquet(path)


DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, ok boolean"


def media_digests(media: DataFrame) -> DataFrame:
    """Streams of texts, decoded, verified and described; all columns but media are kept."""
    keep = [c for c in media.columns if c != "media"]
    names = [*keep, *(x.split()[0] for x in DIGESTS.split(", "))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.schema if f.name != "media") + ", " + DIGESTS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, medias = [], batch.column("media").to_pylist()
        for a, found in decoded_batches(batch):
            for k, (stream, frames) in enumerate(found, a):
                raw = b"".join(pcm(f, 8) for f in frames)
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(medias[k]), hashlib.sha256(medias[k]).hexdigest(), describe(raw, len(frames)) if raw else "", verified(stream, frames)))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return map_arrow(media.select(*keep, "media"), run, schema)


def store_texts(df: DataFrame, path: str, *, most: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the streams of all texts below path: ``own`` holds a stream a row, ``common`` one for all copies of a common text, ``copies`` the rows that share it.

    Common are texts with two copies or more, and with so many that there can be no more than ``most`` such texts."""
    texts = ids_and_texts(df, id_col, text_col).withColumns({f"h{k}": F.xxhash64(F.lit(k), "text") for k in (1, 2)})
    counts = stored(texts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")), "counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    common = F.broadcast(counts.where(F.col("n") >= max(2, math.ceil(rows / most))).select("h1", "h2"))
    shared = texts.join(common, ["h1", "h2"], "left_semi")
    text_media(texts.join(common, ["h1", "h2"], "left_anti")).write.option("compression", "zstd").parquet(f"{path}/own")
    shared.select("doc_id", "h1", "h2").write.parquet(f"{path}/copies")
    text_media(shared.dropDuplicates(["h1", "h2"]), keep=("h1", "h2")).write.option("compression", "zstd").parquet(f"{path}/common")


OWN = "doc_id long, n_bytes long, media binary"
SHARED = "h1 long, h2 long, n_bytes long, media binary"


def _folders(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = lambda schema, name: spark.read.schema(schema).parquet(f"{path}/{name}")
    return read(OWN, "own"), read("doc_id long, h1 long, h2 long", "copies"), read(SHARED, "common")


def stored_media(spark, path: str) -> DataFrame:
    """(doc_id, n_bytes, media) of a folder written by ``store_texts``."""
    own, copies, common = _folders(spark, path)
    return own.unionByName(copies.join(common, ["h1", "h2"]).select("doc_id", "n_bytes", "media"))


def digests_of_stored(spark, path: str) -> DataFrame:
    """The digests of a folder written by ``store_texts``; a common stream is decoded once."""
    own, copies, common = _folders(spark, path)
    # at most COMMON rows of a few hundred bytes
    shared = F.broadcast(media_digests(common))
    found = media_digests(own)
    return found.unionByName(copies.join(shared, ["h1", "h2"]).select(found.columns))


def op1_flac_media(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a FLAC stream, read back from the shared folder and described; nulls, repeated rows and empty tables as in this module's docstring."""
    path = scratch_path(spark, "media")
    store_texts(table(spark, sf_dir, "documents"), path)
    return digests_of_stored(spark, path)
