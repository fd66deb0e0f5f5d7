"""Vectorised pre-tokenisation: whole batches of text are cut into words by code-point class, and each distinct word is
encoded once.

A byte-pair encoder never merges across the words that its pre-tokeniser makes, so encoding distinct words and
gathering their ids gives what encoding the whole text gives. The cuts are those of the two public patterns:

- ``spaced``:  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
- ``bare``:    's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+   (white space is dropped)
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# fixed values: the code points with the property White_Space
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CHUNK_CHARS = 1_000_000
#: of eight bytes the first n
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: odd factors that spread the bits of a word's bytes
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
SAFE_CUT = re.compile("[A-Za-z](?= )")


@functools.cache
def classes() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its class, and whether that has stayed the same through the versions of Unicode; one that is unassigned here may have another class in the library's version."""
    kind = {"L": LETTER, "N": NUMBER}
    old = unicodedata.ucd_3_2_0.category
    now, then, assigned = np.empty(0x110000, np.uint8), np.empty(0x110000, np.uint8), np.empty(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        own = unicodedata.category(c)
        now[i], assigned[i] = kind.get(own[0], OTHER), own != "Cn"
        then[i] = kind.get(old(c)[0], OTHER)
    stable = (now == then) & assigned
    now[WHITE_SPACE] = SPACE
    stable[WHITE_SPACE] = True
    return now, stable


def contractions(cp: np.ndarray, kind: np.ndarray, run: np.ndarray, first: np.ndarray, bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of apostrophes that begin a contraction, and the number of letters that each takes."""
    i = np.flatnonzero(cp == 0x27)
    i = i[i + 1 < len(cp)]
    i = i[run[i] & run[i + 1] & ~first[i + 1] & (kind[i + 1] == LETTER)]
    if not bare:
        i = i[first[i] | (cp[i - 1] != 0x20)]
    a = cp[i + 1]
    two = np.minimum(i + 2, len(cp) - 1)
    b = np.where((i + 2 < len(cp)) & ~first[two] & (kind[two] == LETTER), cp[two], 0)
    one = np.isin(a, [ord(c) for c in "stmd"])
    pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    return i[one | pair], np.where(one, 1, 2)[one | pair]


def starts_of_words(cp: np.ndarray, first: np.ndarray, bare: bool) -> np.ndarray:
    """Where words begin; first marks the starts of separate texts. bare: runs of white space count as words too."""
    kind = classes()[0][cp]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    starts = run.copy()
    space = kind == SPACE
    if bare:
        starts |= kind == NUMBER
    else:
        # a blank before a word belongs to it; of other white space, the last one stands alone
        starts[1:] &= first[1:] | space[1:] | (cp[:-1] != 0x20)
        starts[:-1] |= space[:-1] & ~space[1:] & ~first[1:]
    at, n = contractions(cp, kind, run, first, bare)
    starts[at + 1] = False
    after = at + 1 + n
    starts[after[after < len(cp)]] = True
    return starts


def short_words(cp: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which words have up to 16 bytes of Latin-1 without zeros, their first eight bytes, the bytes after those): no two such words have equal bytes."""
    size, odd = ends - at, (cp == 0) | (cp > 255)
    short = size <= 16
    if odd.any():
        before = np.append(0, np.cumsum(odd))
        short &= before[ends] == before[at]
    own = np.flatnonzero(short)
    raw = np.zeros(len(cp) + 16, np.uint8)
    raw[: len(cp)] = cp
    eight = np.ndarray((len(cp) + 9,), "<u8", raw, strides=(1,))
    a, n = at[own], size[own]
    low, high = eight[a] & KEPT[np.minimum(n, 8)], np.zeros(len(own), np.uint64)
    long = np.flatnonzero(n > 8)
    high[long] = eight[a[long] + 8] & KEPT[n[long] - 8]
    return own, low, high


def distinct(cp: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place of each word, number of each word among them). Short words are told apart by their bytes; others may stand more than once."""
    own, first, second = short_words(cp, at, ends)
    low, long = numbered(first), np.flatnonzero(second)
    if len(long):
        low[long] += (low.max() + 1) * (1 + numbered(second[long]))
        low = numbered(low)
    rest = np.ones(len(at), bool)
    rest[own] = False
    rest = np.flatnonzero(rest)
    most = low.max(initial=-1) + 1
    number = np.empty(len(at), np.int64)
    number[own], number[rest] = low, most + np.arange(len(rest))
    one = np.empty(most + len(rest), np.int64)
    one[number] = np.arange(len(at))
    return one, number


def numbered(x: np.ndarray) -> np.ndarray:
    """Equal values by equal numbers from 0."""
    return pa.array(x).dictionary_encode().indices.to_numpy().astype(np.int64)


class Places:
    """The places of short words by their bytes: open addressing, the words of a call advance together."""

    def __init__(self, low: np.ndarray, high: np.ndarray, place: np.ndarray):
        self.bits = max(16, (2 * len(place)).bit_length())
        self.low, self.high, self.place = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.n = 0
        self.add(low, high, place)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = (low ^ (high * MIX[0]) ^ (high >> np.uint64(29))) * MIX[1]
        return ((h ^ (h >> np.uint64(32))) * MIX[2] >> np.uint64(64 - self.bits)).astype(np.int64)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        used = np.flatnonzero(self.place >= 0)
        return self.low[used], self.high[used], self.place[used]

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each word, -1 where there is none."""
        out, slot, todo = np.full(len(low), -1, np.int64), self._slots(low, high), np.arange(len(low))
        while len(todo):
            place = self.place[slot]
            same = (self.low[slot] == low[todo]) & (self.high[slot] == high[todo]) & (place >= 0)
            out[todo[same]] = place[same]
            go = ~same & (place >= 0)
            todo, slot = todo[go], (slot[go] + 1) & (len(self.place) - 1)
        return out

    def add(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        """Words that are not there yet, each once."""
        if 2 * (self.n + len(place)) > len(self.place):
            self.__init__(*(np.concatenate(x) for x in zip(self.entries(), (low, high, place), strict=True)))
            return
        self.n += len(place)
        slot, todo = self._slots(low, high), np.arange(len(place))
        while len(todo):
            free = np.flatnonzero(self.place[slot] < 0)
            self.place[slot[free]] = place[todo[free]]
            # of several that meet in a free slot the last one has it
            won = free[self.place[slot[free]] == place[todo[free]]]
            self.low[slot[won]], self.high[slot[won]] = low[todo[won]], high[todo[won]]
            go = np.ones(len(todo), bool)
            go[won] = False
            todo, slot = todo[go], (slot[go] + 1) & (len(self.place) - 1)


class Words:
    """Distinct words and their ids, about ``most`` of them; when full, it forgets the words met once, then the rarest.

    encode gives for a list of words their ids, one after another, and how many each has. Short words are kept by their
    bytes in ``short``, others as strings in ``place``; both give places in the same arrays."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000):
        self.encode, self.most = encode, most
        self.place: dict[str, int] = {}
        self.short = Places(*(np.zeros(0, x) for x in (np.uint64, np.uint64, np.int32)))
        self._set(np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _set(self, ids: np.ndarray, size: np.ndarray, hits: np.ndarray) -> None:
        self.n, room = len(size), 2 * self.most
        self.ids = np.concatenate([ids, np.zeros(max(1 << 16, len(ids)), np.uint32)])
        self.size, self.hits = (np.concatenate([x, np.zeros(room, np.int64)]) for x in (size, hits))
        self.start = np.concatenate([np.cumsum(size) - size, np.zeros(room, np.int64)])
        self.used = len(ids)

    def forget(self) -> None:
        hits = self.hits[: self.n]
        keep = hits > 1
        if keep.sum() > self.most // 2:
            keep = hits > np.partition(hits, self.n - self.most // 2)[self.n - self.most // 2]
        kept = np.flatnonzero(keep)
        new = np.cumsum(keep) - 1
        self.place = {w: int(new[k]) for w, k in self.place.items() if keep[k]}
        low, high, place = self.short.entries()
        stay = keep[place]
        self.short = Places(low[stay], high[stay], new[place[stay]].astype(np.int32))
        ids, size = self.gather(kept)
        self._set(ids, size, hits[kept] // 2)

    def add(self, words: list[str]) -> np.ndarray:
        """The places of new words."""
        flat, sizes = self.encode(words)
        n, m = self.n, len(words)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + m > len(self.start):
            self.start, self.size, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.hits))
        self.ids[self.used : self.used + len(flat)] = flat
        self.size[n : n + m], self.hits[n : n + m] = sizes, 0
        self.start[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.n += m
        return np.arange(n, n + m)

    def met(self, places: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        self.hits[: self.n] += np.bincount(places, counts, self.n).astype(np.int64)
        return places

    def places(self, words: list[str], counts: np.ndarray | None = None) -> np.ndarray:
        """Where the words stand; counts: how often each was met, once if not given."""
        if self.n > self.most:
            self.forget()
        out = np.fromiter(map(self.place.get, words, itertools.repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [words[k] for k in missing.tolist()]
            names = [*dict.fromkeys(new)]
            self.place.update(zip(names, self.add(names).tolist(), strict=True))
            out[missing] = [self.place[w] for w in new]
        return self.met(out, counts)

    def places_in(self, text: str, cp: np.ndarray, at: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same for words of a text with code points cp, each short one once: only words that are new, or not short, become strings."""
        if self.n > self.most:
            self.forget()
        own, low, high = short_words(cp, at, ends)
        out = np.full(len(at), -1, np.int64)
        found = self.short.find(low, high)
        out[own] = found
        rest = np.ones(len(at), bool)
        rest[own] = False
        rest = np.flatnonzero(rest)
        cut = lambda k: [text[a:b] for a, b in zip(at[k].tolist(), ends[k].tolist(), strict=True)]
        others = cut(rest)
        new = np.flatnonzero(found < 0)
        names = [w for w in dict.fromkeys(others) if w not in self.place]
        if len(new) or names:
            place = self.add(cut(own[new]) + names)
            self.short.add(low[new], high[new], place[: len(new)].astype(np.int32))
            self.place.update(zip(names, place[len(new) :].tolist(), strict=True))
            out[own[new]] = place[: len(new)]
        out[rest] = [self.place[w] for w in others]
        return self.met(out, counts)

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and how many each has."""
        sizes = self.size[places]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.start[places] - ends + sizes, sizes)
        return self.ids[shift + np.arange(len(shift))], sizes


def parts_of(text: str, special: re.Pattern | None) -> Iterator[str]:
    """Stretches of a text that can be cut into words apart from each other."""
    for part in special.split(text) if special else [text]:
        at = 0
        while len(part) - at > CHUNK_CHARS and (m := SAFE_CUT.search(part, at + CHUNK_CHARS // 2)):
            yield part[at : m.end()]
            at = m.end()
        if at < len(part):
            yield part[at:] if at else part


class TextEncoder:
    """Encodes batches of texts to ids.

    special: strings that stay whole. unstable: gives the words of a stretch with code points whose class differs
    between versions of Unicode; by default the stretch goes to the encoder as a whole."""

    def __init__(self, encode, *, bare: bool = False, special: list[str] = (), unstable: Callable[[str], list[str]] | None = None, normalize: Callable[[str], str] | None = None):
        self.words, self.bare, self.unstable, self.normalize = Words(encode), bare, unstable, normalize
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.whole = set(special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owners: list[int] = []
        chars = 0
        for k, text in enumerate(texts):
            for part in parts_of(text, self.special if self.special and self.special.search(text) else None):
                parts.append(part)
                owners.append(k)
                chars += len(part)
                if chars >= CHUNK_CHARS:
                    ids.append(self._encode(parts, owners, counts))
                    parts, owners, chars = [], [], 0
        if parts:
            ids.append(self._encode(parts, owners, counts))
        return np.concatenate(ids), counts

    def _encode(self, parts: list[str], owners: list[int], counts: np.ndarray) -> np.ndarray:
        if self.normalize:
            parts = [p if p in self.whole else self.normalize(p) for p in parts]
        sizes = np.array([len(p) for p in parts], np.int64)
        text = "".join(parts)
        if not text:
            return np.zeros(0, np.uint32)
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum(sizes) - sizes
        first = np.zeros(len(cp), bool)
        first[begins[sizes > 0]] = True
        starts = starts_of_words(cp, first, self.bare)
        odd = ~classes()[1][cp]
        if self.whole or odd.any():
            strange = np.flatnonzero(np.add.reduceat(odd, begins[sizes > 0])) if odd.any() else []
            full = np.flatnonzero(sizes > 0)
            for k in {*full[strange].tolist()} | {k for k, p in enumerate(parts) if p in self.whole}:
                b, n = int(begins[k]), int(sizes[k])
                starts[b : b + n] = False
                cuts = [0, n] if self.unstable is None or parts[k] in self.whole else np.cumsum([0, *map(len, self.unstable(parts[k]))])
                starts[b + np.asarray(cuts[:-1])] = True
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(cp))
        if self.bare:
            keep = classes()[0][cp[at]] != SPACE
            if odd.any():  # a whole stretch may begin with white space
                keep |= ends - at > 1
            at, ends = at[keep], ends[keep]
        one, number = distinct(cp, at, ends)
        out, each = self.words.gather(self.words.places_in(text, cp, at[one], ends[one], np.bincount(number, minlength=len(one)))[number])
        owner = np.asarray(owners)[np.searchsorted(begins + sizes, at, side="right")]
        counts += np.bincount(owner, weights=each, minlength=len(counts)).astype(np.int64)
        return out
