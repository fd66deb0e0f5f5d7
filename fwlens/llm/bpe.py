"""Byte-level BPE encoding by speculation: greedy longest matches are proposed, every adjacent pair of proposed tokens is
tested at once, and only the words that fail are merged exactly.

Why the test suffices: a run of tokens is what BPE makes of a word if each token is what BPE makes of its own bytes and,
for each boundary between two tokens, no merge crosses it. A crossing merge joins a piece on the right edge of the left
token with a piece on the left edge of the right one while both exist. A piece exists from the rank that makes it until
the rank of the merge that takes it up, so a boundary falls if some pair (x, y) of edge pieces has a merge whose rank
lies below the end of x and not above the end of y (at equal ranks the leftmost merge goes first).

Defined results: a null text is encoded as the empty text, with no ids; the strings of special tokens in a text become
those tokens, as the library does by default; repeated rows and repeated ids give equal rows; other columns of the input
are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from .common import ids_and_texts, map_arrow, table
from .pretokens import TextEncoder

NONE = np.int64(1) << 40
LONG_WORD = 48
CACHE_BITS = 21


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and edges of a byte-level BPE file (the JSON of the tokenizers library)."""

    def __init__(self, content: str):
        data = json.loads(content)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        as_byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.bytes[i] = bytes(as_byte[c] for c in t) if all(c in as_byte for c in t) else t.encode()
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.id_of = {self.bytes[i]: i for t, i in vocab.items()}
        self.byte_ids = [self.id_of.get(bytes([b]), -1) for b in range(256)]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right, self.born = np.full(size, -1), np.full(size, -1), np.full(size, -1)
        for rank, (a, b) in enumerate(pairs):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x, y) not in self.merges:
                self.merges[x, y] = (rank, z)
                if self.born[z] < 0:
                    self.left[z], self.right[z], self.born[z] = x, y, rank
        keys = np.array([(x << 32) | y for x, y in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        #: the longest token that begins with two given bytes
        self.longest: dict[bytes, int] = {}
        for t in self.id_of:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 1), len(t))
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.checked = np.full(size, -1, np.int8)
        self.known_keys, self.known = np.full(1 << CACHE_BITS, -1, np.int64), np.zeros(1 << CACHE_BITS, bool)

    # exact merging

    def merge(self, word: bytes) -> list[int]:
        """BPE as defined: again and again the merge of lowest rank, the leftmost of equal ones."""
        ids = [self.byte_ids[b] for b in word]
        return self._merge_short(ids) if len(ids) <= LONG_WORD else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        merges, none = self.merges, (1 << 40, -1)
        ranks = [merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best[1] < 0:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k:
                ranks[k - 1] = merges.get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = merges.get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, z = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = z, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for i in (before[k], k):
                if i >= 0 and (e := after[i]) >= 0 and (m := merges.get((ids[i], ids[e]))):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[e], m[1]))
        return [t for t in ids if t >= 0]

    # speculation

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest matches."""
        out, at, n, id_of, longest = [], 0, len(word), self.id_of, self.longest
        while at < n:
            size = min(longest.get(word[at : at + 2], 1), n - at)
            while size > 1 and word[at : at + size] not in id_of:
                size -= 1
            out.append(id_of.get(word[at : at + size], -1))
            at += size
        return out

    def sound(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token is what BPE makes of its own bytes."""
        for t in np.unique(tokens[self.checked[tokens] < 0]).tolist():
            self.checked[t] = t >= 0 and self.merge(self.bytes[t]) == [t]
        return self.checked[tokens] == 1

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of tokens, whether the boundary between them stays."""
        key = (a << 32) | b
        slot = (key * np.int64(-7046029254386353131)) >> np.int64(64 - CACHE_BITS) & np.int64((1 << CACHE_BITS) - 1)
        out = self.known[slot]
        if (new := self.known_keys[slot] != key).any():
            fresh, back = np.unique(key[new], return_inverse=True)
            out[new] = self._compatible(fresh >> 32, fresh & 0xFFFFFFFF)[back]
            self.known_keys[slot[new]], self.known[slot[new]] = key[new], out[new]
        return out

    def _compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Walks back in time along the two edges, always past the younger piece, and looks for a merge across."""
        good = np.ones(len(x), bool)
        end_x, end_y = np.full(len(x), NONE), np.full(len(x), NONE)
        live = np.arange(len(x))
        while len(live):
            m = self.rank(x, y)
            bad = (m < end_x) & (m <= end_y) & (m < NONE)
            good[live[bad]] = False
            bx, by = self.born[x], self.born[y]
            go = ~bad & ((bx >= 0) | (by >= 0))
            live, x, y, end_x, end_y, bx, by = (v[go] for v in (live, x, y, end_x, end_y, bx, by))
            left = bx > by
            x, end_x, y, end_y = np.where(left, self.right[x], x), np.where(left, bx, end_x), np.where(left, y, self.left[y]), np.where(left, end_y, by)
        return good

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each word)."""
        raw = [w.encode() for w in words]
        out = [[self.special[w]] if w in self.special else self.propose(b) for w, b in zip(words, raw, strict=True)]
        sizes = np.array([len(x) for x in out])
        flat = np.array([t for x in out for t in x], np.int64)
        owner = np.repeat(np.arange(len(out)), sizes)
        fails = ~self.sound(flat)
        if len(flat) > 1:
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            fails[inner[~self.compatible(flat[inner], flat[inner + 1])]] = True
        for k in np.unique(owner[fails]).tolist():
            if words[k] not in self.special:
                out[k] = self.merge(raw[k])
        return np.array([t for x in out for t in x], np.uint32), np.array([len(x) for x in out], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each document's ids; bytes that are not UTF-8 become U+FFFD."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        shift = np.repeat(self.offsets[ids] - ends + sizes, sizes)
        raw = self.flat[shift + np.arange(len(shift))].tobytes()
        last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(last, last[1:], strict=False)]


@functools.lru_cache(2)
def coder(content: str) -> tuple[Vocabulary, TextEncoder]:
    v, cut = Vocabulary(content), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    # code points of which the versions of Unicode differ are cut as the library does
    return v, TextEncoder(v.encode_words, special=[*v.special], unstable=lambda s: [s[a:b] for _, (a, b) in cut.pre_tokenize_str(s)])


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def coded(df: DataFrame, tokenizer_path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again: (doc_id, ids, decoded), or the digests of these.

    The vocabulary file is read on the driver and sent once to each executor; its size does not depend on the data."""
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary, encoder = coder(content.value)
        texts, out = batch.column("text").to_pylist(), []
        step = max(1, min(len(texts), 1 << 10))
        for a in range(0, len(texts), step):
            ids, counts = encoder.encode(texts[a : a + step])
            decoded = vocabulary.decode(ids, counts)
            cuts = np.concatenate([[0], np.cumsum(counts)])
            if digests:
                raw = memoryview(ids.astype("<u4").tobytes())
                for k, text in enumerate(decoded):
                    out.append((int(counts[k]), hashlib.sha256(raw[4 * cuts[k] : 4 * cuts[k + 1]]).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            else:
                out += [(ids[cuts[k] : cuts[k + 1]].astype(np.int32), text) for k, text in enumerate(decoded)]
        columns = [batch.column("doc_id"), *map(pa.array, zip(*out, strict=True))]
        if not digests:
            columns = [columns[0], pa.array([x for x, _ in out], pa.list_(pa.int32())), columns[2]]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in (DIGESTS if digests else SCHEMA).split(", ")])

    return map_arrow(ids_and_texts(df, id_col, text_col), run, DIGESTS if digests else SCHEMA)


def op10_bpe_coding(spark, sf_dir: str) -> DataFrame:
    """Every document encoded with the 50k byte-level vocabulary and decoded again."""
    import public_tokenizers

    return coded(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
