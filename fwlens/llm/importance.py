"""Quality selection by importance resampling: hashed n-gram models of a target and of the raw corpus, Gumbel top-k.

Texts are bags of hashed tokens and token pairs, with a slot of its own for a token that repeats the one before. The raw
model counts all documents, the target model one half of a sample of rows labelled good. The ratio of a slot's
probabilities is drawn towards one by ``SMOOTHING`` counts, so rare slots say little. A document's log-weight is the sum
of log(target / raw) over its features; adding Gumbel noise and taking the k highest draws k documents without
replacement in proportion to their weights. k is the number of documents whose weight reaches the threshold that parts
the good and the bad of the sample's other half best.

Counts and log-ratios are whole numbers (fixed point), so sums do not depend on the order of rows. The noise of a
document comes from a hash of its id. The k-th highest key is found exactly, by histograms of 16 bits of the key a round.

Defined results: a null text is the empty text, whose weight is 1 (log-weight 0); rows tied with the k-th key are kept;
repeated rows have one key and stand or fall together; without labelled rows all rows are kept; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

SLOT_BITS, SMOOTHING, SCALE = 14, 30.0, 1 << 20
SAMPLE_ROWS = 6000
CHUNK_BYTES = 1 << 20
SPACE, PUNCTUATION, WORD = 0, 1, 2
MIX, ROOT = 0x9E3779B97F4A7C15, 0x100000001B3
SEED = 20240613
BLANK = re.compile(rb"[\x00\x09-\x0d ]+")


@functools.cache
def byte_kinds() -> np.ndarray:
    kind = np.full(256, PUNCTUATION, np.uint8)
    kind[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = WORD
    kind[[0x20, *range(0x09, 0x0E), 0]] = SPACE
    return kind


@functools.cache
def powers(n: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses, for the places in a chunk of n bytes."""
    one = np.ones(1, np.uint64)
    up, down = (np.cumprod(np.concatenate([one, np.full(n, r, np.uint64)])) for r in (ROOT, pow(ROOT, -1, 1 << 64)))
    return up, down


def features(texts: list[bytes], continued: list[bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all features, number of features of each text). A continued text begins with the last token of the one it continues, which counts in the pair only."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    kind = byte_kinds()[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    at = np.flatnonzero(edge)
    begin, end = at[:-1], at[1:]
    keep = kind[begin] != SPACE
    begin, end = begin[keep], end[keep]
    up, down = powers()
    if len(raw) > len(up) - 2:  # a single token beyond the chunk
        up, down = powers.__wrapped__(len(raw) + 2)
    mix = np.uint64(MIX)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        h = (prefix[end] - prefix[begin]) * down[begin] * mix
        h ^= h >> np.uint64(29)
        pair = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]) * mix
    owner = np.searchsorted(np.cumsum(sizes), begin, side="right")
    last = np.uint64((1 << SLOT_BITS) - 1)  # kept for repeats
    slot = lambda x: np.minimum((x * mix) >> np.uint64(64 - SLOT_BITS), last - np.uint64(1))
    with np.errstate(over="ignore"):
        one, two = slot(h), np.where(h[:-1] == h[1:], last, slot(pair))
    both = owner[:-1] == owner[1:]
    own = np.ones(len(owner), bool)
    if continued and any(continued):
        own[0] = not continued[owner[0]] if len(owner) else True
        own[1:] = both | ~np.array(continued)[owner[1:]]
    owners = np.concatenate([owner[own], owner[:-1][both]])
    slots = np.concatenate([one[own], two[both]]).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return slots[order], np.bincount(owners, minlength=len(texts))


def last_token(part: bytes) -> bytes:
    kind = byte_kinds()[np.frombuffer(part, np.uint8)]
    full = np.flatnonzero(kind != SPACE)
    if not len(full):
        return b""
    end = int(full[-1]) + 1
    other = np.flatnonzero(kind[:end] != kind[end - 1])
    return part[int(other[-1]) + 1 if len(other) else 0 : end]


def pieces(texts: list[bytes]) -> Iterator[tuple[int, bytes, bool]]:
    """(number of the text, piece, whether it continues): long texts are cut at blanks, and a piece after a cut begins with the last token before it."""
    for k, text in enumerate(texts):
        at, before = 0, b""
        while True:
            cut = BLANK.search(text, at + CHUNK_BYTES) if len(text) - at > CHUNK_BYTES else None
            part = text[at : cut.start() if cut else len(text)]
            yield k, before + b" " + part if before else part, bool(before)
            if not cut:
                break
            before = last_token(part) or before
            at = cut.end()


def chunked(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the text of each piece, slots, number of features of each piece), a bounded stretch at a time."""
    held: list[tuple[int, bytes, bool]] = []
    size = 0
    for piece in pieces(texts):
        held.append(piece)
        size += len(piece[1])
        if size > CHUNK_BYTES:
            owners, parts, more = zip(*held, strict=True)
            yield np.array(owners), *features(list(parts), list(more))
            held, size = [], 0
    if held:
        owners, parts, more = zip(*held, strict=True)
        yield np.array(owners), *features(list(parts), list(more))


def plain(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *more)


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(labelled_id, good, target) of about so many labelled documents, chosen by a hash of the id; a document is good if it is labelled so throughout and never toxic. The good ones of one half make the target."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"), F.min("quality").alias("quality"))
    one = one.where("good OR quality = 0")
    share = rows / max(1, one.count())
    return one.where(F.pmod(F.xxhash64(F.lit("quality sample"), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select(F.col("doc_id").alias("labelled_id"), "good", (F.col("good") & (F.pmod(F.xxhash64(F.lit("target half"), "doc_id"), F.lit(2)) == 0)).alias("target"))


def model_counts(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts by slot of the target's features and of all documents'. sample: (labelled_id, good, target), of bounded size."""
    flagged = plain(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"), "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << SLOT_BITS), np.int64)
        for batch in batches:
            target = np.array(batch.column("target").to_pylist(), bool)
            for owners, slots, counts in chunked(batch.column("text").to_pylist()):
                n[1] += np.bincount(slots, minlength=n.shape[1])
                mine = np.repeat(target[owners], counts)
                n[0] += np.bincount(slots[mine], minlength=n.shape[1])
        for k in range(2):
            some = np.flatnonzero(n[k])
            yield pa.RecordBatch.from_arrays([pa.array(some + (k << SLOT_BITS)), pa.array(n[k][some])], names=["slot", "n"])

    total = flagged.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most two rows a slot
    out = np.zeros(2 << SLOT_BITS, np.int64)
    out[total.column("slot").to_numpy()] = total.column("n").to_numpy()
    return out[: 1 << SLOT_BITS], out[1 << SLOT_BITS :]


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target / raw) by slot, in fixed point."""
    if not target.sum():
        return np.zeros(len(raw), np.int64)
    expected = raw * (target.sum() / raw.sum())
    return np.rint(np.log((target + SMOOTHING) / (expected + SMOOTHING)) * SCALE).astype(np.int64)


def log_weights(docs: DataFrame, ratios: np.ndarray, *, whole: bool = False) -> DataFrame:
    """Each whole text's n_features and log_weight (fixed point), with doc_id, or with the whole row as struct ``rec``. ratios, of fixed size, is sent once to each executor."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for owners, slots, counts in chunked(batch.column("text").to_pylist()):
                ends = np.concatenate([[0], np.cumsum(shared.value[slots])])[np.concatenate([[0], np.cumsum(counts)])]
                np.add.at(n, owners, counts)
                np.add.at(weight, owners, np.diff(ends))
            names = ["rec"] * whole + ["doc_id", "n_features", "log_weight"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(n), pa.array(weight)], names=names)

    if not whole:
        return plain(docs).mapInArrow(run, "doc_id long, n_features long, log_weight long")
    rows = docs.select(F.struct("*").alias("rec"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["rec"].dataType.simpleString()
    return rows.mapInArrow(run, f"rec {kind}, doc_id long, n_features long, log_weight long")


def gumbel_key(seed: int = SEED):
    """Log-weight plus Gumbel noise, in fixed point; the noise hangs on the id alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col("log_weight") + F.round(-F.log(-F.log(u)) * SCALE).cast("long")


def threshold(good: np.ndarray, bad: np.ndarray) -> int | None:
    """The weight that parts good from bad with the fewest errors, each kind counted in shares; amid the widest stretch of such weights."""
    if not len(good) or not len(bad):
        return None
    cuts = np.unique(np.concatenate([good, bad]))
    lost = np.searchsorted(np.sort(good), cuts, side="left") / len(good)
    let_in = 1 - np.searchsorted(np.sort(bad), cuts, side="left") / len(bad)
    k = int(np.argmin(lost + let_in))
    return int(cuts[k - 1] + (cuts[k] - cuts[k - 1]) // 2) + 1 if k else int(cuts[0])


def kth_highest(keys: DataFrame, k: int) -> int:
    """The k-th highest of the long column ``key``, by histograms: four rounds of at most 65536 rows each."""
    prefix = None
    for shift in (48, 32, 16, 0):
        own = keys if prefix is None else keys.where(F.shiftright("key", shift + 16) == F.lit(prefix))
        part = F.shiftright("key", shift)
        counts = sorted(own.groupBy(part.alias("part")).count().collect(), reverse=True)
        for value, n in counts:
            if k <= n:
                prefix = value
                break
            k -= n
    return prefix


class Resampling:
    """The models, the threshold and the k-th key for a corpus and its labels."""

    def __init__(self, docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, seed: int = SEED):
        sample = stored(labelled_sample(labels, sample_rows), "quality-sample")
        self.ratios = log_ratios(*model_counts(docs, sample))
        self.scores = stored(log_weights(docs, self.ratios).withColumn("key", gumbel_key(seed)), "scores")
        known = self.scores.join(F.broadcast(sample.where("NOT target")), F.col("doc_id") == F.col("labelled_id")).select("good", "log_weight").toArrow()
        good = known.column("good").to_numpy(zero_copy_only=False).astype(bool)
        weight = known.column("log_weight").to_numpy()
        least = threshold(weight[good], weight[~good])
        self.least, self.seed = least, seed
        total = self.scores.count()
        self.k = total if least is None else self.scores.where(F.col("log_weight") >= least).count()
        self.kth = kth_highest(self.scores, self.k) if 0 < self.k < total else None

    def kept(self):
        """The condition, on log_weight and doc_id, by which a row is drawn."""
        if self.kth is None:
            return F.lit(self.k > 0)
        return gumbel_key(self.seed) >= F.lit(self.kth)

    def decisions(self) -> DataFrame:
        return self.scores.select("doc_id", "n_features", (F.col("log_weight") / SCALE).alias("log_weight"), (F.col("key") / SCALE).alias("gumbel_key"), self.kept().alias("kept"))

    def drawn(self, docs: DataFrame) -> DataFrame:
        """The rows of docs that are drawn, with all their columns; weights are computed again, so no text is shuffled."""
        return log_weights(docs, self.ratios, whole=True).where(self.kept()).select("rec.*")


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """The weight, key and decision of every document."""
    return Resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).decisions()
