"""Near-duplicates by SimHash: 64-bit fingerprints of word shingles, candidates by pigeonhole, verified by Hamming distance.

A fingerprint is split into m blocks. Two that differ in at most d bits differ in at most d blocks, so they share the
other m - d; there is one table of keys for each choice of m - d blocks, and only fingerprints with an equal key are
compared. More blocks make more tables with rarer keys; m follows from the number of fingerprints. Documents with equal
fingerprints are one class and enter as one.

Defined results: a null, empty or blank text has the fingerprint zero, linked like any other; fewer words than a shingle
make one shingle of all of them; repeated rows and repeated ids give a row each; rows without an id link like others,
and a class whose rows have no id at all takes no part; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, map_arrow, stored, table
from .components import components
from .tiles import map_tiles, smallest_reachable, tiled

WORDS, SEED, DISTANCE = 4, 42, 4


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is set if it is set in over half the shingle hashes; as a signed 64-bit number."""
    found = text.encode().lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = list(itertools.accumulate(map(len, found), lambda a, b: a + b + 1))
    begins = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    last = ends[min(words, len(found)) - 1 :]
    for k in range(0, n, 1 << 15):
        hashes = [digest(joined[a:b], seed) for a, b in zip(begins[k : k + (1 << 15)], last[k : k + (1 << 15)], strict=False)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, words: int = WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(t.as_py(), words, seed) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return map_arrow(ids_and_texts(df, id_col, text_col), run, "doc_id long, fp long")


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The number of blocks with the least work for n fingerprints: rows in all tables, and comparisons of unlike ones."""
    return min(range(distance + 1, distance + 6), key=lambda m: math.comb(m, distance) * (1 + n / 2 ** (64 * (m - distance) / m)))


def block_keys(blocks: int, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(number of the table, mask of the bits in its key)."""
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(k, sum(masks[i] for i in own)) for k, own in enumerate(itertools.combinations(range(blocks), blocks - distance))]


def link_prints(classes: DataFrame, n: int, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) that join all classes (fp, rep) within the distance, by their reps."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(m)))) for k, m in block_keys(blocks_for(n, distance), distance)]
    rows = classes.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))

    def run(batch: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch | None:
        fp, rep = (batch.column(c).to_numpy() for c in ("fp", "rep"))
        n = len(fp)
        sizes = np.diff(np.append(begins, n))
        ends = np.repeat(begins + sizes, sizes)  # of the own tile
        at, found, step = np.arange(n), [], 0
        while True:
            step += 1
            at = at[at + step < ends[at]]
            if not len(at):
                break
            close = np.bitwise_count((fp[at] ^ fp[at + step]).view(np.uint64)) <= distance
            found.append(np.stack([at[close], at[close] + step]))
        if not found:
            return None
        a, b = np.concatenate(found, axis=1)
        root = smallest_reachable(a, b, n)
        own = np.flatnonzero(root != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[root[own]])], names=["a", "b"])

    return map_tiles(tiled(rows, "key", "rep"), "key", run, "a long, b long")


def simhash_classes(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component) of stored fingerprints (doc_id, fp): component is the smallest doc_id reachable."""
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = link_prints(classes.where("rep IS NOT NULL"), classes.count(), distance)
    joined = components(links)
    return classes.join(joined, F.col("rep") == F.col("vertex"), "left").select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(df: DataFrame, *, words: int = WORDS, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each row of df."""
    prints = stored(fingerprints(df, words, id_col=id_col, text_col=text_col), "fingerprints")
    classes = stored(simhash_classes(prints, distance), "components")
    return prints.join(classes.withColumnRenamed("fp", "class_fp"), F.col("fp") == F.col("class_fp")).select("doc_id", "fp", F.col("component").alias("component_id"))


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
