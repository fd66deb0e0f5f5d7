"""Groups of candidates, handed to numpy in tiles of bounded size.

Rows that share a key are candidates for each other. A key with up to ``cap`` rows is one tile. The rows of a larger key
are dealt into k chunks, and each pair of chunks becomes a tile of its own, so no group, however large, is one task's
work, and each pair of rows meets in exactly one tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, stored

CAP = 1024


def tiled(rows: DataFrame, key: str, member: str, cap: int = CAP) -> DataFrame:
    """Add tile_i, tile_j and chunk to rows, repeating rows of large keys once for each tile they belong to, and bring each tile's rows together in order. rows is read twice."""
    # stored, so Spark knows its size before it plans the join: a small one is broadcast and the rows are shuffled once
    large = stored(rows.groupBy(F.col(key).alias("large_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap), "large")
    chunks = F.ceil(F.col("n") / F.lit(cap // 2)).cast("int")
    joined = rows.join(large, F.col(key) == F.col("large_key"), "left").withColumn("chunks", F.coalesce(chunks, F.lit(1)))
    dealt = joined.withColumn("chunk", F.pmod(F.xxhash64(F.lit(7), member), F.col("chunks")).cast("int"))
    others = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = others.select(*rows.columns, "chunk", F.least("chunk", "other").alias("tile_i"), F.greatest("chunk", "other").alias("tile_j"))
    return spread.repartition(key, "tile_i", "tile_j").sortWithinPartitions(key, "tile_i", "tile_j")


def map_tiles(rows: DataFrame, key: str, fn: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Call fn with batches that hold whole tiles, and the place where each tile begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def whole(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table, np.ndarray]:
            marks = [table.column(c).to_numpy() for c in (key, "tile_i", "tile_j")]
            new = np.ones(table.num_rows, bool)
            new[1:] = np.logical_or.reduce([m[1:] != m[:-1] for m in marks])
            begins = np.flatnonzero(new)
            cut = table.num_rows if last else int(begins[-1])
            return table.slice(0, cut), table.slice(cut), begins[begins < cut]

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            ready, rest, begins = whole(table, False)
            held = rest.to_batches()
            if len(begins) and (out := fn(ready.combine_chunks().to_batches()[0], begins)) is not None:
                yield out
        if held:
            ready, _, begins = whole(pa.Table.from_batches(held), True)
            if (out := fn(ready.combine_chunks().to_batches()[0], begins)) is not None:
                yield out
        give_back()

    return rows.mapInArrow(run, schema)


def smallest_reachable(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n points the smallest one that it reaches by links (a, b)."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (before == label).all():
            break
    return label
