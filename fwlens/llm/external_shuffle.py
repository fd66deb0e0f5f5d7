"""Two-pass external shuffle of records into shards of equal row counts.

Pass one scatters the records uniformly into memory-sized buckets with a seeded hash; pass two runs a seeded
Fisher-Yates shuffle over each bucket (Spark's built-in ``shuffle``) and writes the bucket's rows to their shards. The
order of the buckets and the order within them make one global permutation; shard k holds the k-th stretch of it, so
the row counts of any two shards differ by one at most (the ``rows`` law).

The main path holds DataFrame functions only. A bucket's rows are sorted before they are shuffled and a bucket is a
partition of its own, so a task that runs again after an executor is lost gives the same permutation.

Defined results: a null id or a null text is hashed as such; empty tables give an empty, readable output; repeated rows
are all kept, each with a slot of its own; the record is carried as one struct, so any further columns, whatever their
names, come back unchanged. Rows equal in both id and text meet in one bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path, stored, table

ROW_OVERHEAD = 16


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_OVERHEAD)).cast("long")


def shuffle_to_shards(df: DataFrame, *, shards: int = 40, seed: int = 20240613, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Shuffle all rows of df into shards and write them below path; returns what was written, as (rec, slot, shard).

    bucket_bytes bounds what one task of the second pass holds in memory."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "shards")
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_size(F.col(text_col))), F.lit(0))).first()
    buckets = max(1, math.ceil(size / bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    scattered = df.select(F.pmod(key, F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"), F.struct("*").alias("rec"))
    # a row for each bucket, however many records there are
    counts = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # stored, so Spark knows its size when it plans the join
    starts = stored(counts.select(F.col("bucket").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    shuffled = (
        scattered.repartitionById(buckets, F.col("bucket"))
        .sortWithinPartitions("bucket", "key", F.col(f"rec.{id_col}"))
        .groupBy("bucket")
        .agg(F.collect_list("rec").alias("recs"))
        .select("bucket", F.posexplode(F.shuffle("recs", seed)).alias("pos", "rec"))
    )
    place = F.col("start") + F.col("pos")
    # shard k begins at place ceil(k * rows / shards)
    shard = F.expr(f"int((place * {shards}L) div {max(1, rows)}L)")
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    placed = shuffled.join(starts, F.col("bucket") == F.col("at")).select("rec", place.alias("place")).withColumn("shard", shard)
    out = placed.select("rec", (F.col("place") - first).alias("slot"), "shard")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op5_external_shuffle(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards under the ``rows`` law, described from the shard files."""
    out = shuffle_to_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("rec.text"), F.lit(""))
    return out.select(
        F.col("rec.doc_id").alias("doc_id"),
        row_size(F.col("rec.text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
