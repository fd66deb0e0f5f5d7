"""Helpers that the corpus operators share: tables, scratch storage and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fwlens.plans.storage import Rounds, scratch_path, settled, shared_dir

__all__ = ["Rounds", "ids_and_texts", "map_arrow", "scratch_path", "shared_dir", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to shared storage and read it back: cuts the lineage, and survives the loss of any executor."""
    return settled(df, name)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers are used again by later stages, beside the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType, rows: int | None = None) -> DataFrame:
    """Map every Arrow batch of df with fn, in slices of so many rows if given; None yields nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                if (out := fn(batch.slice(k, rows) if rows else batch)) is not None:
                    yield out
        give_back()

    return df.mapInArrow(run, schema)


def ids_and_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator reads, so no other column of df can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
