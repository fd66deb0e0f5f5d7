"""Cutting the lineage of iterative plans through shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a local session gets a temporary one, as in tests; on a cluster executors could not see each other's files, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fwlens-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fwlens-{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str = "step", path: str | None = None) -> DataFrame:
    """df written below spark.checkpoint.dir and read back, so loops don't grow their plans and survive lost executors."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of a loop: each is written to shared storage, and those that no later round reads can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def settle(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        out = settled(df, path=path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            if own := self.paths.pop(id(df), None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(own[1])
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
