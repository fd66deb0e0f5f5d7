"""Which image to match, and how it is loaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fwlens.schema import Tables
from fwlens.sources.binaries import cortex_header, image_files

CORTEX_ARCHITECTURE = "ARMCortexM"


@dataclass
class LoadOptions:
    base: int | None = None
    entry: int | None = None
    arch: str | None = None

    @property
    def manual(self) -> bool:
        return None not in (self.base, self.entry, self.arch)


def cortex_options(spark: SparkSession, path: str) -> LoadOptions:
    """Base and entry from the header of a Cortex-M image."""
    head = image_files(spark, path).select(cortex_header(F.col("content")).alias("h")).first()
    if head is None or head["h"]["entry"] is None:
        raise ValueError(f"{path} has no header")
    return LoadOptions(head["h"]["base"], head["h"]["entry"], CORTEX_ARCHITECTURE)


def load_target(lifted: Tables, options: LoadOptions, object_id: str | None = None) -> Tables | None:
    """The target among lifted objects: the one with the given base, entry and architecture if all are given, else the only target; None if there is none or several."""
    targets = lifted.objects.where(F.col("role") == "target")
    if object_id is not None:
        targets = targets.where(F.col("object_id") == object_id)
    if options.manual:
        targets = targets.where((F.col("base_addr") == options.base) & (F.col("entry") == options.entry) & (F.col("arch") == options.arch))
    found = [r["object_id"] for r in targets.select("object_id").limit(2).collect()]
    if len(found) != 1:
        return None
    only = lifted.objects.where(F.col("object_id") == found[0]).withColumn("role", F.lit("target"))
    return Tables(**{**vars(lifted), "objects": only}).of("target")
