"""Object trees, target images and their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT_FILES = "{*.o,*.obj}"
BASE_MASK = 0xFFFF0000


def library_of(path: Column, root: str = "") -> Column:
    """The first element of a path below root."""
    return F.split_part(F.substring(path, len(root) + 1, 1 << 20) if root else path, F.lit("/"), F.lit(1))


def object_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """(path, library, length, modified[, content]) of the object files below root; each folder right below it is a library, and files beside the folders belong to none and are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", OBJECT_FILES).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    below = F.substring_index(F.col("path"), base, -1)
    rows = files.select("path", library_of(below).alias("library"), "length", F.col("modificationTime").alias("modified"), *(["content"] if content else []), F.instr(below, "/").alias("_deep"))
    return rows.where("_deep > 0").drop("_deep")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of target images."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")


def little_endian(content: Column, at: int) -> Column:
    """The unsigned 32-bit number at a byte."""
    digits = F.hex(F.substring(content, at + 1, 4))
    return F.conv(F.regexp_replace(digits, "(..)(..)(..)(..)", "$4$3$2$1"), 16, 10).cast("long")


def cortex_header(content: Column) -> Column:
    """(base, entry, stack) of a Cortex-M image: its first two words, the base from the entry's upper half."""
    entry = little_endian(content, 4)
    return F.struct(entry.bitwiseAND(F.lit(BASE_MASK)).alias("base"), entry.alias("entry"), little_endian(content, 0).alias("stack"))
