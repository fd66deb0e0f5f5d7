"""Reading and writing the engine's tables, legacy signatures and decompiler records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fwlens.schema import DDL, Tables, checked, schema

DECOMPILED = "addr STRING, code STRING, prime STRING, hash1 STRING, hash2 STRING, hash3 STRING"
END_OF_RECORDS = "done"
LIBRARY = "library"


def load_tables(spark: SparkSession, path: str) -> Tables:
    """The tables below path, checked against the schema; raises ValueError where a column is missing or of another type."""
    return Tables(**{name: checked(spark.read.parquet(f"{path}/{name}"), name) for name in DDL})


def write_tables(tables: Tables, path: str, mode: str = "errorifexists") -> None:
    """objects is partitioned by library, so one library's objects can be read alone."""
    for name in DDL:
        writer = checked(getattr(tables, name), name).write.mode(mode)
        (writer.partitionBy(LIBRARY) if name == "objects" else writer).parquet(f"{path}/{name}")


def build_database(lifted: Tables, files: DataFrame) -> tuple[Tables, DataFrame]:
    """(tables, bad objects) of a library tree: of the lifted objects those that have a file, with the file's library; files without lifted code are listed, not fatal. files: (path, library)."""
    own = files.select(F.col("path").alias("filename"), F.col("library").alias("_library"))
    objects = lifted.objects.join(own, "filename").withColumn("library", F.col("_library")).withColumn("role", F.lit("lib")).select(schema("objects").names)
    bad = files.join(lifted.objects.select(F.col("filename").alias("path")), "path", "left_anti")
    return Tables(**{**vars(lifted), "objects": objects}).of("lib"), bad


def call_graph_path(path: str) -> str:
    return f"{path}/call_graph"


def write_call_graph(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    edges.write.mode(mode).parquet(call_graph_path(path))


def load_call_graph(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(call_graph_path(path))
    if missing := {"src_object", "src", "dst_object", "dst"}.difference(found.columns):
        raise ValueError(f"call graph: columns {sorted(missing)} are missing")
    return found


def read_decompiled(spark: SparkSession, path: str) -> DataFrame:
    """(addr, code, prime, hash1, hash2, hash3) of a decompiler's records: tab-separated, addresses in hexadecimal, code in base64; the prime product outgrows 64 bits and stays text. The closing line ends the records."""
    raw = spark.read.csv(path, sep="\t", schema=DECOMPILED, quote="").where(F.col("addr") != END_OF_RECORDS)
    addr = F.conv(F.regexp_replace("addr", "^0[xX]", ""), 16, 10).cast("long")
    return raw.withColumns({"addr": addr, "code": F.decode(F.unbase64("code"), "UTF-8")})


def write_decompiled(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    text = F.regexp_replace(F.base64(F.encode("code", "UTF-8")), "\r\n", "")
    rows = records.select(F.concat(F.lit("0x"), F.lower(F.hex("addr"))).alias("addr"), text.alias("code"), "prime", "hash1", "hash2", "hash3")
    rows.write.mode(mode).csv(path, sep="\t", quote="")


def batches(df: DataFrame, size: int = 1000) -> Iterator[list]:
    """Rows in lists of a size, fetched a partition at a time."""
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


SIGNATURES = "archive STRING, member STRING, name STRING, addr BIGINT, symbol STRING, ok BOOLEAN"


def write_signatures(signatures: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Signatures of single objects (no archive) and of the members of archives; a member that could not be read has one row with ok = false."""
    signatures.select("archive", "member", "name", "addr", "symbol", "ok").write.mode(mode).parquet(path)


def load_signatures(spark: SparkSession, path: str, archive: str | None = None) -> DataFrame:
    found = spark.read.schema(SIGNATURES).parquet(path)
    return found if archive is None else found.where(F.col("archive") == archive)
