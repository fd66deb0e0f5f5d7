"""The engine's tables: disassembled objects in relational form.

One object is one compiled file or one target image. Addresses are 64-bit; IR expressions are flattened to leaves, each
with its path, the slot it stands in, its exact type and its value as text.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAVES = "ARRAY<STRUCT<path: STRING, slot: STRING, ctype: STRING, value: STRING>>"

DDL = {
    "objects": "object_id STRING, library STRING, filename STRING, role STRING, arch STRING, min_addr BIGINT, max_addr BIGINT, base_addr BIGINT, entry BIGINT",
    "regions": "object_id STRING, kind STRING, name STRING, min_addr BIGINT, max_addr BIGINT",
    "symbols": "object_id STRING, ord INT, is_extern BOOLEAN, name STRING, rebased_addr BIGINT, size BIGINT, binding STRING, is_function BOOLEAN, is_hidden BOOLEAN, is_weak BOOLEAN",
    "functions": "object_id STRING, faddr BIGINT, name STRING, startpoint BIGINT, is_plt BOOLEAN, is_simprocedure BOOLEAN, is_syscall BOOLEAN",
    "cfg_nodes": "object_id STRING, faddr BIGINT, baddr BIGINT, ord INT, size INT, jumpkind STRING, lift_ok BOOLEAN, n_subblocks INT, instruction_addrs ARRAY<BIGINT>, tags ARRAY<STRING>, operations ARRAY<STRING>, register_offsets ARRAY<INT>, constants ARRAY<BIGINT>",
    "statements": f"object_id STRING, faddr BIGINT, baddr BIGINT, sub_ix INT, stmt_ix INT, tag STRING, leaves {LEAVES}",
    "cfg_edges": "object_id STRING, faddr BIGINT, src BIGINT, dst BIGINT, edge_type STRING",
    "call_sites": "object_id STRING, faddr BIGINT, baddr BIGINT, block_ord INT, seq INT, target BIGINT",
    "callgraph": "object_id STRING, caller BIGINT, callee BIGINT",
    "hooks": "object_id STRING, addr BIGINT, label STRING",
}
CANDIDATES = "bin_faddr BIGINT, library STRING, object_id STRING, lib_faddr BIGINT, name STRING, similarity DOUBLE, is_guess BOOLEAN"


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


@dataclass
class Tables:
    """All tables of a set of objects."""

    objects: DataFrame
    regions: DataFrame
    symbols: DataFrame
    functions: DataFrame
    cfg_nodes: DataFrame
    statements: DataFrame
    cfg_edges: DataFrame
    call_sites: DataFrame
    callgraph: DataFrame
    hooks: DataFrame

    def of(self, role: str) -> Tables:
        """The rows of objects in one role, ``lib`` or ``target``."""
        ids = self.objects.where(F.col("role") == role).select(F.col("object_id").alias("role_id"))
        # objects are few beside their rows; a shuffle by object would leave an object's rows to one task
        cut = lambda df: df.join(F.broadcast(ids), F.col("object_id") == F.col("role_id"), "left_semi")
        return Tables(**{f.name: cut(getattr(self, f.name)) for f in fields(self)})

    def union(self, other: Tables) -> Tables:
        return Tables(**{f.name: getattr(self, f.name).unionByName(getattr(other, f.name)) for f in fields(self)})


def from_rows(spark: SparkSession, rows: dict[str, list]) -> Tables:
    """Tables from Python rows, as tests and small imports have them; missing tables are empty."""
    return Tables(**{name: spark.createDataFrame(rows.get(name, []), schema(name)) for name in DDL})


def checked(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of a table, in order; raises ValueError if one is missing or of another type."""
    have = {f.name: f.dataType for f in df.schema}
    for f in schema(table):
        if f.name not in have:
            raise ValueError(f"{table}: column {f.name} is missing")
        if have[f.name].simpleString() != f.dataType.simpleString():
            raise ValueError(f"{table}: column {f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    return df.select(*schema(table).names)
