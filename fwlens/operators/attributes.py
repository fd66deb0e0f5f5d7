"""Counts and distances that describe functions and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAR = 10000


def counted(keys_of: DataFrame, keys: list[str], counts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """For each row of keys_of several aggregates of other tables with the same keys, 0 where there are none. Each table is aggregated before it is joined."""
    out = keys_of
    for name, (df, aggregate) in counts.items():
        own = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(aggregate.alias(name))
        out = out.join(own, [F.col(k) == F.col(f"_{k}") for k in keys], "left").drop(*[f"_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def function_attributes(functions: DataFrame, nodes: DataFrame, edges: DataFrame, callgraph: DataFrame) -> DataFrame:
    """(object_id, faddr, n_blocks, n_edges, n_calls) of all functions but system calls; edges should be the counted ones."""
    keys = ["object_id", "faddr"]
    own = functions.where(~F.coalesce("is_syscall", F.lit(False))).select(*keys)
    calls = callgraph.select("object_id", F.col("caller").alias("faddr"), "callee")
    one = F.count(F.lit(1))
    return counted(own, keys, {"n_blocks": (nodes, one), "n_edges": (edges, one), "n_calls": (calls, F.count_distinct("callee"))})
