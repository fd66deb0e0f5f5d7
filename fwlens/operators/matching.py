"""Candidate matches: equality of attributes, shape signatures, comparison, best scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fwlens.operators.filters import IGNORED_STATEMENT
from fwlens.operators.function_diff import VALUE

ATTRIBUTES = ["n_blocks", "n_edges", "n_calls"]


def first_order(library: DataFrame, target: DataFrame, on: list[str]) -> DataFrame:
    """Library functions and target functions with equal attributes: one equality join, however many libraries there are. target: (bin_object, bin_faddr, attributes)."""
    return library.join(target, on)


def shape_signatures(functions: DataFrame, nodes: DataFrame, statements: DataFrame) -> DataFrame:
    """(object_id, faddr, shape): a hash over the sorted block shapes of each function. A shape holds all that identity compares but the values that may change, so identical functions have equal signatures; as a further join key it spares comparisons that must fail."""
    keys = ["object_id", "faddr"]
    leaf = F.transform("leaves", lambda x: F.concat_ws("\x1f", x["path"], x["slot"], x["ctype"], F.when(x["slot"] == VALUE, F.lit("")).when(F.lower(x["value"]) == "nan", F.lit("nan")).otherwise(F.coalesce(x["value"], F.lit("\x00")))))
    own = statements.where(F.col("tag") != IGNORED_STATEMENT).select(*keys, "baddr", F.struct("sub_ix", "stmt_ix", F.concat_ws("\x1e", "tag", F.array_join(leaf, "\x1e")).alias("text")).alias("s"))
    blocks = own.groupBy(*keys, "baddr").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws("\x1d", x["sub_ix"].cast("string"), x["text"])), "\x1c")
    shapes = nodes.join(blocks, [*keys, "baddr"], "left").select(*keys, F.when(F.coalesce("lift_ok", F.lit(False)), F.md5(F.concat_ws("\x1b", F.col("n_subblocks").cast("string"), F.coalesce(text, F.lit(""))))).otherwise("unlifted").alias("shape"))
    each = shapes.groupBy(*keys).agg(F.md5(F.array_join(F.array_sort(F.collect_list("shape")), ",")).alias("shape"))
    return functions.select(*keys).join(each, keys, "left").withColumn("shape", F.coalesce("shape", F.lit("")))


def best_with_ties(matches: DataFrame, by: list[str], score: str) -> DataFrame:
    """For each key all rows of the highest score; rows without a score come last."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last())
    return matches.withColumn("_place", F.rank().over(order)).where("_place = 1").drop("_place")


def first_of_group(rows: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_place = 1").drop("_place")


def squished(candidates: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """Groups whose rows all carry one name keep the first by the order; other groups stay whole."""
    group = Window.partitionBy(*by)
    marked = candidates.withColumn("_one", F.coalesce(F.min(name).over(group), F.lit("")).eqNullSafe(F.coalesce(F.max(name).over(group), F.lit(""))))
    marked = marked.withColumn("_place", F.row_number().over(group.orderBy(*order)))
    return marked.where("NOT _one OR _place = 1").drop("_one", "_place")
