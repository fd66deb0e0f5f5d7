"""Projections and predicates over objects, functions and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: mapping symbols of the Arm toolchain, which are no functions
BANNED_NAMES = ("$d", "$t")
UNKNOWN_LIBRARY = "_UNKNOWN_LIB"
IGNORED_STATEMENT = "Ist_IMark"
SKIPPED_EDGE = "fake_return"


def trivial(blocks: DataFrame, keys: list[str], instructions: Column, most: int = 2) -> DataFrame:
    """Keys of functions of one block with at most so many instructions."""
    return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(instructions).alias("n_instructions")).where((F.col("n_blocks") == 1) & (F.col("n_instructions") <= most)).select(*keys)


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys do not occur in other (null keys never match, and stay)."""
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def banned_functions(functions: DataFrame, nodes: DataFrame, names: tuple[str, ...] = BANNED_NAMES) -> DataFrame:
    """(object_id, faddr) of stubs, simulated, unnamed, oddly named and trivial functions."""
    keys = ["object_id", "faddr"]
    small = trivial(nodes, keys, F.size("instruction_addrs"))
    name = F.coalesce("name", F.lit(""))
    flag = lambda c: F.coalesce(c, F.lit(False))
    odd = functions.where(flag("is_plt") | flag("is_simprocedure") | (name == "") | name.isin(*names)).select(*keys)
    return odd.unionByName(functions.join(small, keys, "left_semi").select(*keys)).distinct()


def viable_symbols(symbols: DataFrame, banned: DataFrame) -> DataFrame:
    """Visible, strong, global function symbols whose address is not banned."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = symbols.where(flag("is_function") & ~flag("is_hidden") & ~flag("is_weak") & ~F.col("binding").eqNullSafe("STB_LOCAL"))
    return own.join(banned.select("object_id", F.col("faddr").alias("rebased_addr")), ["object_id", "rebased_addr"], "left_anti").select(symbols.columns)


def hook_label(library: Column, name: Column) -> Column:
    return F.concat(F.coalesce(F.when(library != "", library), F.lit(UNKNOWN_LIBRARY)), F.lit(":"), name)


def hooked(df: DataFrame, hooks: DataFrame, addr: str) -> DataFrame:
    """df with the label of a hook at its address, or null."""
    own = hooks.select(F.col("object_id").alias("h_object"), F.col("addr").alias("h_addr"), F.col("label").alias("hook"))
    return df.join(own, (F.col("object_id") == F.col("h_object")) & (F.col(addr) == F.col("h_addr")), "left").drop("h_object", "h_addr")


def inside_regions(df: DataFrame, regions: DataFrame, keys: list[str], value: str, low: str = "min_addr", high: str = "max_addr") -> DataFrame:
    """Rows of df whose value lies in a half-open region with the same keys. The keys make it an equality join; only the regions of one object are compared with its addresses."""
    own = regions.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(low).alias("r_low"), F.col(high).alias("r_high"))
    same = [F.col(k) == F.col(f"r_{k}") for k in keys]
    return df.join(own, [*same, F.col(value) >= F.col("r_low"), F.col(value) < F.col("r_high")], "left_semi")


def loaded_regions(regions: DataFrame) -> DataFrame:
    """An object's segments, or its sections if it has no segments."""
    segmented = regions.where("kind = 'segment'").select("object_id").distinct()
    return regions.where("kind = 'segment'").unionByName(regions.where("kind = 'section'").join(segmented, "object_id", "left_anti"))


def in_span(value: Column, low: Column, high: Column) -> Column:
    return (value >= low) & (value < high)


def compared_statements(statements: DataFrame) -> DataFrame:
    return statements.where(F.col("tag") != IGNORED_STATEMENT)


def counted_edges(edges: DataFrame, kind: str = "edge_type", skipped: str = SKIPPED_EDGE) -> DataFrame:
    """Edges but those of the skipped kind; edges without a kind count."""
    return edges.where(~F.col(kind).eqNullSafe(skipped))


def first_symbol(symbols: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """(keys, name) with the first name by the order, own symbols before extern ones."""
    return symbols.groupBy(*keys).agg(F.min_by(F.col(name), F.struct(*order)).alias(name))


def symbol_names(symbols: DataFrame) -> DataFrame:
    """The first symbol's name at each address of each object."""
    return first_symbol(symbols.withColumnRenamed("rebased_addr", "addr"), ["object_id", "addr"], "name", ["is_extern", "ord"])


def named_functions(functions: DataFrame, name: str = "name", prefix: str = "sub_") -> DataFrame:
    return functions.where(~F.startswith(F.col(name), F.lit(prefix)))
