"""Refinement of candidates by the context of calls.

Candidates are rows (bin_faddr, library, object_id, lib_faddr, name, similarity, is_guess). Refinement works in
synchronous rounds: all functions are narrowed with the names of the round before, until a round changes nothing.
Lists only shrink while callees narrow callers, and each function names its callees once, so the rounds end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fwlens.operators.matching import squished
from fwlens.plans.storage import Rounds

UNRESOLVABLE, IGNORED = "UnresolvableCallTarget", "Ignored"
ORDER = ["library", "object_id", "lib_faddr"]
CANDIDATE = ["bin_faddr", *ORDER]


def call_positions(sites: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, block_pos, in_block, target): the calls of each function in order, numbered over all and within blocks."""
    whole = Window.partitionBy(*keys).orderBy("block_ord", "baddr", "seq")
    blocks = Window.partitionBy(*keys).orderBy("block_ord", "baddr")
    within = Window.partitionBy(*keys, "block_ord", "baddr").orderBy("seq")
    numbered = sites.select(*keys, F.row_number().over(whole).alias("pos"), F.dense_rank().over(blocks).alias("block_pos"), F.row_number().over(within).alias("in_block"), "target")
    return numbered


def ruled_out(candidates: DataFrame, allowed: DataFrame, calls: DataFrame, key: list[str], candidate: list[str], free: list[str] = ()) -> DataFrame:
    """Candidates of which some call's name is not among those allowed at its place.

    allowed: (key, pos, allowed_name), calls: (candidate, pos, callee_name). A place without allowed names passes, as does
    one that allows a free name; places beyond the shorter list of calls are not compared. A call without a name fails."""
    placed = allowed.groupBy(*key, "pos").agg(F.collect_set("allowed_name").alias("names"))
    own = candidates.select(*dict.fromkeys([*key, *candidate])).distinct()
    at = own.join(calls, candidate).join(placed, [*key, "pos"])
    passes = F.array_contains("names", F.col("callee_name"))
    for name in free:
        passes = passes | F.array_contains("names", F.lit(name))
    return at.where(~F.coalesce(passes, F.lit(False))).select(*own.columns).distinct()


def allowed_names(candidates: DataFrame, positions: DataFrame, banned: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((bin_faddr, pos, allowed_name), functions that cannot be told apart as a callee has no candidates). positions: (bin_faddr, pos, target); banned and inside: (target)."""
    at = positions.join(inside.withColumn("_in", F.lit(True)), "target", "left").join(banned.withColumn("_ban", F.lit(True)), "target", "left")
    outside = at.where("_in IS NULL").select("bin_faddr", "pos", F.lit(UNRESOLVABLE).alias("allowed_name"))
    junk = at.where("_in IS NOT NULL AND _ban IS NOT NULL").select("bin_faddr", "pos", F.lit(IGNORED).alias("allowed_name"))
    plain = at.where("_in IS NOT NULL AND _ban IS NULL").select("bin_faddr", "pos", "target")
    names = candidates.select(F.col("bin_faddr").alias("target"), F.col("name").alias("allowed_name"))
    open_ = plain.join(names.select("target").distinct(), "target", "left_anti").select("bin_faddr").distinct()
    found = plain.join(names, "target").where("allowed_name IS NOT NULL").select("bin_faddr", "pos", "allowed_name")
    return outside.unionByName(junk).unionByName(found).distinct(), open_


def narrowed_by_callees(candidates: DataFrame, positions: DataFrame, library_calls: DataFrame, banned: DataFrame, inside: DataFrame) -> DataFrame:
    """Candidates whose calls fit what their callees may be. positions: (bin_faddr, pos, target); library_calls: (object_id, lib_faddr, pos, callee_name)."""
    key = ["bin_faddr"]
    rounds = Rounds(candidates.sparkSession)
    current = rounds.settle(candidates, "candidates")
    while True:
        several = current.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key)
        allowed, open_ = allowed_names(current, positions, banned, inside)
        narrow = current.join(several, key, "left_semi").join(open_, key, "left_anti")
        out = rounds.settle(ruled_out(narrow, allowed, library_calls, key, ["object_id", "lib_faddr"], [IGNORED]), "ruled-out")
        if not out.limit(1).count():
            rounds.drop(out)
            return current
        before, current = current, rounds.settle(current.join(out, ["bin_faddr", "object_id", "lib_faddr"], "left_anti"), "candidates")
        rounds.drop(before, out)


def guesses(sure: DataFrame, target_calls: DataFrame, library_calls: DataFrame) -> DataFrame:
    """(target, library, object_id, guessed): the names that sure matches give to what they call, paired by place of block and place within it. target_calls: (bin_faddr, block_pos, in_block, target); library_calls: (object_id, lib_faddr, block_pos, in_block, callee_name)."""
    places = ["block_pos", "in_block"]
    at = sure.join(target_calls.drop("pos"), "bin_faddr").join(library_calls.drop("pos"), ["object_id", "lib_faddr", *places]).where("callee_name IS NOT NULL")
    found = at.select("target", "library", "object_id", "bin_faddr", *places, F.col("callee_name").alias("guessed"))
    # several callers may name one function: the last in order has its way, as later guesses overwrite earlier ones
    last = Window.partitionBy("target").orderBy(F.desc("bin_faddr"), F.desc("block_pos"), F.desc("in_block"))
    return found.withColumn("_k", F.row_number().over(last)).where("_k = 1").select("target", "library", "object_id", "guessed")


def applied(candidates: DataFrame, guessed: DataFrame) -> DataFrame:
    """Candidates after guesses: of several those with the guessed name stay; where none has it, or the only one has another, the guess takes the place."""
    g = guessed.select(F.col("target").alias("bin_faddr"), F.col("library").alias("g_library"), F.col("object_id").alias("g_object"), "guessed")
    at = candidates.join(g, "bin_faddr", "left")
    agrees = F.col("name").eqNullSafe(F.col("guessed"))
    kept = at.where(F.col("guessed").isNull() | agrees).select(candidates.columns)
    fits = at.where(agrees & F.col("guessed").isNotNull()).select("bin_faddr").distinct()
    new = g.join(fits, "bin_faddr", "left_anti").select("bin_faddr", F.col("g_library").alias("library"), F.col("g_object").alias("object_id"), F.lit(None).cast("long").alias("lib_faddr"), F.col("guessed").alias("name"), F.lit(None).cast("double").alias("similarity"), F.lit(True).alias("is_guess"))
    return kept.unionByName(new.select(candidates.columns))


def named_by_callers(candidates: DataFrame, target_calls: DataFrame, library_calls: DataFrame, banned: DataFrame, inside: DataFrame) -> DataFrame:
    """Callees named by sure callers. A round takes the functions that have become sure since the round before, and never one that was taken, as guesses may overwrite."""
    usable = target_calls.join(inside, "target", "left_semi").join(banned, "target", "left_anti")
    rounds = Rounds(candidates.sparkSession)
    current, taken = rounds.settle(candidates, "candidates"), None
    while True:
        sure = current.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("bin_faddr"))).where("_n = 1 AND NOT is_guess").select("bin_faddr", "library", "object_id", "lib_faddr")
        if taken is not None:
            sure = sure.join(taken, "bin_faddr", "left_anti")
        sure = rounds.settle(sure, "sure")
        if not sure.limit(1).count():
            rounds.drop(sure)
            return current
        old = current, taken, sure
        taken = rounds.settle(sure.select("bin_faddr") if taken is None else taken.unionByName(sure.select("bin_faddr")), "taken")
        current = rounds.settle(squished(applied(current, guesses(sure, usable, library_calls)), ["bin_faddr"], "name", ORDER), "candidates")
        rounds.drop(*(x for x in old if x is not None))


def without_used_names(candidates: DataFrame, by: str = "bin_faddr", name: str = "name") -> DataFrame:
    """Functions with several candidates lose those whose name is some function's only one; one pass over one snapshot, which may leave none."""
    marked = candidates.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    used = marked.where("_n = 1").select(name).distinct()
    several = marked.where("_n > 1").join(used, name, "left_anti")
    return marked.where("_n = 1").unionByName(several.select(marked.columns)).drop("_n")
