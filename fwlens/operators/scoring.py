"""Classification of results, accuracy against known symbols, neighbours in address order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classified(targets: DataFrame, candidates: DataFrame, viable: DataFrame) -> DataFrame:
    """(addr, n, is_guess, name, class): class is collision, junk, matched or nothing. targets and viable: (addr); candidates: (addr, name, is_guess)."""
    each = candidates.groupBy("addr").agg(F.count(F.lit(1)).alias("n"), F.max("is_guess").alias("is_guess"), F.min("name").alias("name"))
    at = targets.join(each, "addr", "left").join(viable.select("addr").withColumn("_viable", F.lit(True)), "addr", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kind = F.when(F.col("n") > 1, "collision").when(F.col("_viable").isNull(), "junk").when(F.col("n") == 1, "matched").otherwise("nothing")
    return at.select("addr", "n", F.coalesce("is_guess", F.lit(False)).alias("is_guess"), "name", kind.alias("class"))


def result_map(classes: DataFrame) -> DataFrame:
    return classes.where("class = 'matched'").select("addr", "name")


def class_counts(classes: DataFrame) -> DataFrame:
    of = lambda c: F.count_if(F.col("class") == c)
    return classes.agg(of("collision").alias("collisions"), of("junk").alias("junk"), of("matched").alias("matched"), F.count_if((F.col("class") == "matched") & F.col("is_guess")).alias("guesses"))


def outcomes(symbols: DataFrame, candidates: DataFrame, known: DataFrame, banned: DataFrame) -> DataFrame:
    """(addr, symbol, outcome, guessed) of each true symbol.

    A symbol whose name the database lacks is ignored if its function has one candidate, else unscorable. Others are junk
    at a banned address, missing without candidates, imprecise with several, and with one precise or incorrect: precise
    if any symbol at the address has the candidate's name. guessed: the only candidate is a guess. symbols: (addr,
    symbol); candidates: (addr, name, is_guess); known: (name); banned: (addr)."""
    each = candidates.groupBy("addr").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"), F.max("is_guess").alias("is_guess"))
    here = symbols.groupBy("addr").agg(F.collect_set("symbol").alias("true_names"))
    at = symbols.join(here, "addr").join(each, "addr", "left").join(banned.select("addr").distinct().withColumn("_ban", F.lit(True)), "addr", "left")
    at = at.join(known.select(F.col("name").alias("symbol")).distinct().withColumn("_known", F.lit(True)), "symbol", "left")
    n = F.coalesce("n", F.lit(0))
    guessed = (n == 1) & F.coalesce("is_guess", F.lit(False))
    kind = (
        F.when(F.col("_known").isNull(), F.when((n == 1) & ~guessed, "ignored").otherwise("unscorable"))
        .when(F.col("_ban").isNotNull(), "ignored")
        .when(n == 0, "missing")
        .when(n > 1, "imprecise")
        .when(F.array_contains("true_names", F.col("name")), "precise")
        .otherwise("incorrect")
    )
    return at.select("addr", "symbol", kind.alias("outcome"), guessed.alias("guessed"))


def score(results: DataFrame, symbols: DataFrame, known: DataFrame, phase: str = "final") -> DataFrame:
    """Counters of symbols, and rates over the number of distinct scorable names, null without any."""
    of = lambda c: F.count_if(F.col("outcome") == c).alias(c)
    counters = results.agg(of("precise"), of("missing"), of("incorrect"), of("imprecise"), F.count_if("guessed").alias("guesses"), of("ignored"))
    total = symbols.select(F.col("symbol").alias("name")).intersect(known.select("name")).agg(F.count(F.lit(1)).alias("total"))
    rate = lambda c: F.try_divide(F.col(c).cast("double"), F.col("total").cast("double"))
    return counters.join(total, F.lit(True)).select(F.lit(phase).alias("phase"), "*", rate("precise").alias("hit_rate"), rate("incorrect").alias("error_rate"), rate("imprecise").alias("collision_rate"))


def names_by_address(symbols: DataFrame, addr: str = "addr", name: str = "symbol") -> DataFrame:
    return symbols.groupBy(addr).agg(F.array_sort(F.collect_list(name)).alias("names"))


def neighbours(matches: DataFrame, group: list[str], addr: str, name: str, count: str) -> DataFrame:
    """Each row with the names before and after it in the order of addresses, if those rows have exactly one candidate."""
    order = Window.partitionBy(*group).orderBy(addr)
    one = F.when(F.col(count) == 1, F.col(name))
    return matches.withColumn("previous", F.lag(one).over(order)).withColumn("next", F.lead(one).over(order))


def report(results: DataFrame, candidates: DataFrame) -> DataFrame:
    """Readable lines of a score: one for each symbol that counts."""
    names = candidates.groupBy("addr").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("found"))
    return results.join(names, "addr", "left").select("addr", F.format_string("%s 0x%x %s: %s", F.upper("outcome"), F.col("addr"), F.col("symbol"), F.coalesce("found", F.lit("-"))).alias("line"))
