"""The older whole-binary matching: functions of two binaries by mutual nearest attributes, spread along calls."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fwlens.operators.function_diff import Vector, nearest


def call_site_pairs(a: DataFrame, b: DataFrame, group: list[str]) -> DataFrame:
    """(group, x, y): call targets paired by place from the start and by place from the end. a: (group, targets), b: (group, others)."""
    both = a.join(b, group)
    n = F.least(F.size("targets"), F.size("others"))
    front = F.arrays_zip(F.slice("targets", F.lit(1), n).alias("x"), F.slice("others", F.lit(1), n).alias("y"))
    back = F.arrays_zip(F.slice(F.reverse("targets"), F.lit(1), n).alias("x"), F.slice(F.reverse("others"), F.lit(1), n).alias("y"))
    listed = lambda pairs: both.select(*group, F.explode(pairs).alias("p")).select(*group, "p.x", "p.y")
    return listed(front).unionByName(listed(back)).distinct()


def spread(own: dict[int, Vector], others: dict[int, Vector], calls_a: dict[int, list[int]], calls_b: dict[int, list[int]]) -> dict[int, int]:
    """Matches of functions: mutual nearest seeds in order of address, then their callers and callees, and call targets by place from both ends; a pair replaces others only where it is strictly closer."""

    def mutual(x: dict[int, Vector], y: dict[int, Vector]) -> list[tuple[int, int]]:
        near, back = nearest(x, y), nearest(y, x)
        return [(p, q) for p in sorted(near) for q in sorted(near[p]) if p in back[q]]

    def callers(calls: dict[int, list[int]]) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for f, targets in calls.items():
            for t in dict.fromkeys(targets):
                out.setdefault(t, []).append(f)
        return out

    by_a, by_b = callers(calls_a), callers(calls_b)
    gap = lambda p, q: math.dist(own[p], others[q])
    there: dict[int, int] = {}
    back: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()
    todo: deque[tuple[int, int]] = deque()

    def offer(pairs: Iterable[tuple[int, int]]) -> None:
        for p, q in pairs:
            if (p, q) in seen or p not in own or q not in others:
                continue
            seen.add((p, q))
            d = gap(p, q)
            if (p in there and d >= gap(p, there[p])) or (q in back and d >= gap(back[q], q)):
                continue
            if p in there:
                back.pop(there[p], None)
            if q in back:
                there.pop(back[q], None)
            there[p], back[q] = q, p
            todo.append((p, q))

    cut = lambda attributes, some: {k: attributes[k] for k in some if k in attributes}
    offer(mutual(own, others))
    while todo:
        p, q = todo.popleft()
        x, y = calls_a.get(p, []), calls_b.get(q, [])
        offer(mutual(cut(own, x), cut(others, y)))
        offer(mutual(cut(own, by_a.get(p, [])), cut(others, by_b.get(q, []))))
        offer([*zip(x, y, strict=False), *zip(reversed(x), reversed(y), strict=False)])
    return there


def binary_diff(pairs: DataFrame, attributes: DataFrame, calls: DataFrame) -> DataFrame:
    """(a_object, b_object, a, b): matched functions of each pair of binaries. attributes: (object_id, faddr, n_blocks, n_edges, n_calls); calls: (object_id, faddr, targets). A pair of binaries is one row."""
    one = attributes.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("faddr", "n_blocks", "n_edges", "n_calls"))).alias("functions"))
    sites = calls.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("faddr", "targets"))).alias("calls"))
    body = one.join(sites, "object_id", "left")
    side = lambda c: body.select(F.col("object_id").alias(f"{c}_object"), F.col("functions").alias(f"{c}_functions"), F.col("calls").alias(f"{c}_calls"))
    rows = pairs.select("a_object", "b_object").join(side("a"), "a_object").join(side("b"), "b_object").select("a_object", "b_object", "a_functions", "a_calls", "b_functions", "b_calls")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = lambda x: {r["faddr"]: (r["n_blocks"], r["n_edges"], r["n_calls"]) for r in x}
        targets = lambda x: {} if x is None else {r["faddr"]: list(r["targets"]) for r in x}
        for frame in frames:
            out = []
            for a, b, fa, ca, fb, cb in frame.itertuples(index=False):
                out += [(a, b, p, q) for p, q in sorted(spread(vectors(fa), vectors(fb), targets(ca), targets(cb)).items())]
            yield pd.DataFrame(out, columns=["a_object", "b_object", "a", "b"])

    return rows.mapInPandas(run, "a_object string, b_object string, a long, b long")


def name_matches(a: DataFrame, b: DataFrame, name: str = "name", addr: str = "addr") -> DataFrame:
    """(name, a, b) of functions of equal, given names (not ``sub_``); of several of one name the last address counts."""
    last = lambda df, c: df.where(~F.startswith(F.col(name), F.lit("sub_"))).groupBy(name).agg(F.max(addr).alias(c))
    return last(a, "a").join(last(b, "b"), name)


def plt_matches(a: DataFrame, b: DataFrame, nodes_a: DataFrame, nodes_b: DataFrame) -> DataFrame:
    """(name, a, b) of import stubs of equal name that occur in both call graphs. a, b: (name, addr); nodes: (addr)."""
    one = a.join(nodes_a, "addr", "left_semi").select("name", F.col("addr").alias("a"))
    return one.join(b.join(nodes_b, "addr", "left_semi").select("name", F.col("addr").alias("b")), "name")


def signature_matches(matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """(addr, name, bin_addr) of a signature's symbols, with the function matched to each or null. matches: (bin_addr, lib_addr)."""
    return symbols.join(matches.select(F.col("lib_addr").alias("addr"), "bin_addr"), "addr", "left")


def match_rate(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, matched, unmatched, rate) of signatures' symbols."""
    hit = F.col("bin_addr").isNotNull()
    return found.groupBy(*by).agg(F.count_if(hit).alias("matched"), F.count_if(~hit).alias("unmatched"), F.avg(hit.cast("double")).alias("rate"))


def matching_signatures(rates: DataFrame) -> DataFrame:
    return rates.where("rate > 0")


def library_statistics(matched: DataFrame, functions_a: DataFrame, functions_b: DataFrame, banned: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_matched, n_smaller, rate): matched functions over those of the smaller side that are not banned."""
    count = lambda df, c: df.join(banned, [*by, "faddr"], "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias(c))
    n = matched.groupBy(*by).agg(F.count(F.lit(1)).alias("n_matched"))
    both = count(functions_a, "n_a").join(count(functions_b, "n_b"), by).join(n, by, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    smaller = F.least("n_a", "n_b")
    return both.select(*by, "n_matched", smaller.alias("n_smaller"), F.try_divide(F.col("n_matched").cast("double"), smaller.cast("double")).alias("rate"))


def harness_accuracy(library: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: library functions whose name the binary has (possible), and of these the ones whose true address is among their matches (correct). library: (faddr, name); truth: (name, addr); matches: (faddr, addr)."""
    known = library.join(truth, "name")
    right = known.join(matches, ["faddr", "addr"], "left_semi").select("faddr").distinct().withColumn("_right", F.lit(True))
    each = known.select("faddr").distinct().join(right, "faddr", "left")
    return each.agg(F.count(F.lit(1)).alias("possible"), F.count_if(F.col("_right").isNotNull()).alias("correct"))
