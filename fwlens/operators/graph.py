"""Graph operators: contraction of call chains, call sites, ordered successors, distances, the inter-object call graph."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fwlens.operators.attributes import FAR
from fwlens.plans.storage import settled

CALL = "Ijk_Call"
#: hops after which the frontiers so far are written together
COMPACT = 16


def contract(heads: dict[int, bool], edges: Iterable[tuple[int, int]]) -> dict[int, list[int]]:
    """For each remaining node the nodes it takes up, in order. A node that ends in a call takes up its only successor while that has no other predecessor and lies behind it; what it takes up may end in anything."""
    after: dict[int, list[int]] = {n: [] for n in heads}
    before: dict[int, int] = dict.fromkeys(heads, 0)
    for a, b in dict.fromkeys(edges):
        after.setdefault(a, []).append(b)
        before[b] = before.get(b, 0) + 1
    taken: set[int] = set()
    out: dict[int, list[int]] = {}
    for head in sorted(heads):
        if head in taken:
            continue
        own, at = [], head
        while heads[head] and len(after[at]) == 1:
            nxt = after[at][0]
            if before.get(nxt, 0) != 1 or nxt <= head or nxt not in heads:
                break
            own += [nxt, *out.pop(nxt, [])]
            taken.add(nxt)
            at = own[-1]
        out[head] = own
    return out


def merged_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(object_id, faddr, baddr, head, place): which block each block of the graph belongs to after contraction. One function's graph is one row's work."""
    keys = ["object_id", "faddr"]
    own = nodes.groupBy(*keys).agg(F.collect_list(F.struct("baddr", (F.col("jumpkind") == CALL).alias("calls"))).alias("nodes"))
    links = edges.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    rows = own.join(links, [F.col(k) == F.col(f"_{k}") for k in keys], "left").select(*keys, "nodes", "edges")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for o, f, n, e in zip(frame["object_id"], frame["faddr"], frame["nodes"], frame["edges"], strict=True):
                pairs = [] if e is None else [(x["src"], x["dst"]) for x in e]
                for head, taken in contract({x["baddr"]: bool(x["calls"]) for x in n}, pairs).items():
                    out += [(o, f, b, head, k) for k, b in enumerate([head, *taken])]
            yield pd.DataFrame(out, columns=["object_id", "faddr", "baddr", "head", "place"])

    return rows.mapInPandas(run, "object_id string, faddr long, baddr long, head long, place int")


def contracted_graph(nodes: DataFrame, edges: DataFrame, call_sites: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and call sites after contraction. The last taken-up block's edges become the head's, without a kind, as new edges have none."""
    where = merged_blocks(nodes, edges)
    keys = ["object_id", "faddr"]
    heads = where.where("place = 0").select(*keys, "baddr")
    last = where.groupBy(*keys, "head").agg(F.max_by("baddr", "place").alias("tail"), F.max("place").alias("taken"))
    kept = nodes.join(heads, [*keys, "baddr"], "left_semi")
    moved = edges.join(last.withColumnRenamed("tail", "src"), [*keys, "src"])
    moved = moved.select(*keys, F.col("head").alias("src"), "dst", F.when(F.col("taken") == 0, F.col("edge_type")).alias("edge_type"))
    sites = call_sites.join(where, [*keys, "baddr"])
    sites = sites.withColumn("order", F.struct("place", "seq"))
    listed = sites.groupBy(*keys, "head").agg(F.min("block_ord").alias("block_ord"), F.array_sort(F.collect_list(F.struct("order", "target"))).alias("calls"))
    again = listed.select(*keys, F.col("head").alias("baddr"), "block_ord", F.posexplode("calls").alias("seq", "call"))
    return kept, moved, again.select(*keys, "baddr", "block_ord", "seq", F.col("call.target").alias("target"))


def call_site_lists(sites: DataFrame, keys: list[str], order: list[str], target: str) -> DataFrame:
    """(keys, targets): the targets of each block or function in the given order."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(target).alias("_target"))))
    return sites.groupBy(*keys).agg(F.transform(listed, lambda x: x["_target"]).alias("targets"))


def ordered_successors(edges: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """(keys, src, successors) by address."""
    return edges.groupBy(*keys, src).agg(F.array_sort(F.collect_set(dst)).alias("successors"))


def hops(starts: DataFrame, edges: DataFrame, keys: list[str], node: str = "node", most: int = FAR) -> DataFrame:
    """(keys, node, dist): the least number of edges (src, dst) from any start, by frontiers; what is not reached is left out."""
    cols = [*keys, node]
    own = settled(edges.select(*keys, F.col("src").alias(node), "dst").distinct(), "edges")
    frontier, step = settled(starts.select(*cols).distinct().withColumn("dist", F.lit(0)), "frontier"), 0
    reached = frontier
    while step < most and frontier.limit(1).count():
        step += 1
        found = frontier.select(*cols).join(own, cols).select(*keys, F.col("dst").alias(node)).distinct()
        frontier = settled(found.join(reached.select(*cols), cols, "left_anti").withColumn("dist", F.lit(step)), "frontier")
        reached = reached.unionByName(frontier)
        if step % COMPACT == 0:
            reached = settled(reached, "hops")
    return reached


def exits(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """Nodes without successors, or where a graph has none the node of highest address."""
    sinks = nodes.select(*keys, node).distinct().join(edges.select(*keys, F.col("src").alias(node)).distinct(), [*keys, node], "left_anti")
    if not keys:
        return sinks if sinks.limit(1).count() else nodes.agg(F.max(node).alias(node))
    last = nodes.join(sinks.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.max(node).alias(node))
    return sinks.unionByName(last)


def distances(nodes: DataFrame, starts: DataFrame, edges: DataFrame, keys: list[str], node: str = "node") -> DataFrame:
    """(keys, node, dist) for all nodes, FAR where none of the starts leads."""
    return nodes.select(*keys, node).distinct().join(hops(starts, edges, keys, node), [*keys, node], "left").withColumn("dist", F.coalesce("dist", F.lit(FAR)))


def reverse(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))


# the call graph between objects


def exported(symbols: DataFrame, functions: DataFrame) -> DataFrame:
    """Function symbols that have a function at their address: (name, object_id, faddr, is_weak)."""
    own = symbols.where("is_function AND NOT coalesce(is_extern, false)").select("name", "object_id", F.col("rebased_addr").alias("faddr"), F.coalesce("is_weak", F.lit(False)).alias("is_weak"))
    return own.join(functions.select("object_id", "faddr"), ["object_id", "faddr"], "left_semi").select("name", "object_id", "faddr", "is_weak")


def collisions(names: DataFrame) -> DataFrame:
    """(name, n) of strong names that several functions export."""
    return names.where("NOT is_weak").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class NameCollision(ValueError):
    pass


def symbol_map(names: DataFrame) -> DataFrame:
    """(name, object_id, faddr) with one function for each name, strong before weak; raises NameCollision for two strong ones."""
    if clash := collisions(names).orderBy("name").first():
        raise NameCollision(f"{clash['name']} is exported {clash['n']} times")
    return names.groupBy("name").agg(F.min_by(F.struct("object_id", "faddr"), F.struct("is_weak", "object_id", "faddr")).alias("f")).select("name", "f.object_id", "f.faddr")


def inter_object_calls(callgraph: DataFrame, stubs: DataFrame, names: DataFrame) -> DataFrame:
    """(src_object, src, dst_object, dst): calls inside an object, and calls to a stub (object_id, faddr, name) led to the function of that name; unknown names are dropped."""
    at = callgraph.join(stubs.select("object_id", F.col("faddr").alias("callee"), F.col("name").alias("stub")), ["object_id", "callee"], "left")
    inside = at.where("stub IS NULL").select(F.col("object_id").alias("src_object"), F.col("caller").alias("src"), F.col("object_id").alias("dst_object"), F.col("callee").alias("dst"))
    known = names.select(F.col("name").alias("stub"), F.col("object_id").alias("dst_object"), F.col("faddr").alias("dst"))
    across = at.where("stub IS NOT NULL").join(known, "stub").select(F.col("object_id").alias("src_object"), F.col("caller").alias("src"), "dst_object", "dst")
    return inside.unionByName(across).distinct()


def function_by_name(names: DataFrame, name: str) -> DataFrame:
    return names.where(F.col("name") == name)
