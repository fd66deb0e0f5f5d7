"""Comparison of two functions: block similarity, block identity, and the matching of their blocks.

The matching is sequential within a pair of functions, so a pair is one row whose two functions travel as nested values,
and pairs are compared in parallel. A function's size bounds what a row holds.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fwlens.operators.attributes import FAR
from fwlens.operators.filters import IGNORED_STATEMENT

Vector = tuple[int, int, int]
VALUE = "value"


def edit_distance(a: list, b: list, same=lambda x, y: x == y) -> int:
    if not a or not b:
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (not same(x, y))))
    return row[-1]


@dataclass
class Block:
    addr: int
    lifted: bool = True
    jumpkind: str = ""
    tags: list[str] = field(default_factory=list)
    operations: list[str] = field(default_factory=list)
    registers: list[int] = field(default_factory=list)
    constants: list[int] = field(default_factory=list)
    instructions: list[int] = field(default_factory=list)
    #: by lifted part the compared statements, each as (tag, leaves of (path, slot, type, value))
    parts: list[list[tuple]] = field(default_factory=list)
    hook: str | None = None
    calls: int = 0


@dataclass
class Function:
    start: int | None
    blocks: dict[int, Block]
    edges: list[tuple[int, int]]
    regions: list[tuple[int, int]] = field(default_factory=list)
    span: tuple[int, int] = (0, 0)

    def __post_init__(self):
        self.after: dict[int, list[int]] = {b: [] for b in self.blocks}
        self.before: dict[int, list[int]] = {b: [] for b in self.blocks}
        for a, b in dict.fromkeys(self.edges):
            self.after[a].append(b)
            self.before[b].append(a)
        self.attributes = self._attributes()

    def holds(self, addr: int) -> bool:
        return any(low <= addr < high for low, high in self.regions)

    @staticmethod
    def _hops(starts: list[int], links: dict[int, list[int]]) -> dict[int, int]:
        dist, todo = dict.fromkeys(starts, 0), deque(starts)
        while todo:
            at = todo.popleft()
            for b in links[at]:
                if b not in dist:
                    dist[b] = dist[at] + 1
                    todo.append(b)
        return dist

    def _attributes(self) -> dict[int, Vector]:
        """Distance from the start, distance to an exit, number of calls."""
        from_start = self._hops([self.start] if self.start in self.blocks else [], self.after)
        sinks = [b for b in self.blocks if not self.after[b]] or ([max(self.blocks)] if self.blocks else [])
        to_exit = self._hops(sinks, self.before)
        return {b: (from_start.get(b, FAR), to_exit.get(b, FAR), x.calls) for b, x in self.blocks.items()}


def nearest(own: dict[int, Vector], others: dict[int, Vector]) -> dict[int, list[int]]:
    """For each of own all the others at the least distance."""
    out = {}
    for k, v in own.items():
        squares = {o: sum((x - y) ** 2 for x, y in zip(v, w, strict=True)) for o, w in others.items()}
        least = min(squares.values(), default=0)
        out[k] = [o for o, s in squares.items() if s == least]
    return out


def changed_constants(a: Block, b: Block) -> list[tuple[str, str]] | None:
    """Pairs of values that differ; None if the blocks differ in anything but values."""
    found = []
    for x, y in zip(a.parts, b.parts, strict=False):
        if len(x) != len(y):
            return None
        for (tag, leaves), (tag2, leaves2) in zip(x, y, strict=True):
            if tag != tag2 or len(leaves) != len(leaves2):
                return None
            for (path, slot, kind, value), (path2, slot2, kind2, value2) in zip(leaves, leaves2, strict=True):
                if (path, slot, kind) != (path2, slot2, kind2):
                    return None
                if value != value2 and not (_nan(value) and _nan(value2)):
                    if slot != VALUE:
                        return None
                    found.append((value, value2))
    return found


def _nan(x: str | None) -> bool:
    return x is not None and x.lower() == "nan"


def _number(x: str) -> float | int | None:
    try:
        return int(x, 0)
    except (TypeError, ValueError):
        try:
            return float(x)
        except (TypeError, ValueError):
            return None


class Diff:
    """The comparison of two functions.

    check_hooks: blocks that are both hooked are compared by their labels; resolve_constants: a changed constant is fine
    if it leads from a block to the block matched with it."""

    def __init__(self, a: Function, b: Function, *, check_hooks: bool = False, resolve_constants: bool = False):
        self.a, self.b, self.check_hooks, self.resolve_constants = a, b, check_hooks, resolve_constants
        self.matches = self._match()

    @property
    def unmatched(self) -> tuple[list[int], list[int]]:
        there = set(self.matches.values())
        return [x for x in self.a.blocks if x not in self.matches], [y for y in self.b.blocks if y not in there]

    def _hooks(self, x: Block, y: Block) -> bool | None:
        return x.hook == y.hook if self.check_hooks and x.hook is not None and y.hook is not None else None

    @staticmethod
    def shifts(x: Block, y: Block) -> set[int]:
        """Differences of constants that the place of the block explains."""
        return {0, y.instructions[0] - x.instructions[0]} if x.instructions and y.instructions else set()

    def similarity_of(self, p: int, q: int) -> float:
        x, y = self.a.blocks[p], self.b.blocks[q]
        if (same := self._hooks(x, y)) is not None:
            return float(same)
        if not x.lifted or not y.lifted:
            return float(x.lifted == y.lifted)
        c = [v for v in x.constants if not self.a.holds(v)]
        d = [v for v in y.constants if not self.b.span[0] <= v < self.b.span[1]]
        shifts = self.shifts(x, y)
        distance = edit_distance(x.tags, y.tags) + edit_distance(x.operations, y.operations) + edit_distance(x.registers, y.registers)
        distance += edit_distance(c, d, lambda u, v: v - u in shifts) + (x.jumpkind != y.jumpkind)
        return 1 - distance / (max(len(x.tags), len(y.tags)) + max(len(c), len(d)) + max(len(x.operations), len(y.operations)) + 1)

    def identical(self, p: int, q: int, constants: bool = False) -> bool:
        x, y = self.a.blocks[p], self.b.blocks[q]
        if (same := self._hooks(x, y)) is not None:
            return same
        if not x.lifted or not y.lifted:
            return x.lifted == y.lifted
        if len(x.parts) != len(y.parts) or (changes := changed_constants(x, y)) is None:
            return False
        return not constants or all(self._explained(_number(u), _number(v), self.shifts(x, y)) for u, v in changes)

    def _explained(self, u, v, shifts: set[int]) -> bool:
        if u is None or v is None:
            return False
        if self.resolve_constants and self.matches.get(u) == v:
            return True
        return self.a.holds(u) and self.b.holds(v) or v - u in shifts

    def _mutual(self, own: dict[int, Vector], others: dict[int, Vector], by_similarity: bool) -> list[tuple[int, int]]:
        """Pairs of which each is the only nearest of the other; ties may be broken by block similarity, of zero at least."""
        near, back = nearest(own, others), nearest(others, own)
        if by_similarity:
            for side, score in ((near, self.similarity_of), (back, lambda q, p: self.similarity_of(p, q))):
                for k, tied in side.items():
                    if len(tied) > 1:
                        scores = [score(k, t) for t in tied]
                        best = max(0.0, *scores)
                        side[k] = [t for t, s in zip(tied, scores, strict=True) if s == best]
        return [(p, near[p][0]) for p in near if len(near[p]) == 1 and back[near[p][0]] == [p]]

    def _match(self) -> dict[int, int]:
        """Matches spread from sure pairs to their neighbours; a pair replaces others only where it is strictly closer. Seeds are taken last to first, pairs found later in the order found."""
        own, others = self.a.attributes, self.b.attributes
        seeds = self._mutual(own, others, False)
        seen, there, back = set(seeds), dict(seeds), {q: p for p, q in seeds}
        todo = deque(reversed(seeds))
        gap = lambda p, q: math.dist(own[p], others[q])
        cut = lambda attributes, some: {k: attributes[k] for k in attributes if k in some}
        while todo:
            p, q = todo.popleft()
            found = []
            if self.identical(p, q) and len(self.a.after[p]) == len(self.b.after[q]):
                found += zip(sorted(self.a.after[p]), sorted(self.b.after[q]), strict=True)
            found += self._mutual(cut(own, set(self.a.after[p])), cut(others, set(self.b.after[q])), True)
            found += self._mutual(cut(own, set(self.a.before[p])), cut(others, set(self.b.before[q])), True)
            for x, y in found:
                if (x, y) in seen:
                    continue
                seen.add((x, y))
                now = gap(x, y)
                if (x in there and now >= gap(x, there[x])) or (y in back and now >= gap(back[y], y)):
                    continue
                if x in there:
                    back.pop(there[x], None)
                if y in back:
                    there.pop(back[y], None)
                there[x], back[y] = y, x
                todo.append((x, y))
        return there

    @property
    def similarity(self) -> float | None:
        """The mean over matched blocks; None without any."""
        scores = [self.similarity_of(p, q) for p, q in self.matches.items()]
        return sum(scores) / len(scores) if scores else None

    @property
    def probably_identical(self) -> bool:
        return not any(self.unmatched) and all(self.identical(p, q, True) for p, q in self.matches.items())

    def identical_blocks(self, constants: bool = False) -> list[tuple[int, int]]:
        return [(p, q) for p, q in self.matches.items() if self.identical(p, q, constants)]

    def differing_blocks(self, constants: bool = False) -> list[tuple[int, int]]:
        return [(p, q) for p, q in self.matches.items() if not self.identical(p, q, constants)]

    def blocks_with_differing_constants(self) -> dict[tuple[int, int], list[tuple[str, str]]]:
        same = set(self.identical_blocks(True))
        return {k: changed_constants(self.a.blocks[k[0]], self.b.blocks[k[1]]) or [] for k in self.identical_blocks() if k not in same}


# functions as rows

def packed_functions(tables, only: DataFrame | None = None) -> DataFrame:
    """(object_id, faddr, body): each function as one nested value. only: (object_id, faddr) that are wanted."""
    keys = ["object_id", "faddr"]
    cut = (lambda df: df.join(only.select(*keys).distinct(), keys, "left_semi")) if only is not None else (lambda df: df)
    statements = cut(tables.statements).where(F.col("tag") != IGNORED_STATEMENT).groupBy(*keys, "baddr")
    statements = statements.agg(F.array_sort(F.collect_list(F.struct("sub_ix", "stmt_ix", "tag", "leaves"))).alias("statements"))
    calls = cut(tables.call_sites).groupBy(*keys, "baddr").agg(F.count(F.lit(1)).cast("int").alias("calls"))
    hooks = tables.hooks.select("object_id", F.col("addr").alias("baddr"), F.col("label").alias("hook"))
    nodes = cut(tables.cfg_nodes).join(statements, [*keys, "baddr"], "left").join(calls, [*keys, "baddr"], "left").join(hooks, ["object_id", "baddr"], "left")
    names = ["baddr", "lift_ok", "n_subblocks", "jumpkind", "tags", "operations", "register_offsets", "constants", "instruction_addrs", "statements", "calls", "hook"]
    blocks = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*names).alias("b")))).alias("blocks"))
    edges = cut(tables.cfg_edges).groupBy(*keys).agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    regions = tables.regions.groupBy("object_id").agg(F.collect_list(F.struct("kind", "min_addr", "max_addr")).alias("regions"))
    spans = tables.objects.select("object_id", F.struct("min_addr", "max_addr").alias("span"))
    own = cut(tables.functions).select(*keys, "startpoint")
    rows = own.join(blocks, keys, "left").join(edges, keys, "left").join(F.broadcast(regions), "object_id", "left").join(F.broadcast(spans), "object_id", "left")
    return rows.select(*keys, F.struct("startpoint", "blocks", "edges", "regions", "span").alias("body"))


def unpacked(body) -> Function:
    listed = lambda x: [] if x is None else list(x)
    blocks = {}
    for entry in listed(body["blocks"]):
        b = entry["b"]
        parts: dict[int, list[tuple]] = {k: [] for k in range(b["n_subblocks"] or 0)}
        for s in listed(b["statements"]):
            parts.setdefault(s["sub_ix"], []).append((s["tag"], [(x["path"], x["slot"], x["ctype"], x["value"]) for x in listed(s["leaves"])]))
        blocks[b["baddr"]] = Block(
            b["baddr"], bool(b["lift_ok"]), b["jumpkind"], listed(b["tags"]), listed(b["operations"]), listed(b["register_offsets"]), listed(b["constants"]), listed(b["instruction_addrs"]),
            [parts[k] for k in sorted(parts)], b["hook"], b["calls"] or 0,
        )
    regions = listed(body["regions"])
    segments = [(r["min_addr"], r["max_addr"]) for r in regions if r["kind"] == "segment"]
    regions = segments or [(r["min_addr"], r["max_addr"]) for r in regions if r["kind"] == "section"]
    edges = [(e["src"], e["dst"]) for e in listed(body["edges"]) if e["src"] in blocks and e["dst"] in blocks]
    span = body["span"]
    return Function(body["startpoint"], blocks, edges, regions, (span["min_addr"], span["max_addr"]) if span is not None else (0, 0))


def compared(pairs: DataFrame, target: DataFrame, library: DataFrame, *, check_hooks: bool = False, resolve_constants: bool = False) -> DataFrame:
    """Pairs (bin_object, bin_faddr, object_id, lib_faddr) with the result of their comparison; target and library are packed functions."""
    keys = ["bin_object", "bin_faddr", "object_id", "lib_faddr"]
    a = target.select(F.col("object_id").alias("bin_object"), F.col("faddr").alias("bin_faddr"), F.col("body").alias("a"))
    b = library.select("object_id", F.col("faddr").alias("lib_faddr"), F.col("body").alias("b"))
    rows = pairs.select(*keys).join(a, keys[:2]).join(b, keys[2:]).select(*keys, "a", "b")
    schema = "bin_object string, bin_faddr long, object_id string, lib_faddr long, identical boolean, similarity double, block_matches array<struct<a: long, b: long>>, unmatched_a array<long>, unmatched_b array<long>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for *key, x, y in frame.itertuples(index=False):
                d = Diff(unpacked(x), unpacked(y), check_hooks=check_hooks, resolve_constants=resolve_constants)
                out.append((*key, d.probably_identical, d.similarity, [{"a": p, "b": q} for p, q in sorted(d.matches.items())], *d.unmatched))
            yield pd.DataFrame(out, columns=[*keys, "identical", "similarity", "block_matches", "unmatched_a", "unmatched_b"])

    return rows.mapInPandas(run, schema)


# the same notions as relational operators, for attribute vectors in tables


def nearest_with_ties(own: DataFrame, others: DataFrame, group: list[str], distance) -> DataFrame:
    """(group, a, b, dist): for each row of own (group, a, va) the rows of others (group, b, vb) at the least distance. Groups are joined by equality; a group is one pair of functions, not a table."""
    pairs = own.join(others, group).withColumn("dist", distance(F.col("va"), F.col("vb")))
    best = Window.partitionBy(*group, "a").orderBy("dist")
    return pairs.withColumn("place", F.rank().over(best)).where("place = 1").select(*group, "a", "b", "dist")


def mutual_nearest(own: DataFrame, others: DataFrame, group: list[str], distance, unique: bool = True) -> DataFrame:
    """Pairs that are among each other's nearest; unique: each the other's only nearest."""
    flip = lambda df, x, y: df.withColumnsRenamed({x: y, f"v{x}": f"v{y}"})
    there = nearest_with_ties(own, others, group, distance)
    back = nearest_with_ties(flip(others, "b", "a"), flip(own, "a", "b"), group, distance).select(*group, F.col("a").alias("b"), F.col("b").alias("a"))
    if unique:
        alone = lambda df, k: df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*group, k))).where("n = 1").drop("n")
        there, back = alone(there, "a"), alone(back, "b")
    return there.join(back, [*group, "a", "b"]).select(*group, "a", "b", "dist")


def unmatched(nodes: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    return nodes.join(matches.select(*keys).distinct(), keys, "left_anti")


def positional_changes(a: DataFrame, b: DataFrame, key: str, place: str, value: str) -> DataFrame:
    """(key, place, value_a, value_b) where two sequences differ, missing places included."""
    left, right = a.select(key, place, F.col(value).alias("value_a")), b.select(key, place, F.col(value).alias("value_b"))
    return left.join(right, [key, place], "full").where(~F.col("value_a").eqNullSafe(F.col("value_b")))
