"""Comparison of all functions of a group with each other, without a row for each pair.

The functions of a group travel once for each tile they belong to and are unpacked once there. Where the blocks of both
functions have the same attribute vectors, all distinct, each block's only nearest is the one with its vector, at distance
zero, and no later pair can be strictly closer: so the matching is known, and all pairs are compared at once, block by
block. Other pairs, and those with hooks to compare, constants to resolve or values that are no 62-bit integers, are compared one by
one by `Diff`. Both give the same figures."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fwlens.operators.function_diff import VALUE, Block, Diff, Function, _nan, _number, edit_distance, unpacked
from fwlens.plans.storage import settled

#: functions of a side in a tile
TILE = 512
LARGE = 1 << 62


class Numbered(dict):
    """Numbers things in the order met."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def _structure(x: Block) -> tuple:
    """All that identity compares but the values that may change."""
    leaf = lambda p, s, k, v: (p, s, k, "" if s == VALUE else "nan" if _nan(v) else v)
    return tuple(tuple((tag, tuple(leaf(*y) for y in leaves)) for tag, leaves in part) for part in x.parts)


def _values(x: Block) -> list:
    return ["nan" if _nan(v) else v for part in x.parts for _, leaves in part for _, s, _, v in leaves if s == VALUE]


def _plain(f: Function, check_hooks: bool) -> bool:
    """Can the blocks be matched by their attributes, and compared as 64-bit integers?"""
    if not f.blocks or len(set(f.attributes.values())) < len(f.blocks):
        return False
    small = lambda v: v is None or (isinstance(v, int) and -LARGE < v < LARGE)
    return all(
        not (check_hooks and x.hook is not None) and all(v is not None and small(v) for v in x.constants) and (not x.instructions or (x.instructions[0] is not None and small(x.instructions[0]))) and all(small(_number(v)) for v in _values(x))
        for x in f.blocks.values()
    )


def _distances(xs: list[list], ys: list[list]) -> np.ndarray:
    """Edit distances of each of xs to each of ys; equal lists are compared once."""
    p, q = Numbered(), Numbered()
    i, j = [p[tuple(x)] for x in xs], [q[tuple(y)] for y in ys]
    return np.array([[edit_distance(x, y) for y in q] for x in p])[np.ix_(i, j)]


def _lengths(xs: list[list], ys: list[list]) -> np.ndarray:
    return np.maximum.outer(np.array([len(x) for x in xs]), np.array([len(y) for y in ys]))


def _compared_blocks(xs: list[Block], ys: list[Block], own: list[Function], others: list[Function]) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, identity) of each of xs, blocks of own, with each of ys, blocks of others."""
    lifted, lifted2 = np.array([x.lifted for x in xs]), np.array([y.lifted for y in ys])
    both, same = lifted[:, None] & lifted2, lifted[:, None] == lifted2
    firsts = lambda zs: np.array([z.instructions[0] if z.instructions else 0 for z in zs], np.int64)
    placed = np.array([bool(x.instructions) for x in xs])[:, None] & np.array([bool(y.instructions) for y in ys])
    shift = firsts(ys) - firsts(xs)[:, None]

    c = [[v for v in x.constants if not f.holds(v)] for x, f in zip(xs, own, strict=True)]
    d = [[v for v in y.constants if not f.span[0] <= v < f.span[1]] for y, f in zip(ys, others, strict=True)]
    n, m = np.array([len(x) for x in c]), np.array([len(y) for y in d])
    longest = np.maximum.outer(n, m)
    moved = np.array([y[0] if y else 0 for y in d], np.int64) - np.array([x[0] if x else 0 for x in c], np.int64)[:, None]
    distance = np.where((n == 1)[:, None] & (m == 1), ~(placed & ((moved == 0) | (moved == shift))), longest)
    for i, j in zip(*np.nonzero((n > 0)[:, None] & (m > 0) & (longest > 1)), strict=True):
        shifts = Diff.shifts(xs[i], ys[j])
        distance[i, j] = edit_distance(c[i], d[j], lambda u, v, shifts=shifts: v - u in shifts)
    tags, tags2, operations, operations2 = ([getattr(z, k) for z in zs] for k in ("tags", "operations") for zs in (xs, ys))
    distance = distance + _distances(tags, tags2) + _distances(operations, operations2) + _distances([x.registers for x in xs], [y.registers for y in ys])
    kinds = Numbered()
    distance = distance + (np.array([kinds[x.jumpkind] for x in xs])[:, None] != np.array([kinds[y.jumpkind] for y in ys]))
    similarity = np.where(both, 1 - distance / (_lengths(tags, tags2) + longest + _lengths(operations, operations2) + 1), same.astype(float))

    structures = Numbered()
    s, s2 = np.array([structures[_structure(x)] for x in xs]), np.array([structures[_structure(y)] for y in ys])
    identical = s[:, None] == s2
    values, values2 = [_values(x) for x in xs], [_values(y) for y in ys]
    for k in np.unique(s):
        i, j = np.flatnonzero(s == k), np.flatnonzero(s2 == k)
        if not len(j):
            continue
        at = np.ix_(i, j)
        for place in range(len(values[i[0]])):
            texts = Numbered()
            sides = []
            for rows, found, functions in ((i, values, own), (j, values2, others)):
                text = [found[r][place] for r in rows]
                number = [_number(v) for v in text]
                sides.append((
                    np.array([texts[v] for v in text]), np.array([v is not None for v in number]), np.array([v or 0 for v in number], np.int64),
                    np.array([v is not None and functions[r].holds(v) for r, v in zip(rows, number, strict=True)]),
                ))
            (t, known, u, inside), (t2, known2, v, inside2) = sides
            gap = v - u[:, None]
            explained = (inside[:, None] & inside2) | (placed[at] & ((gap == 0) | (gap == shift[at])))
            identical[at] &= (t[:, None] == t2) | (known[:, None] & known2 & explained)
    return similarity, np.where(both, identical, same)


def identical_in_tile(own: list[Function], others: list[Function], *, check_hooks: bool = False, resolve_constants: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of the functions that are probably identical; the similarity of functions without blocks is nan."""
    plain, plain2 = ([not resolve_constants and _plain(f, check_hooks) for f in fs] for fs in (own, others))
    orders, sets = defaultdict(list), defaultdict(list)
    for i, f in enumerate(own):
        if plain[i]:
            orders[tuple(f.attributes.values())].append(i)
    for j, f in enumerate(others):
        if plain2[j]:
            sets[frozenset(f.attributes.values())].append(j)
    found, done = [], np.zeros((len(own), len(others)), bool)
    for order, i in orders.items():
        j = sets.get(frozenset(order), [])
        if not j:
            continue
        done[np.ix_(i, j)] = True
        a, b = [own[k] for k in i], [others[k] for k in j]
        by_vector = [{v: f.blocks[k] for k, v in f.attributes.items()} for f in b]
        identical, total, rest = np.ones((len(i), len(j)), bool), np.zeros((len(i), len(j))), np.zeros((len(i), len(j)))
        blocks = [[*f.blocks.values()] for f in a]
        for place, vector in enumerate(order):
            similarity, same = _compared_blocks([x[place] for x in blocks], [x[vector] for x in by_vector], a, b)
            identical &= same
            # as sum() adds floats up
            after = total + similarity
            rest += np.where(np.abs(total) >= np.abs(similarity), (total - after) + similarity, (similarity - after) + total)
            total = after
        p, q = np.nonzero(identical)
        found.append((np.array(i)[p], np.array(j)[q], ((total + rest) / len(order))[p, q]))
    one = []
    for i, j in zip(*np.nonzero(~done), strict=True):
        d = Diff(own[i], others[j], check_hooks=check_hooks, resolve_constants=resolve_constants)
        if d.probably_identical:
            one.append((i, j, np.nan if (s := d.similarity) is None else s))
    if one:
        i, j, s = zip(*one, strict=True)
        found.append((np.array(i), np.array(j), np.array(s, float)))
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def identical_pairs(target: DataFrame, library: DataFrame, *, check_hooks: bool = False, resolve_constants: bool = False) -> DataFrame:
    """(bin_object, bin_faddr, object_id, lib_faddr, similarity): pairs of one group that are probably identical. target and library: (object_id, faddr, group, body)."""
    sides = [settled(df.select("object_id", "faddr", "group", "body"), "packed") for df in (target, library)]
    chunks = [df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias(f"n{s}")) for s, df in enumerate(sides)]
    grid = settled(chunks[0].join(chunks[1], "group"), "chunks")
    spread = []
    for s, df in enumerate(sides):
        dealt = df.join(grid, "group").withColumn("own", F.pmod(F.xxhash64("object_id", "faddr"), F.col(f"n{s}")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col(f"n{1 - s}") - 1)))
        spread.append(dealt.select("group", F.col("own" if s == 0 else "other").alias("i"), F.col("other" if s == 0 else "own").alias("j"), F.lit(s).alias("side"), "object_id", "faddr", "body"))
    key = ["group", "i", "j"]
    rows = spread[0].unionByName(spread[1]).repartition(*key).sortWithinPartitions(*key)
    schema = "bin_object string, bin_faddr long, object_id string, lib_faddr long, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [])

        def close() -> pa.RecordBatch:
            i, j, similarity = identical_in_tile(*([f for _, _, f in side] for side in held), check_hooks=check_hooks, resolve_constants=resolve_constants)
            ids = [(pa.array([o for o, _, _ in side], pa.string()).take(pa.array(k)), pa.array([f for _, f, _ in side], pa.int64()).take(pa.array(k))) for side, k in zip(held, (i, j), strict=True)]
            return pa.RecordBatch.from_arrays([*ids[0], *ids[1], pa.array(similarity, mask=np.isnan(similarity))], names=["bin_object", "bin_faddr", "object_id", "lib_faddr", "similarity"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    tile = tuple(row[c] for c in key)
                    if tile != at and at is not None:
                        yield close()
                        held = ([], [])
                    at = tile
                    held[row["side"]].append((row["object_id"], row["faddr"], unpacked(row["body"])))
        if at is not None:
            yield close()

    return rows.mapInArrow(run, schema)
