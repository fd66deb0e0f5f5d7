"""Packing of token sequences by a configuration linear program over the histogram of lengths.

A configuration says how many pieces of each length share one sequence. The program asks for the fewest configurations
that cover the histogram. Multiplicative weights solve it: a length's price falls exponentially with the coverage of its
class of lengths, and a knapsack dynamic program finds the dearest configurations, which then take a share of the
solution, rounded down to whole sequences. Rounds go on until no full configuration is left and at most REST of the
tokens remain; those are packed by best fit, longest first, into sequences with room and new ones. The weights also give
a lower bound, from the dual program; the plan with the fewest sequences over a few settings is kept.

The plan's size depends on the capacity only, so it is made on the driver; the pieces, however many, are placed by
arithmetic from their rank among those of the same length. Ranks come from windows over (length, salt), with more salts
for lengths that hold more pieces, so a length that holds a large share of all pieces is no single task's work. Pieces
that fill a sequence alone need no rank.

Defined results: a null text is the empty text, which still has its end id; documents longer than the capacity are cut
into full pieces, the last may be shorter; repeated rows and rows without an id are all packed; ties between pieces of
one length are broken by the order in which they were written; an empty table gives no rows; further columns of the
input are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_vocabulary
from .common import ids_and_texts, map_arrow, stored, table
from .library_tokens import encoder_of

CAPACITY = 2048
#: pieces of one length that one task ranks: this share of all pieces, RANKED at the most
RANK_SHARE, RANKED = 1 / 512, 1 << 18
#: tilt of the first prices towards long pieces, how fast coverage lowers a price, and whether full configurations come first
SETTINGS = ((0.3, 0.3, True), (0.5, 1.0, True), (1.0, 0.3, False))
CLASSES, STEP, SHARE, TRIES, ACCEPT = 32, 0.02, 0.125, 200, 0.98
#: the most that is left to best fit, as a share of the tokens
REST = 0.04
NONE = -1e18

Pattern = tuple[tuple[int, int], ...]  # (length, copies)


def fills(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the highest price of any multiset of lengths (ascending) that fills each size exactly, NONE where none does."""
    value, fit = np.full(capacity + 1, NONE), np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    value[0] = 0.0
    for c in range(int(lengths[0]), capacity + 1):
        value[c] = (value[c - lengths[: fit[c]]] + prices[: fit[c]]).max()
    return value


def drawn(first: int, value: np.ndarray, prices: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int, exact: bool) -> dict[int, int] | None:
    """The dearest configuration that holds length number `first`, of pieces that are left; None if they ran out on the way."""
    config: dict[int, int] = defaultdict(int)
    there, c, k, price = left > 0, capacity, first, 0.0
    while True:
        config[k] += 1
        price += prices[k]
        c -= int(lengths[k])
        if config[k] >= left[k]:
            there[k] = False
        n = int(np.searchsorted(lengths, c, side="right"))
        if not n or not there[:n].any():
            break
        gain = np.where(there[:n], value[c - lengths[:n]] + prices[:n], 2 * NONE)
        k = int(gain.argmax())
        if gain[k] < NONE / 2:
            return None
    hoped = value[capacity - int(lengths[first])] + prices[first]
    return dict(config) if (c == 0 if exact else price >= ACCEPT * hoped) else None


def dearest(prices: np.ndarray, lengths: np.ndarray, left: np.ndarray, capacity: int, exact: bool) -> dict[int, int] | None:
    """The dearest configuration with no length more often than it is left; exact: None unless it fills the capacity."""
    value, items, took = np.full(capacity + 1, NONE), [], []
    value[0] = 0.0
    for k, size in enumerate(lengths.tolist()):
        n, copies = min(int(left[k]), capacity // size), 1
        while n > 0:
            copies = min(copies, n)
            n -= copies
            new = value[: capacity + 1 - copies * size] + copies * prices[k]
            better = new > value[copies * size :]
            mark = np.zeros(capacity + 1, bool)
            mark[copies * size :] = better
            value[copies * size :] = np.where(better, new, value[copies * size :])
            items.append((k, copies))
            took.append(mark)
            copies *= 2
    c = capacity if exact else capacity - int(value[::-1].argmax())
    if value[c] < NONE / 2:
        return None
    config: dict[int, int] = defaultdict(int)
    for (k, copies), mark in zip(reversed(items), reversed(took), strict=True):
        if mark[c]:
            config[k] += copies
            c -= copies * int(lengths[k])
    return dict(config)


def configurations(histogram: dict[int, int], capacity: int, tilt: float, eta: float, exact: bool = True, rest: float = REST) -> tuple[dict[Pattern, int], dict[int, int], int]:
    """(configurations in whole numbers, lengths left over, lower bound of the program).

    Lengths fall into classes of equal mass, whose coverage sets the weights. A round prices all lengths, solves the
    knapsack once and takes the dearest configuration of one length after another, each for a share of its demand
    rounded down to whole sequences, until STEP of all tokens are covered; then prices are set anew. exact: full configurations come
    first, others when there are none left. What is left over is at most `rest` of the tokens."""
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    mass = (lengths * demand).astype(float)
    total = mass.sum()
    group = np.minimum(((np.cumsum(mass) - mass / 2) * CLASSES / total).astype(int), CLASSES - 1)
    masses = np.maximum(np.bincount(group, mass, CLASSES), 1)
    left, bound = demand.copy(), 0
    used: dict[Pattern, int] = defaultdict(int)
    while float(lengths @ left) > rest * total or (exact and left.any()):
        open_ = np.flatnonzero(left)
        size, asked, free = lengths[open_], demand[open_], left[open_].copy()
        covered = 1 - np.bincount(group, lengths * left, CLASSES) / masses
        prices = (size / capacity) ** (1.0 + tilt) * np.exp(-eta * covered[group[open_]])
        value = fills(prices, size, capacity)
        if not used:
            # weights of lengths give a solution of the dual program when no configuration is dearer than 1
            bound = max(math.ceil(total / capacity - 1e-9), math.ceil(float(asked @ prices) / value.max() - 1e-6))
        if not exact:
            value = np.maximum.accumulate(value)
        hoped = value[capacity - size] + prices
        found, tries, room = 0, 0, max(1.0, STEP * total / capacity)
        for k in np.argsort(-hoped, kind="stable").tolist():
            if hoped[k] < NONE / 2 or found >= room or tries > TRIES:
                break
            if not free[k]:
                continue
            config = drawn(k, value, prices, size, free, capacity, exact)
            if config is None:
                tries += 1
                continue
            found += _take(config, size, asked, free, used)
        if not found:
            config = dearest(prices, size, free, capacity, exact)
            if config is None:
                exact = False
                continue
            _take(config, size, asked, free, used)
        left[open_] = free
    return used, {int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}, bound


def _take(config: dict[int, int], size: np.ndarray, asked: np.ndarray, free: np.ndarray, used: dict[Pattern, int]) -> int:
    """Use a configuration for a share of its lengths' demand, as far as they are left."""
    n = min(int(free[k]) // m for k, m in config.items())
    n = min(n, max(1, int(SHARE * min(int(asked[k]) / m for k, m in config.items()))))
    for k, m in config.items():
        free[k] -= n * m
    used[tuple(sorted(((int(size[k]), m) for k, m in config.items()), reverse=True))] += n
    return n


def best_fit(histogram: dict[int, int], capacity: int, opened: dict[Pattern, int] | None = None) -> dict[Pattern, int]:
    """Best fit, longest first, over counts, into opened sequences and new ones: sequences with equal contents are handled together."""
    rooms: list[list] = [[] for _ in range(capacity + 1)]  # by free room: [contents, sequences]
    held = np.zeros(capacity + 1, bool)
    for config, m in (opened or {}).items():
        free = capacity - sum(k * n for k, n in config)
        rooms[free].append([config, m])
        held[free] = True
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            k = size + int(held[size:].argmax())
            if held[k]:
                contents, m = rooms[k].pop()
                held[k] = bool(rooms[k])
            else:
                contents, m, k = (), -(-n // (capacity // size)), capacity
            copies = min(k // size, -(-n // m))
            take = min(m, n // copies)
            if take < m and contents:
                rooms[k].append([contents, m - take])
                held[k] = True
            rooms[k - copies * size].append([(*contents, (size, copies)), take])
            held[k - copies * size] = True
            n -= take * copies
    out: dict[Pattern, int] = defaultdict(int)
    for groups in rooms:
        for contents, m in groups:
            if contents:
                out[contents] += m
    return dict(out)


@dataclass
class Plan:
    chosen: list[tuple[Pattern, int]]
    #: no packing needs fewer sequences
    bound: int
    #: share of the tokens that configurations of the program place
    share: float

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.chosen)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations and how many sequences follow each; together they hold the histogram exactly. Full pieces are sequences of their own. The program runs with one setting after another until one meets the bound; the best plan is taken."""
    alone = histogram.get(capacity, 0)
    asked = {k: n for k, n in histogram.items() if k < capacity and n}
    full = [(((capacity, 1),), alone)] if alone else []
    total = sum(k * n for k, n in asked.items())
    best = Plan(full, alone, 1.0)
    for i, setting in enumerate(SETTINGS if asked else ()):
        used, rest, bound = configurations(asked, capacity, *setting)
        closed = {c: n for c, n in used.items() if sum(k * m for k, m in c) == capacity}
        opened = {c: n for c, n in used.items() if c not in closed}
        chosen = sorted([*closed.items(), *best_fit(rest, capacity, opened).items()])
        placed = 1 - sum(k * n for k, n in rest.items()) / total
        found = Plan(full + chosen, alone + max(bound, best.bound - alone), placed)
        if not i or found.sequences < best.sequences:
            best = found
        if best.sequences <= found.bound:
            break
    return best


def places(chosen: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each length the stretches of ranks that a configuration takes: where the stretch begins, its first sequence, its number of sequences, the offset of the first copy."""
    rows, ranks, first = [], defaultdict(int), 0
    for config, n in chosen:
        offset = 0
        for size, copies in config:
            rows.append((size, ranks[size], first, n, offset))
            ranks[size] += n * copies
            offset += size * copies
        first += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "first", "n", "offset"), columns.T, strict=True))


def pieces(df: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode the texts, add the end id and cut: (row, doc_id, piece, start, length, ids_crc32[, ids]); row is a number of its own for each piece, fixed once the pieces are stored."""
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = encoder_of(content), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, docs, texts = [], batch.column("doc_id").to_pylist(), batch.column("text")
            for a in range(0, len(docs), 512):
                flat, counts = encoder.encode(texts.slice(a, 512).to_pylist())
                at = 0
                for doc, n in zip(docs[a : a + 512], counts.tolist(), strict=True):
                    own = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for k in range(0, n + 1, capacity):
                        part = own[k : k + capacity]
                        rows.append((row, doc, k // capacity, k, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if ids else [])))
                        row += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=[x.split()[0] for x in schema.split(", ")])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces. Pieces that fill a sequence have numbers below zero."""
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    where = places([(c, n) for c, n in plan(histogram, capacity).chosen if c != ((capacity, 1),)])
    most = min(RANKED, max(1, int(sum(histogram.values()) * RANK_SHARE)))
    hot = [x for k, n in histogram.items() if n > most for x in (F.lit(k), F.lit(-(-n // most)))]
    salts = F.coalesce(F.create_map(*hot)[F.col("length")], F.lit(1)) if hot else F.lit(1)
    alone = cut.where(F.col("length") == capacity).select(*cut.columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("row")
    salted = cut.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
    # at most capacity + 1 / RANK_SHARE + pieces / RANKED rows
    before = Window.partitionBy("of").orderBy("of_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(F.col("length").alias("of"), F.col("salt").alias("of_salt")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("of", "of_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("row")
    ranked = (
        salted.withColumn("own", F.row_number().over(own))
        .join(F.broadcast(counts), (F.col("length") == F.col("of")) & (F.col("salt") == F.col("of_salt")))
        .withColumn("rank", F.col("base") + F.col("own") - 1)
        .drop("of", "of_salt", "salt", "own", "base", "row")
    )
    names = [c for c in ranked.columns if c != "rank"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "row") + ", sequence_id long, offset long"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        big = np.int64(1) << 40
        k = np.searchsorted(where["length"] * big + where["rank"], length * big + rank, side="right") - 1
        within = rank - where["rank"][k]
        copy, sequence = within // where["n"][k], within % where["n"][k]
        new = [pa.array(where["first"][k] + sequence), pa.array(where["offset"][k] + copy * length)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], names=[*names, "sequence_id", "offset"])

    return map_arrow(ranked, run, schema).unionByName(alone)


def packed(df: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return pack(stored(pieces(df, tokenizer_path, capacity=capacity, end_id=end_id, ids=ids, id_col=id_col, text_col=text_col), "pieces"), capacity)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
