"""The configuration program: plans hold the histogram, the knapsack is exact, and the program places nearly all tokens."""

import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fwlens.llm import packing
from fwlens.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def held(chosen, capacity):
    found = Counter()
    for config, n in chosen:
        assert sum(k * m for k, m in config) <= capacity and n > 0
        for k, m in config:
            found[k] += m * n
    return found


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=12))
def test_plans_hold_all(histogram):
    found = packing.plan(histogram, 64)
    assert held(found.chosen, 64) == Counter(histogram)
    assert found.sequences >= found.bound >= -(-sum(k * n for k, n in histogram.items()) // 64)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=7))
def test_the_bound_holds_and_plans_are_near_it(sizes):
    def fewest(left, rooms, best):
        if len(rooms) >= best:
            return best
        if not left:
            return len(rooms)
        for i in range(len(rooms)):
            if rooms[i] >= left[0]:
                best = min(best, fewest(left[1:], [*rooms[:i], rooms[i] - left[0], *rooms[i + 1 :]], best))
        return min(best, fewest(left[1:], [*rooms, 16 - left[0]], best))

    least = fewest(sorted(sizes, reverse=True), [], len(sizes) + 1)
    found = packing.plan(dict(Counter(sizes)), 16)
    assert found.bound <= least <= found.sequences <= least + 1


def test_knapsacks_against_all_multisets():
    prices, lengths = np.array([3.0, 4.0, 9.0]), np.array([2, 3, 5])
    value = packing.fills(prices, lengths, 11)
    all_ = [(2 * a + 3 * b + 5 * c, 3 * a + 4 * b + 9 * c, (a, b, c)) for a in range(6) for b in range(4) for c in range(3)]
    for size in range(12):
        assert value[size] == max((p for s, p, _ in all_ if s == size), default=packing.NONE) or value[size] < packing.NONE / 2
    for left in ((9, 9, 9), (1, 1, 1), (2, 0, 1), (0, 3, 0)):
        some = [(s, p) for s, p, n in all_ if s <= 11 and all(x <= y for x, y in zip(n, left, strict=True))]
        config = packing.dearest(prices, lengths, np.array(left), 11, False)
        assert sum(prices[k] * m for k, m in config.items()) == max(p for _, p in some)
        assert all(m <= left[k] for k, m in config.items())
        full = packing.dearest(prices, lengths, np.array(left), 11, True)
        assert (full is None) == all(s != 11 for s, _ in some)


def test_where_best_fit_is_not_best():
    lengths = np.random.default_rng(2).integers(500, 1200, 20000)
    histogram = dict(Counter(lengths.tolist()))
    found = packing.plan(histogram)
    assert found.sequences < sum(packing.best_fit(histogram, 2048).values()) and found.share >= 0.95


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_the_tables_own_histogram(spark):
    cut = stored(packing.pieces(table(spark, SF, "documents"), public_tokenizers.path("word_bpe_49k.json")), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}
    for times in (1, 40):
        asked = {k: n * times for k, n in histogram.items()}
        found = packing.plan(asked)
        assert held(found.chosen, 2048) == Counter(asked)
        assert found.share >= 0.95 and found.sequences <= sum(packing.best_fit(asked, 2048).values())
    assert packing.pack(cut).agg(F.count_distinct("sequence_id")).first()[0] == packing.plan(histogram).sequences


def test_hot_lengths_are_salted(spark):
    rows = [(i, None if i % 3 else i, 0, 0, 3 if i % 4 else 5, 7) for i in range(4000)] + [(i, i, 0, 0, 8, 7) for i in range(4000, 4100)]
    cut = spark.createDataFrame(rows, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(cut, 8).collect()
    assert len(got) == 4100
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(x) in ([(0, 8)], [(0, 3), (3, 5)], [(0, 5), (5, 3)], [(0, 3), (3, 3)], [(0, 3)]) for x in by.values())
    assert len(by) == 100 + 1000 + 1000
