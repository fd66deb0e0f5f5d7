"""Functions compared by groups against functions compared one by one."""

import random

import numpy as np

from fwlens.operators import group_diff
from fwlens.operators.function_diff import Block, Diff, Function


def functions(rng, n, base):
    out = []
    for k in range(n):
        start, size = base + 1000 * k, rng.choice([1, 3, 3, 3])
        blocks = {}
        for i in range(size):
            leaves = [("0", "value", "int", rng.choice(["0", "300", "nan", "NaN", str(start), "x", None, str(1 << 63) if not rng.randrange(40) else "600"])), ("1", "offset", "int", rng.choice(["1", "1", "1", "2"]))]
            blocks[start + 16 * i] = Block(
                start + 16 * i, rng.random() > 0.1, rng.choice(["r", "r", "b"]), ["t"] * rng.choice([1, 1, 2]), ["o"] * rng.randrange(3), [rng.randrange(3)], [rng.choice([250, 5, 7, start]) for _ in range(rng.randrange(4))],
                [start + 16 * i] if rng.random() > 0.1 else [], [[("tag", leaves[: rng.choice([1, 1, 1, 2])])]], rng.choice([None, None, None, "h", "g"]), rng.choice([0, 0, 0, 1]),
            )
        at = [*blocks]
        edges = [(x, y) for x, y in zip(at, at[1:], strict=False)]
        if rng.random() < 0.2 and size == 3:  # two blocks with one attribute vector
            edges = [(at[0], at[1]), (at[0], at[2])]
        out.append(Function(start, blocks, edges, [(200, 1000)], (200, 1000)))
    return out


def test_groups_give_what_pairs_give():
    rng = random.Random(11)
    a, b = functions(rng, 60, 10_000), functions(rng, 70, 900_000)
    a += a[:5]
    b += [Function(f.start, f.blocks, f.edges, f.regions, f.span) for f in a[:20]] + [Function(None, {}, [])]
    a += [Function(None, {}, [])]
    fast = 0
    for options in ({}, {"check_hooks": True}, {"resolve_constants": True}):
        want = {(i, j): d.similarity for i, x in enumerate(a) for j, y in enumerate(b) if (d := Diff(x, y, **options)).probably_identical}
        i, j, s = group_diff.identical_in_tile(a, b, **options)
        got = {(int(p), int(q)): None if np.isnan(x) else float(x) for p, q, x in zip(i, j, s, strict=True)}
        assert got == want and len(got) == len(i) > 20
        fast += sum(group_diff._plain(f, bool(options.get("check_hooks"))) for f in a)
    assert fast > 20


def test_blocks_as_in_pairs():
    """Similarity and identity of all blocks, also of functions that differ."""
    rng = random.Random(12)
    a, b = ([f for f in functions(rng, 80, base) if group_diff._plain(f, False)] for base in (10_000, 900_000))
    a, b = ([f for f in fs if [*f.attributes.values()] == [(0, 2, 0), (1, 1, 0), (2, 0, 0)]] for fs in (a, b))
    assert len(a) > 5 and len(b) > 5
    for place in range(3):
        xs, ys = ([[*f.blocks][place] for f in fs] for fs in (a, b))
        similarity, same = group_diff._compared_blocks([f.blocks[x] for f, x in zip(a, xs, strict=True)], [f.blocks[y] for f, y in zip(b, ys, strict=True)], a, b)
        for i, f in enumerate(a):
            for j, g in enumerate(b):
                d = Diff(f, g)
                assert similarity[i, j] == d.similarity_of(xs[i], ys[j]) and same[i, j] == d.identical(xs[i], ys[j], True)
