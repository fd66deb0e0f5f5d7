"""Near-duplicates and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fwlens.llm import embeddings, simhash
from fwlens.llm.components import components
from fwlens.llm.tiles import map_tiles, tiled


def brute_components(vertices, links):
    parent = {v: v for v in vertices}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    links = {"path": [(k, k + 1) for k in range(40)], "star": [(0, k) for k in range(1, 60)], "random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)], "none": []}[kind]
    got = {r["vertex"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    ends = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute_components(ends, links)


def test_each_pair_meets_once(spark):
    rows = spark.createDataFrame([(7, k) for k in range(50)] + [(8, 1000), (9, 1001), (9, 1002)], "key long, id long")

    def pairs(batch, begins):
        import pyarrow as pa

        ids, chunk, i, j = (batch.column(c).to_numpy() for c in ("id", "chunk", "tile_i", "tile_j"))
        ends = [*begins[1:].tolist(), len(ids)]
        out = [(int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))) for a, b in zip(begins.tolist(), ends, strict=True) for x in range(a, b) for y in range(x + 1, b) if i[a] == j[a] or chunk[x] != chunk[y]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    found = [tuple(r) for r in map_tiles(tiled(rows, "key", "id", cap=10), "key", pairs, "a long, b long").collect()]
    assert sorted(found) == sorted([(a, b) for a in range(50) for b in range(a + 1, 50)] + [(1001, 1002)])


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(odd):
    for r in odd.select("text").distinct().collect():
        assert simhash.fingerprint(r["text"] or "") & (1 << 64) - 1 == plain_fingerprint(r["text"] or "")
    assert simhash.fingerprint("A b C d É") == simhash.fingerprint("a\tB c\x0bD É") != simhash.fingerprint("a b c d é")


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_close_pairs_share_a_key(blocks):
    rng = random.Random(blocks)
    keys = simhash.block_keys(blocks)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for _, m in keys)


def test_linked_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for k in range(200):
        x = prints[k % 60] if k < 100 else prints[-1]
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        prints.append(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    from fwlens.llm.common import stored

    got = {r["doc_id"]: r["component"] for r in df.join(simhash.simhash_classes(stored(df, "fp")), "fp").collect()}
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert got == brute_components(range(len(prints)), links)


def test_simhash_query(odd, none):
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9} and simhash.near_duplicates(odd).count() == odd.count()
    assert simhash.near_duplicates(none).count() == 0


def vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            base = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                rows.append((k, (base + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.25])).tolist(), label))
                k += 1
    hot = rng.normal(size=16)
    rows += [(k + j, (hot + rng.normal(size=16) * 0.05).tolist(), 1) for j in range(150)]
    rows += [(1000, [0.0] * 16, 0), (1001, None, 0), (1002, [1.0, None] * 8, 0), (1003, [float("nan")] * 16, 0), (1004, [float("inf")] * 16, 1), (1005, rows[0][1], None), (1006, [1.0, 2.0], 0), (1007, [2.0, 4.0], 0), (1008, [], 0), (None, rows[0][1], 0), (0, *rows[0][1:]), (1009, rows[0][1], 0)]
    return rows, spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, label int, rep string, key int")


def brute_vectors(rows):
    """One result for each row, rows of equal ids and rows without one included."""
    sound = {k: np.array(v, float) for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in sound for b in sound if a < b and rows[a][2] == rows[b][2] and len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] / np.sqrt((sound[a] @ sound[a]) * (sound[b] @ sound[b])) >= 0.93]
    comp, degree, least = brute_components(range(len(rows)), links), Counter(x for p in links for x in p), {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    return Counter((i, degree[k], least.get(comp[k]), i is not None and least.get(comp[k]) == i) for k, (i, *_) in enumerate(rows))


def test_vectors_against_brute_force(spark):
    rows, df = vectors(spark)
    assert Counter(map(tuple, embeddings.near_vectors(df, miss=1e-9).collect())) == brute_vectors(rows)


def test_repeated_and_missing_ids_keep_their_links(spark):
    rows = [(7, [1.0, 0.0], 0), (7, [0.0, 1.0], None), (8, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (None, [0.0, 1.0], 0), (9, [0.0, 1.0], 0), (None, [-1.0, 0.0], 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), miss=1e-9).collect()
    assert Counter(map(tuple, got)) == brute_vectors(rows)
    assert (7, 2, 7, True) in got and (8, 2, 7, False) in got


def test_sketches_and_tables():
    for n in (10, 10**5, 10**9):
        bits, tables = embeddings.tables_for(n)
        chosen = embeddings.masks(bits, tables)
        assert chosen.shape == (tables, 4) and all(np.bitwise_count(m).sum() == bits for m in chosen)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, (60, 4)).astype(np.uint64)
    x[30:] = x[:30] ^ (np.uint64(1) << rng.integers(0, 64, (30, 4)).astype(np.uint64))
    chosen = embeddings.masks(20, 12)
    met = [{(int(p), int(q)) for p, q in embeddings.near_places(x, t, chosen, 49).T} for t in range(12)]
    for t in range(12):
        want = {(a, b) for a in range(60) for b in range(a + 1, 60) if sum(bin(int(u)).count("1") for u in x[a] ^ x[b]) <= 49 and all(((x[a] ^ x[b]) & chosen[k]).any() for k in range(t))}
        assert met[t] == want


def test_sql_gives_the_same_rows(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows, _ = vectors(spark, 5)
    once = list({r[0]: r for r in rows if r[0] is not None}.values())
    df = spark.createDataFrame(once, "vec_id long, embedding array<float>, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings"))
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings/*.parquet'")
        want = con.sql(f"SELECT vec_id, n_links, component_id, kept FROM ({embeddings.OP8_SQL})").fetchall()
    got = embeddings.near_vectors(df, miss=1e-9).collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(r["n_links"] for r in got) > 1000


def test_few_links_are_missed(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 32))
    near = base + rng.normal(size=(400, 32)) * 0.36
    cos = (base * near).sum(1) / np.linalg.norm(base, axis=1) / np.linalg.norm(near, axis=1)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(np.concatenate([base, near]))]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).agg(F.sum("n_links")).first()[0]
    assert got >= 2 * 0.99 * (cos >= 0.93).sum() > 200


def test_no_vectors(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
