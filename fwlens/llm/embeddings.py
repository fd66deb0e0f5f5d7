"""Near-duplicate vectors: sign hashes of random hyperplanes in several tables, exact cosine verification, components.

A vector's sketch holds the sides of 256 random hyperplanes on which it lies. Each table hashes its own choice of these
bits; vectors of one label whose bits agree in some table are candidates for each other if their sketches are near
enough. Only sketches travel to the tables. A tile that has candidates gives its members that have one, not the pairs;
their vectors are then brought to the tile and compared exactly, in double precision, with a matrix product. A pair that
meets in several tables counts in the first of them only, so a tile needs to give no pairs: it gives the number of new
links of each vector and a spanning forest of the links. Equal vectors are one class with a weight and enter as one.

The number of bits grows with the logarithm of the largest label's vectors, so buckets stay small; the number of tables
follows from MISS, which bounds the chance that a pair just at the threshold is no candidate (closer pairs are lost far
less often).

Defined results: each row of the input gives a row. Vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing and are their own component; vectors of unlike dimension link
with nothing; rows that share a vec_id, and rows without one, are vectors like all others; the component is the smallest
vec_id in it, null if it has none, and ``kept`` is false without a vec_id; ties do not occur, as equal vectors are one
class; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, table
from .components import components
from .tiles import map_tiles, smallest_reachable, tiled

THRESHOLD, MISS, SEED = 0.93, 1e-3, 20240613
BITS, BUCKET = 256, 256
SKETCH = [f"s{k}" for k in range(BITS // 64)]


def agreement(bits: int) -> np.ndarray:
    """By the number of unlike bits of two sketches the chance that a table's bits agree."""
    out = np.ones(BITS + 1)
    for i in range(bits):
        out *= np.maximum(BITS - np.arange(BITS + 1) - i, 0) / (BITS - i)
    return out


def unlike_bits(cosine: float) -> np.ndarray:
    """The distribution of the number of unlike bits of two vectors."""
    p = math.acos(cosine) / math.pi
    return np.array([math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d) for d in range(BITS + 1)])


def far(threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The unlike bits that a candidate may have: all but half of ``miss`` of the pairs just at the threshold are within."""
    tail = 1 - np.cumsum(unlike_bits(threshold))
    return int(np.flatnonzero(tail <= miss / 2)[0])


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a table's hash, number of tables) for n vectors of a label."""
    bits = min(BITS // 4, max(4, math.ceil(math.log2(max(1, n) / BUCKET))))
    chance, agree = unlike_bits(threshold), agreement(bits)
    low, high = 1, 2
    lost = lambda t: float(chance @ (1 - agree) ** t)
    while lost(high) > miss / 2:
        low, high = high, high * 2
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if lost(mid) > miss / 2 else (low, mid)
    return bits, high


@functools.cache
def choices(bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """The bits of the sketch that each table hashes, ascending."""
    rng = np.random.default_rng([seed, bits])
    return np.sort(np.stack([rng.permutation(BITS)[:bits] for _ in range(tables)]), axis=1)


def masks(bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Each table's bits as words of the sketch."""
    on = np.zeros((tables, BITS), np.uint8)
    np.put_along_axis(on, choices(bits, tables, seed), 1, axis=1)
    return np.packbits(on, axis=1, bitorder="little").view("<u8")


@functools.cache
def hyperplanes(dim: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, BITS))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def words_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(s).to_numpy() for s in SKETCH], axis=1).view(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketched(vectors: DataFrame, seed: int = SEED) -> DataFrame:
    """Add to (vec_id, label, embedding, sound, dim, h1, h2) a number of its own for each row and the sketch."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema) + ", row long" + "".join(f", {s} long" for s in SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            dims, out = batch.column("dim").to_numpy(), np.zeros((batch.num_rows, BITS // 8), np.uint8)
            for dim in np.unique(dims[dims > 0]).tolist():
                mine = np.flatnonzero(dims == dim)
                side = matrix(batch.column("embedding").take(pa.array(mine)), dim) @ hyperplanes(dim, seed) >= 0
                out[mine] = np.packbits(side, axis=1, bitorder="little")
            marks = np.ascontiguousarray(out.view("<i8").T)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(row, row + batch.num_rows)), *map(pa.array, marks)], names=[*batch.schema.names, "row", *SKETCH])
            row += batch.num_rows

    return vectors.mapInArrow(run, schema)


def keyed(classes: DataFrame, bits: int, tables: int, seed: int = SEED) -> DataFrame:
    """(rep, t, key, sketch): a row for each class and table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = words_of(batch)
        chosen = masks(bits, tables, seed)
        base = batch.column("label").to_numpy().astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + batch.column("dim").to_numpy().astype(np.uint64)
        keys = np.broadcast_to(base[:, None], (len(base), tables)) + np.arange(1, tables + 1, dtype=np.uint64)
        for w in range(marks.shape[1]):
            keys = mixed(mixed(keys) + (marks[:, w, None] & chosen[None, :, w]))
        flat = pa.array(np.ascontiguousarray(keys).view(np.int64).ravel())
        ends = pa.array(np.arange(0, flat.__len__() + 1, tables, dtype=np.int32))
        columns = [batch.column("rep"), pa.ListArray.from_arrays(ends, flat), *(batch.column(s) for s in SKETCH)]
        return pa.RecordBatch.from_arrays(columns, names=["rep", "keys", *SKETCH])

    schema = "rep long, keys array<long>" + "".join(f", {s} long" for s in SKETCH)
    return map_arrow(classes.select("rep", "label", "dim", *SKETCH), run, schema).select("rep", F.posexplode("keys").alias("t", "key"), *SKETCH)


def near_places(words: np.ndarray, t: int, chosen: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (above the diagonal) of a tile of table t are near by their sketches and met in no table before."""
    differ = np.zeros((len(words), len(words)), np.uint16)
    for w in range(words.shape[1]):
        differ += np.bitwise_count(words[:, None, w] ^ words[None, :, w])
    p, q = np.nonzero(np.triu(differ <= most, 1))
    if len(p) and t:
        x = words[p] ^ words[q]
        new = np.ones(len(p), bool)
        for k in range(t):
            new &= ((x & chosen[k]) != 0).any(axis=1)
        p, q = p[new], q[new]
    return np.stack([p, q])


def each_tile(batch: pa.RecordBatch, begins: np.ndarray, chosen: np.ndarray, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(begin, end, p, q) of each tile that has candidates."""
    words, t, chunk, i, j = words_of(batch), *(batch.column(c).to_numpy() for c in ("t", "chunk", "tile_i", "tile_j"))
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), batch.num_rows], strict=True):
        if b - a > 1:
            p, q = near_places(words[a:b], int(t[a]), chosen, most)
            if i[a] != j[a]:
                across = chunk[a:b][p] != chunk[a:b][q]
                p, q = p[across], q[across]
            if len(p):
                yield a, b, p, q


TILE = ["key", "tile_i", "tile_j", "chunk", "t"]


def candidates(rows: DataFrame, chosen: np.ndarray, most: int) -> DataFrame:
    """The members of tiles that have a candidate there: (rep, key, tile_i, tile_j, chunk, t)."""

    def run(batch: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch | None:
        at = [a + np.union1d(p, q) for a, _, p, q in each_tile(batch, begins, chosen, most)]
        return batch.select(["rep", *TILE]).take(pa.array(np.concatenate(at))) if at else None

    return map_tiles(tiled(rows, "key", "rep"), "key", run, "rep long, key long, tile_i int, tile_j int, chunk int, t int")


def verified(members: DataFrame, vectors: DataFrame, chosen: np.ndarray, most: int, threshold: float) -> DataFrame:
    """(rep, n_links, other): the new links of rep in a tile, counted by weight, and the rep of its root there."""
    own = vectors.select(F.col("rep").alias("own_rep"), "label", "dim", "weight", "embedding", *SKETCH)
    rows = members.join(own, F.col("rep") == F.col("own_rep")).drop("own_rep")

    def run(batch: pa.RecordBatch, begins: np.ndarray) -> pa.RecordBatch | None:
        rep, label, dim, weight = (batch.column(c).to_numpy() for c in ("rep", "label", "dim", "weight"))
        embedding, out = batch.column("embedding"), []
        for a, b, p, q in each_tile(batch, begins, chosen, most):
            same = (label[a:b][p] == label[a:b][q]) & (dim[a:b][p] == dim[a:b][q]) & (rep[a:b][p] != rep[a:b][q])
            p, q = p[same], q[same]
            for size in np.unique(dim[a:b][p]).tolist():
                mine = np.flatnonzero(dim[a:b] == size)
                x = np.zeros((b - a, size))
                x[mine] = matrix(embedding.take(pa.array(a + mine)), size)
                x[mine] /= np.sqrt((x[mine] * x[mine]).sum(axis=1))[:, None]
                own = dim[a:b][p] == size
                u, v = p[own], q[own]
                linked = (x @ x.T)[u, v] >= threshold
                u, v = u[linked], v[linked]
                if not len(u):
                    continue
                w = weight[a:b]
                links = np.bincount(u, w[v], b - a) + np.bincount(v, w[u], b - a)
                root, some = smallest_reachable(u, v, b - a), np.flatnonzero(links)
                out.append((rep[a:b][some], links[some].astype(np.int64), rep[a:b][root[some]]))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["rep", "n_links", "other"])

    tiles = rows.repartition("key", "tile_i", "tile_j").sortWithinPartitions("key", "tile_i", "tile_j")
    return map_tiles(tiles, "key", run, "rep long, n_links long, other long")


def near_vectors(df: DataFrame, *, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df."""
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("label").isNotNull() & F.coalesce(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    vectors = vectors.withColumn("sound", sound).withColumn("dim", F.when(F.col("sound"), F.size("embedding")).otherwise(0))
    # classes are told apart by 128 bits; zeros of either sign are equal
    whole = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))
    vectors = vectors.withColumns({f"h{k}": F.xxhash64(F.lit(k), F.col("label"), whole) for k in (1, 2)})
    vectors = stored(sketched(vectors), "vectors")
    first = {c: F.first(c).alias(c) for c in ("label", "dim", *SKETCH)}
    classes = vectors.where("sound").groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), *first.values())
    classes = stored(classes, "classes")
    largest = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = tables_for(largest, threshold, miss)
    chosen, most = masks(bits, tables), far(threshold, miss)
    members = stored(candidates(keyed(classes, bits, tables), chosen, most), "members")
    with_vectors = classes.drop("h1", "h2", "least").join(vectors.select("row", "embedding"), F.col("rep") == F.col("row"))
    wanted = members.select(F.col("rep").alias("w")).distinct()
    with_vectors = with_vectors.join(wanted, F.col("rep") == F.col("w"), "left_semi")
    found = stored(verified(members, with_vectors, chosen, most, threshold), "found")
    counts = found.groupBy(F.col("rep").alias("c_rep")).agg(F.sum("n_links").alias("n_links"))
    joined = components(found, "rep", "other")
    # only classes with links need a component; the others are their own
    linked = classes.select("rep", "least").join(joined, F.col("rep") == F.col("vertex")).join(counts, F.col("rep") == F.col("c_rep"))
    linked = stored(linked.select(F.col("rep").alias("l_rep"), "component", "n_links", "least"), "linked")
    least = linked.groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    linked = linked.drop("least").join(least, F.col("component") == F.col("of")).select("l_rep", "n_links", "component_id")
    results = classes.join(linked, F.col("rep") == F.col("l_rep"), "left")
    results = results.select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(F.col("l_rep").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    results = stored(results, "results")
    own = vectors.where("sound").select("vec_id", "h1", "h2").join(results, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2"))).select("vec_id", "n_links", "component_id")
    alone = vectors.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings; nulls, repeated ids and empty tables as in ``near_vectors``."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: exact: all pairs of equal labels, and the smallest id reachable by recursion
OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
