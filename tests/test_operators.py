"""Hand-worked cases of single operators, and properties."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fwlens.functions import sequences as seq
from fwlens.functions import text as txt
from fwlens.operators import filters, graph, legacy, matching, refine, scoring
from fwlens.operators.function_diff import Block, Diff, Function, changed_constants, edit_distance, mutual_nearest, nearest
from fwlens.sources import binaries, tables
from fwlens.sources.exports import flow_graphs, quoted


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*xs, kind="int"):
    return F.array(*[F.lit(x).cast(kind) for x in xs]).cast(f"array<{kind}>")


def test_euclidean(spark):
    assert value(spark, seq.euclidean(array(0, 3, 1), array(0, 0, 5))) == 5.0
    assert value(spark, seq.euclidean(array(1, 9), array(1))) == 0.0


def test_levenshtein_cases(spark):
    assert value(spark, seq.levenshtein(array(1, 2, 3), array(1, 3))) == 1
    assert value(spark, seq.levenshtein_shifted(array(10, 20), array(14, 24), array(0, 4))) == 0
    assert value(spark, seq.levenshtein_shifted(array(14, 24, 30), array(10, 20), array(0, -4))) == 1
    assert value(spark, seq.levenshtein_shifted(array(14, 24, 30), array(10, 20), array(0, 4))) == 3
    assert value(spark, seq.levenshtein(array(), array(1, 2))) == 2


def test_levenshtein_against_model(spark):
    rng = random.Random(3)
    rows = [([rng.randint(0, 4) for _ in range(rng.randint(0, 6))], [rng.randint(0, 4) for _ in range(rng.randint(0, 6))], [0, 1]) for _ in range(60)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>, s array<int>")
    for r in df.select("a", "b", seq.levenshtein(F.col("a"), F.col("b")).alias("d"), seq.levenshtein_shifted(F.col("a"), F.col("b"), F.col("s")).alias("t"), F.levenshtein(seq.as_code_points(F.col("a")), seq.as_code_points(F.col("b"))).alias("c")).collect():
        assert r["d"] == r["c"] == edit_distance(r["a"], r["b"])
        assert r["t"] == edit_distance(r["a"], r["b"], lambda x, y: y - x in (0, 1))


@given(st.lists(st.integers(0, 3), max_size=6), st.lists(st.integers(0, 3), max_size=6), st.lists(st.integers(0, 3), max_size=6))
def test_edit_distance_is_a_metric(a, b, c):
    assert edit_distance(a, b) == edit_distance(b, a)
    assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)
    assert (edit_distance(a, b) == 0) == (a == b)


def block(addr, **more):
    return Block(addr, **{"jumpkind": "Ijk_Boring", "instructions": [addr], "parts": [[]]} | more)


def pair(x, y, **more):
    return Diff(Function(x.addr, {x.addr: x}, []), Function(y.addr, {y.addr: y}, []), **more)


def test_block_similarity():
    x = block(0, tags=["Put", "Put", "Exit"], operations=["Add"], registers=[8, 12], constants=[1])
    y = block(0, tags=["Put", "Exit"], operations=["Add"], registers=[8], constants=[1])
    assert pair(x, y).similarity_of(0, 0) == pytest.approx(1 - 2 / 6)
    x = block(0, tags=list("abcd"), registers=[1, 2, 3, 4], constants=[1])
    y = block(0, tags=list("efgh"), registers=[5, 6, 7, 8], constants=[2], jumpkind="Ijk_Ret")
    assert pair(x, y).similarity_of(0, 0) == pytest.approx(1 - 10 / 6)
    dead, live = block(0, lifted=False), block(0)
    assert pair(dead, dead).similarity_of(0, 0) == 1.0 and pair(dead, dead).identical(0, 0)
    assert pair(dead, live).similarity_of(0, 0) == 0.0 and not pair(dead, live).identical(0, 0)


def test_hooked_blocks():
    x, y = block(0, hook="libc:a"), block(0, hook="libc:b", tags=["Put"])
    assert pair(x, y, check_hooks=True).similarity_of(0, 0) == 0.0 and not pair(x, y, check_hooks=True).identical(0, 0)
    assert pair(x, x, check_hooks=True).similarity_of(0, 0) == 1.0


def test_changed_constants():
    of = lambda slot, v: block(0, parts=[[("Put", [("0", slot, "int", v)])]])
    assert changed_constants(of("value", "4"), of("value", "8")) == [("4", "8")]
    assert changed_constants(of("offset", "4"), of("offset", "8")) is None
    assert changed_constants(of("value", "nan"), of("value", "NaN")) == []
    assert changed_constants(of("value", "4"), block(0, parts=[[]])) is None


def test_constants_explained_by_place():
    of = lambda addr, v: block(addr, parts=[[("Put", [("0", "value", "int", str(v))])]])
    d = pair(of(16, 100), of(32, 116))
    assert d.identical(16, 32, True) and d.probably_identical and d.similarity == 1.0
    d = pair(of(16, 100), of(32, 117))
    assert d.identical(16, 32) and not d.identical(16, 32, True) and d.blocks_with_differing_constants() == {(16, 32): [("100", "117")]}


def test_diamond():
    # E to A and B, both to X: only the ends are certain, the middle is told apart by its successors' order
    blocks = lambda by: {by + k: block(by + k, tags=["Put"] * (k // 16)) for k in (0, 16, 32, 48)}
    edges = lambda by: [(by, by + 16), (by, by + 32), (by + 16, by + 48), (by + 32, by + 48)]
    a, b = Function(0, blocks(0), edges(0)), Function(256, blocks(256), edges(256))
    assert [a.attributes[k][:2] for k in (0, 16, 32, 48)] == [(0, 2), (1, 1), (1, 1), (2, 0)]
    d = Diff(a, b)
    assert d._mutual(a.attributes, b.attributes, False) == [(0, 256), (48, 304)]
    assert d.matches == {0: 256, 16: 272, 32: 288, 48: 304} and d.unmatched == ([], [])


def test_distances_of_odd_graphs():
    loop = Function(0, {0: block(0), 8: block(8)}, [(0, 0)])
    assert loop.attributes == {0: (0, 10000, 0), 8: (10000, 0, 0)}
    assert Function(0, {0: block(0)}, [(0, 0)]).attributes == {0: (0, 0, 0)}
    empty = Diff(Function(None, {}, []), Function(None, {}, []))
    assert empty.similarity is None and empty.probably_identical


@given(st.dictionaries(st.integers(0, 9), st.tuples(*[st.integers(0, 3)] * 3), max_size=6), st.dictionaries(st.integers(0, 9), st.tuples(*[st.integers(0, 3)] * 3), max_size=6))
def test_mutual_matches_are_a_partial_bijection(x, y):
    near, back = nearest(x, y), nearest(y, x)
    found = [(p, near[p][0]) for p in near if len(near[p]) == 1 and back[near[p][0]] == [p]]
    assert len({p for p, _ in found}) == len({q for _, q in found}) == len(found)


def test_contraction():
    calls = {0: True, 8: False, 16: False}
    assert graph.contract(calls, [(0, 8), (8, 16)]) == {0: [8, 16]}
    assert graph.contract({16: True, 8: False}, [(16, 8)]) == {8: [], 16: []}
    assert graph.contract({0: True, 8: False, 16: False}, [(0, 16), (8, 16)]) == {0: [], 8: [], 16: []}
    assert graph.contract({0: False, 8: True, 16: False}, [(0, 8), (8, 16)]) == {0: [], 8: [16]}


def test_contracted_graph(spark):
    nodes = spark.createDataFrame([("o", 0, a, j) for a, j in ((0, "Ijk_Call"), (8, "Ijk_Boring"), (16, "Ijk_Boring"))], "object_id string, faddr long, baddr long, jumpkind string")
    edges = spark.createDataFrame([("o", 0, 0, 8, "transition"), ("o", 0, 8, 0, "fake_return"), ("o", 0, 8, 16, "transition"), ("o", 0, 8, 16, "transition")], "object_id string, faddr long, src long, dst long, edge_type string")
    sites = spark.createDataFrame([("o", 0, 8, 1, 0, 77), ("o", 0, 0, 0, 0, 66)], "object_id string, faddr long, baddr long, block_ord int, seq int, target long")
    kept, moved, calls = graph.contracted_graph(nodes, edges, sites)
    assert sorted(r["baddr"] for r in kept.collect()) == [0, 16]
    assert {(r["src"], r["dst"], r["edge_type"]) for r in moved.collect()} == {(0, 0, None), (0, 16, None)}
    assert [(r["baddr"], r["seq"], r["target"]) for r in calls.orderBy("seq").collect()] == [(0, 0, 66), (0, 1, 77)]


def test_trivial(spark):
    nodes = spark.createDataFrame([("o", 1, [1, 2]), ("o", 2, [1, 2, 3]), ("o", 3, [1]), ("o", 3, [2])], "object_id string, faddr long, instruction_addrs array<long>")
    assert [r["faddr"] for r in filters.trivial(nodes, ["object_id", "faddr"], F.size("instruction_addrs")).collect()] == [1]


def test_banned_and_viable(spark):
    f = spark.createDataFrame([("o", 1, "a", False, False), ("o", 2, "$d", False, False), ("o", 3, None, False, False), ("o", 4, "p", True, None), ("o", 5, "s", None, True)], "object_id string, faddr long, name string, is_plt boolean, is_simprocedure boolean")
    nodes = spark.createDataFrame([], "object_id string, faddr long, instruction_addrs array<long>")
    banned = filters.banned_functions(f, nodes)
    assert sorted(r["faddr"] for r in banned.collect()) == [2, 3, 4, 5]
    s = spark.createDataFrame([("o", 1, "a", "STB_GLOBAL", True, False, False), ("o", 1, "b", "STB_LOCAL", True, False, False), ("o", 1, "c", None, True, None, None), ("o", 2, "d", "STB_GLOBAL", True, False, False), ("o", 1, "e", "STB_WEAK", True, False, True)], "object_id string, rebased_addr long, name string, binding string, is_function boolean, is_hidden boolean, is_weak boolean")
    assert sorted(r["name"] for r in filters.viable_symbols(s, banned).collect()) == ["a", "c"]


def test_regions(spark):
    regions = spark.createDataFrame([("o", "segment", "x", 0, 10), ("o", "section", "y", 20, 30), ("p", "section", "z", 5, 6)], "object_id string, kind string, name string, min_addr long, max_addr long")
    loaded = filters.loaded_regions(regions)
    addrs = spark.createDataFrame([("o", 0), ("o", 10), ("o", 25), ("p", 5)], "object_id string, addr long")
    assert {tuple(r) for r in filters.inside_regions(addrs, loaded, ["object_id"], "addr").collect()} == {("o", 0), ("p", 5)}


def test_best_and_squished(spark):
    m = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 0.9), (2, "d", None)], "f long, name string, score double")
    assert sorted((r["f"], r["name"]) for r in matching.best_with_ties(m, ["f"], "score").collect()) == [(1, "a"), (1, "b"), (2, "d")]
    c = spark.createDataFrame([(1, "foo", 1), (1, "foo", 2), (2, "foo", 1), (2, "bar", 2), (3, None, 1), (3, None, 2)], "f long, name string, k int")
    assert sorted((r["f"], r["k"]) for r in matching.squished(c, ["f"], "name", ["k"]).collect()) == [(1, 1), (2, 1), (2, 2), (3, 1)]


def test_used_names(spark):
    c = spark.createDataFrame([(1, "foo"), (2, "foo"), (2, "bar"), (3, "foo"), (3, "foo")], "bin_faddr long, name string")
    assert sorted(map(tuple, refine.without_used_names(c).collect())) == [(1, "foo"), (2, "bar")]


CANDIDATE = "bin_faddr long, library string, object_id string, lib_faddr long, name string, similarity double, is_guess boolean"


def candidates(spark, *rows):
    return spark.createDataFrame([(f, "l", "o", lib, name, 1.0, False) for f, lib, name in rows], CANDIDATE)


def test_narrowing_by_callees(spark):
    positions = spark.createDataFrame([(1, 1, 9)], "bin_faddr long, pos int, target long")
    calls = spark.createDataFrame([("o", 10, 1, "x"), ("o", 11, 1, "y")], "object_id string, lib_faddr long, pos int, callee_name string")
    inside, none = spark.createDataFrame([(9,)], "target long"), spark.createDataFrame([], "target long")
    both = [(1, 10, "g"), (1, 11, "h")]
    narrow = lambda c, banned, here: sorted(r["name"] for r in refine.narrowed_by_callees(c, positions, calls, banned, here).where("bin_faddr = 1").collect())
    assert narrow(candidates(spark, *both, (9, 12, "x")), none, inside) == ["g"]
    assert narrow(candidates(spark, *both), none, inside) == ["g", "h"]  # the callee has no candidates
    assert narrow(candidates(spark, *both), inside, inside) == ["g", "h"]  # the callee is ignored
    assert narrow(candidates(spark, *both), none, none) == []  # outside the image: no library function has that name


def test_naming_by_callers(spark):
    target = spark.createDataFrame([(1, 1, 1, 9)], "bin_faddr long, block_pos int, in_block int, target long")
    calls = spark.createDataFrame([("o", 10, 1, 1, "x")], "object_id string, lib_faddr long, block_pos int, in_block int, callee_name string")
    inside, none = spark.createDataFrame([(9,)], "target long"), spark.createDataFrame([], "target long")
    named = lambda c, banned=none: sorted((r["name"], r["is_guess"]) for r in refine.named_by_callers(c, target, calls, banned, inside).where("bin_faddr = 9").collect())
    assert named(candidates(spark, (1, 10, "g"))) == [("x", True)]
    assert named(candidates(spark, (1, 10, "g"), (9, 12, "z"))) == [("x", True)]
    assert named(candidates(spark, (1, 10, "g"), (9, 12, "x"))) == [("x", False)]
    assert named(candidates(spark, (1, 10, "g"), (9, 12, "x"), (9, 13, "z"))) == [("x", False)]
    assert named(candidates(spark, (1, 10, "g"), (9, 12, "y"), (9, 13, "z"))) == [("x", True)]
    assert named(candidates(spark, (1, 10, "g")), inside) == []


def test_scores(spark):
    symbols = spark.createDataFrame([(k, f"n{k}") for k in range(1, 6)] + [(9, "app")], "addr long, symbol string")
    c = spark.createDataFrame([(1, "n1", False), (2, "n2", False), (3, "n3", True), (4, "bad", False), (5, "n5", False), (5, "zz", False), (9, "q", False)], "addr long, name string, is_guess boolean")
    known = symbols.where("addr < 9").select(F.col("symbol").alias("name"))
    r = scoring.score(scoring.outcomes(symbols, c, known, symbols.select("addr").limit(0)), symbols, known).first()
    assert (r["precise"], r["incorrect"], r["imprecise"], r["guesses"], r["ignored"], r["missing"], r["total"]) == (3, 1, 1, 1, 1, 0, 5)
    assert (r["hit_rate"], r["error_rate"], r["collision_rate"]) == (0.6, 0.2, 0.2)
    none = scoring.score(scoring.outcomes(symbols, c, known.limit(0), symbols.select("addr").limit(0)), symbols, known.limit(0)).first()
    assert none["hit_rate"] is None


def test_call_graph_between_objects(spark):
    names = spark.createDataFrame([("f", "a", 1, False), ("g", "b", 2, True), ("g", "c", 3, False)], "name string, object_id string, faddr long, is_weak boolean")
    unique = graph.symbol_map(names)
    assert {tuple(r) for r in unique.collect()} == {("f", "a", 1), ("g", "c", 3)}
    assert graph.function_by_name(unique, "g").first()["faddr"] == 3
    with pytest.raises(graph.NameCollision):
        graph.symbol_map(names.unionByName(spark.createDataFrame([("f", "d", 4, False)], names.schema)))
    calls = spark.createDataFrame([("a", 1, 5), ("a", 1, 6), ("a", 1, 7)], "object_id string, caller long, callee long")
    stubs = spark.createDataFrame([("a", 6, "g"), ("a", 7, "unknown")], "object_id string, faddr long, name string")
    assert {tuple(r) for r in graph.inter_object_calls(calls, stubs, unique).collect()} == {("a", 1, "a", 5), ("a", 1, "c", 3)}


def test_legacy(spark):
    a, b = {1: (1, 1, 1), 2: (5, 5, 0), 3: (5, 5, 0)}, {11: (1, 1, 1), 12: (5, 5, 0), 13: (5, 5, 0)}
    assert legacy.spread(a, b, {1: [2, 3]}, {11: [12, 13]}) == {1: 11, 2: 12, 3: 13}
    rows = lambda o, x: [(o, f, *v) for f, v in x.items()]
    attributes = spark.createDataFrame(rows("x", a) + rows("y", b), "object_id string, faddr long, n_blocks int, n_edges int, n_calls int")
    calls = spark.createDataFrame([("x", 1, [2, 3]), ("y", 11, [12, 13])], "object_id string, faddr long, targets array<long>")
    pairs = spark.createDataFrame([("x", "y")], "a_object string, b_object string")
    assert {(r["a"], r["b"]) for r in legacy.binary_diff(pairs, attributes, calls).collect()} == {(1, 11), (2, 12), (3, 13)}
    plt = lambda *r: spark.createDataFrame(list(r), "name string, addr long")
    nodes = lambda *r: spark.createDataFrame([(x,) for x in r], "addr long")
    assert legacy.plt_matches(plt(("f", 1), ("g", 2)), plt(("f", 3), ("g", 4)), nodes(1, 2), nodes(3)).collect() == [("f", 1, 3)]


def test_mutual_nearest_relational(spark):
    a = spark.createDataFrame([("p", k, v) for k, v in ((1, [0, 2, 0]), (2, [1, 1, 0]), (3, [1, 1, 0]), (4, [2, 0, 0]))], "pair string, a long, va array<int>")
    b = a.select("pair", (F.col("a") + 10).alias("b"), F.col("va").alias("vb"))
    assert {(r["a"], r["b"]) for r in mutual_nearest(a, b, ["pair"], seq.euclidean).collect()} == {(1, 11), (4, 14)}
    assert mutual_nearest(a, b, ["pair"], seq.euclidean, unique=False).count() == 6


def test_text(spark):
    assert value(spark, txt.normalise_pseudocode(F.lit("x = SUB_1f(v12, a3); // note"))) == "x = sub_XXXX(vXXX, aXXX);"
    assert value(spark, txt.normalise_pseudocode(F.lit(None).cast("string"))) is None
    assert value(spark, txt.normalise_assembly(F.lit("call sub_1234  ; hi"))) == "call XXXX"
    assert value(spark, txt.normalise_assembly_text(F.lit("jmp loc_1\nmov aName_9 # x"))) == "jmp XXXX\nmov aXXX"
    assert value(spark, txt.indent_assembly(F.lit("loc_1:\nmov r0"))) == "loc_1:\n\tmov r0"
    assert value(spark, txt.strip_header(F.lit("int f()\n//c\n{\n}"))) == "{\n}"
    assert value(spark, txt.ast_ratio(array("a", "b", kind="string"), array("b", "a", kind="string"))) == 1.0
    assert value(spark, txt.ast_ratio(array("a", "b", kind="string"), array("a", "c", kind="string"))) == 0.5
    a, b = (value(spark, txt.part_hashes(F.lit(x))) for x in ("x = sub_1(v1);\ny", "y\nx = sub_2(v9);"))
    assert a[0] != b[0] and a[1] != b[1] and a[2] == b[2]
    pairs = spark.createDataFrame([(1, "a\nb", "b\nc"), (2, None, "x"), (3, "a", "a"), (4, "", ""), (5, "", "x\n\ny")], "k int, x string, y string")
    assert {r["k"]: (r["quick"], r["real_quick"]) for r in txt.line_ratios(pairs, "k", "x", "y").collect()} == {1: (0.5, 1.0), 2: (0.0, 0.0), 3: (1.0, 1.0), 4: (0.0, 0.0), 5: (0.0, 0.0)}


def test_headers_and_files(spark, tmp_path):
    (tmp_path / "objs" / "libx" / "sub").mkdir(parents=True)
    for name in ("libx/a.o", "libx/sub/b.obj", "libx/c.txt", "loose.o"):
        (tmp_path / "objs" / name).write_bytes(b"x")
    found = binaries.object_files(spark, str(tmp_path / "objs"))
    assert sorted((r["library"], r["path"].rsplit("/", 1)[1]) for r in found.collect()) == [("libx", "a.o"), ("libx", "b.obj")]
    (tmp_path / "image.bin").write_bytes(bytes.fromhex("0000002005020008"))
    from fwlens.sources.targets import cortex_options

    o = cortex_options(spark, str(tmp_path / "image.bin"))
    assert (o.base, o.entry, o.manual) == (0x08000000, 0x08000205, True)


def test_decompiled_records(spark, tmp_path):
    records = spark.createDataFrame([(0x8000000, "int f()\n{ \"q\" }", str(2**80), "a", "b", "c")], "addr long, code string, prime string, hash1 string, hash2 string, hash3 string")
    tables.write_decompiled(records, str(tmp_path / "tsv"))
    with open(tmp_path / "tsv" / "part-end.csv", "w") as f:
        f.write("done\n")
    assert tables.read_decompiled(spark, str(tmp_path / "tsv")).collect() == records.collect()
    assert [len(b) for b in tables.batches(spark.range(5), 2)] == [2, 2, 1]


def test_signatures(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a.o", "a.o", 1, "f", True), ("lib.a", "b.o", "lib.a", 2, "g", True), ("lib.a", "bad.o", "lib.a", None, None, False)], tables.SIGNATURES)
    tables.write_signatures(rows, str(tmp_path / "s"))
    assert tables.load_signatures(spark, str(tmp_path / "s")).count() == 3
    assert {r["member"]: r["ok"] for r in tables.load_signatures(spark, str(tmp_path / "s"), "lib.a").collect()} == {"b.o": True, "bad.o": False}


def test_call_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([("a", 1, "b", 2)], "src_object string, src long, dst_object string, dst long")
    tables.write_call_graph(edges, str(tmp_path))
    assert tables.load_call_graph(spark, str(tmp_path)).collect() == edges.collect()
    edges.drop("dst").write.parquet(str(tmp_path / "bad" / "call_graph"))
    with pytest.raises(ValueError):
        tables.load_call_graph(spark, str(tmp_path / "bad"))


def test_flow_graphs_and_quotes(spark):
    nodes = spark.createDataFrame([("o", 1, 2)], "object_id string, faddr long, baddr long")
    edges = spark.createDataFrame([("o", 1, 2, 2)], "object_id string, faddr long, src long, dst long")
    code = spark.createDataFrame([("o", 1, 2, 1, "bx", ["lr"]), ("o", 1, 2, 0, "mov", ["r0", "r1"])], "object_id string, faddr long, baddr long, ix int, mnemonic string, operands array<string>")
    r = flow_graphs(nodes, edges, code).first()
    assert [i["mnemonic"] for i in r["nodes"][0]["instructions"]] == ["mov", "bx"] and r["edges"][0]["dst"] == 2
    assert quoted("foo") == "foo" and quoted("it's") == "'it''s'" and quoted("no") == "'no'"
