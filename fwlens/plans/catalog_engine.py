"""Queries that run the engine's own operators on tables built from the star schema, with SQL that gives the same rows.

An order is a function, its lines are blocks in a row, lines of one return flag end in a call of their supplier. Orders
of one status are the target image, the others library objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fwlens.functions import sequences as seq
from fwlens.functions import text as txt
from fwlens.operators import filters, graph, refine, scoring
from fwlens.operators.function_diff import compared, packed_functions
from fwlens.operators.matching import shape_signatures
from fwlens.plans.catalog import SCORED, _order_pairs, _scored, query, read
from fwlens.plans.catalog import ORDER_PAIRS
from fwlens.plans.engine import Engine, Options
from fwlens.plans.storage import settled
from fwlens.schema import Tables, schema

LOW, HIGH = 200, 1000

BLOCKS = """b AS (SELECT l_orderkey AS f, o_custkey AS c, o_orderstatus AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS k, l_suppkey AS s, l_partkey AS p, l_quantity::INT AS q, l_linenumber AS r, l_returnflag AS x, l_linestatus AS y,
l_quantity::INT <> 13 AS lifted, (l_partkey % 5) * 300 AS v, CASE WHEN l_quantity::INT = 13 THEN 'unlifted' ELSE l_returnflag || l_linestatus || l_suppkey % 100 END AS shape FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
fn AS (SELECT f, any_value(c) AS c, any_value(status) AS status, count(*) AS n, count(DISTINCT CASE WHEN x = 'A' THEN s END) AS n_calls, string_agg(shape, ',' ORDER BY k) AS shape, count(*) = 1 AND max(q % 4) <= 1 AS tiny FROM b GROUP BY 1)"""


def _blocks(spark, sf) -> DataFrame:
    lines, orders = read(spark, sf, "lineitem", "orders")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    at = lines.join(orders.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("k", F.row_number().over(order) - 1)
    faddr = F.col("l_orderkey") * 1000
    return at.select(F.concat(F.lit("o_"), "o_orderstatus").alias("object_id"), "o_orderstatus", faddr.alias("faddr"), (faddr + F.col("k") * 16).alias("baddr"), "k", F.col("l_quantity").cast("int").alias("q"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def _tables(spark, sf) -> Tables:
    b = settled(_blocks(spark, sf), "blocks")
    x = F.col("l_returnflag")
    jump = F.when(x == "A", graph.CALL).when(x == "R", "Ijk_Ret").otherwise("Ijk_Boring")
    leaf = lambda slot, value: F.struct(F.lit(f"0.{slot}").alias("path"), F.lit(slot).alias("slot"), F.lit("int").alias("ctype"), value.cast("string").alias("value"))
    leaves = F.array(leaf("offset", F.concat("l_linestatus", (F.col("l_suppkey") % 100).cast("string"))), leaf("value", F.col("l_partkey") % 5 * 300))
    fit = lambda df, name: df.select([F.col(f.name).cast(f.dataType) for f in schema(name)])
    none = lambda kind: F.lit(None).cast(kind)
    false = F.lit(False)
    objects = b.select("object_id", "o_orderstatus").distinct()
    functions = b.select("object_id", "faddr").distinct().withColumn("name", F.concat(F.lit("f"), F.col("faddr").cast("string")))
    calls = b.where("l_returnflag = 'A'")
    return Tables(
        objects=fit(objects.select("object_id", F.col("o_orderstatus").alias("library"), F.col("object_id").alias("filename"), F.when(F.col("o_orderstatus") == "P", "target").otherwise("lib").alias("role"), F.lit("ARM").alias("arch"), F.lit(LOW).alias("min_addr"), F.lit(HIGH).alias("max_addr"), F.lit(0).alias("base_addr"), F.lit(0).alias("entry")), "objects"),
        regions=fit(objects.select("object_id", F.lit("segment").alias("kind"), F.lit(".text").alias("name"), F.lit(LOW).alias("min_addr"), F.lit(HIGH).alias("max_addr")), "regions"),
        symbols=fit(functions.select("object_id", F.lit(0).alias("ord"), false.alias("is_extern"), "name", F.col("faddr").alias("rebased_addr"), F.lit(4).alias("size"), F.lit("STB_GLOBAL").alias("binding"), F.lit(True).alias("is_function"), false.alias("is_hidden"), false.alias("is_weak")), "symbols"),
        functions=fit(functions.select("object_id", "faddr", "name", F.col("faddr").alias("startpoint"), *(false.alias(c) for c in ("is_plt", "is_simprocedure", "is_syscall"))), "functions"),
        cfg_nodes=fit(
            b.select(
                "object_id", "faddr", "baddr", F.col("k").alias("ord"), F.lit(4).alias("size"), jump.alias("jumpkind"), (F.col("q") != 13).alias("lift_ok"), F.lit(1).alias("n_subblocks"), F.sequence("baddr", F.col("baddr") + F.col("q") % 4 * 4, F.lit(4).cast("long")).alias("instruction_addrs"),
                F.array(x, "l_linestatus").alias("tags"), F.array_repeat(F.lit("Iop_Add32"), F.col("q") % 3).alias("operations"), F.array(F.col("l_linenumber") % 4).alias("register_offsets"), F.array("l_partkey").alias("constants"),
            ),
            "cfg_nodes",
        ),
        statements=fit(b.select("object_id", "faddr", "baddr", F.lit(0).alias("sub_ix"), F.lit(0).alias("stmt_ix"), F.concat(F.lit("Ist_"), x).alias("tag"), leaves.alias("leaves")), "statements"),
        cfg_edges=fit(b.where("k > 0").select("object_id", "faddr", (F.col("baddr") - 16).alias("src"), F.col("baddr").alias("dst"), F.lit("transition").alias("edge_type")), "cfg_edges"),
        call_sites=fit(calls.select("object_id", "faddr", "baddr", F.col("k").alias("block_ord"), F.lit(0).alias("seq"), F.col("l_suppkey").alias("target")), "call_sites"),
        callgraph=fit(calls.select("object_id", F.col("faddr").alias("caller"), F.col("l_suppkey").alias("callee")), "callgraph"),
        hooks=fit(objects.where("false").select("object_id", none("long").alias("addr"), none("string").alias("label")), "hooks"),
    )


#: a pair of functions as blocks side by side; similarity and identity of each pair of blocks
PAIRED = f"""d AS (SELECT pr.*, a.k, a.lifted AS la, z.lifted AS lz, a.x || a.y AS ta, z.x || z.y AS tz, a.q % 3 AS oa, z.q % 3 AS oz, a.r % 4 AS ra, z.r % 4 AS rz, a.x AS xa, z.x AS xz, a.p AS pa, z.p AS pz, a.v AS va, z.v AS vz, a.shape AS sa, z.shape AS sz, (z.f - a.f) * 1000 AS shift,
NOT (a.p >= {LOW} AND a.p < {HIGH}) AS ca, NOT (z.p >= {LOW} AND z.p < {HIGH}) AS cz FROM pr JOIN b a ON a.f = pr.bf JOIN b z ON z.f = pr.lf AND z.k = a.k),
e AS (SELECT bf, lf, k, CASE WHEN NOT la OR NOT lz THEN (la = lz)::INT::DOUBLE ELSE 1 - (levenshtein(ta, tz) + abs(oa - oz) + (ra <> rz)::INT + CASE WHEN ca AND cz THEN (pz - pa NOT IN (0, shift))::INT ELSE (ca <> cz)::INT END + (xa <> xz)::INT)::DOUBLE / (2 + greatest(ca::INT, cz::INT) + greatest(oa, oz) + 1) END AS similarity,
sa = sz AND (NOT la OR va = vz OR (va >= {LOW} AND va < {HIGH} AND vz >= {LOW} AND vz < {HIGH}) OR vz - va = shift) AS identical FROM d)"""


@query(f"""WITH {BLOCKS}, w AS (SELECT f AS lf, lag(f) OVER o AS bf, n, lag(n) OVER o AS m FROM fn WINDOW o AS (PARTITION BY c ORDER BY f)), pr AS (SELECT bf, lf FROM w WHERE n = m), {PAIRED}
SELECT bf * 1000 AS bin_faddr, lf * 1000 AS lib_faddr, bool_and(identical) AS identical, round(avg(similarity), 9) AS similarity, count(*) AS matched FROM e GROUP BY ALL""")
def compared_pairs(spark, sf):
    """The comparison of neighbouring functions of as many blocks; all blocks are matched in order."""
    tables = _tables(spark, sf)
    n = _blocks(spark, sf).groupBy("object_id", "faddr").agg(F.count(F.lit(1)).alias("n"))
    orders = read(spark, sf, "orders").select("o_custkey", (F.col("o_orderkey") * 1000).alias("faddr"))
    order = Window.partitionBy("o_custkey").orderBy("faddr")
    before = lambda c: F.lag(c).over(order)
    pairs = n.join(orders, "faddr").select(before("object_id").alias("bin_object"), before("faddr").alias("bin_faddr"), before("n").alias("m"), "object_id", F.col("faddr").alias("lib_faddr"), "n").where("n = m")
    packed = settled(packed_functions(tables), "packed")
    found = compared(pairs.select("bin_object", "bin_faddr", "object_id", "lib_faddr"), packed, packed)
    right = F.forall("block_matches", lambda x: x["b"] - x["a"] == F.col("lib_faddr") - F.col("bin_faddr")) & (F.size("unmatched_a") == 0) & (F.size("unmatched_b") == 0)
    return found.select("bin_faddr", "lib_faddr", "identical", F.round("similarity", 9).alias("similarity"), F.when(right, F.size("block_matches")).cast("long").alias("matched"))


ENGINE_PAIRS = "pr AS (SELECT t.f AS bf, l.f AS lf, l.status AS library FROM fn t JOIN fn l USING (n, n_calls, shape) WHERE t.status = 'P' AND l.status <> 'P' AND NOT l.tiny)"


@query(f"""WITH {BLOCKS}, {ENGINE_PAIRS}, {PAIRED} SELECT bf * 1000 AS bin_faddr, lf * 1000 AS lib_faddr, round(avg(similarity), 9) AS similarity FROM e GROUP BY ALL HAVING bool_and(identical)""")
def engine_second_phase(spark, sf):
    """The engine on whole tables: functions of the image and the library functions they are identical with, up to explained constants."""
    tables = _tables(spark, sf)
    found = Engine(tables.of("lib"), Options(max_phase=2)).match(tables.of("target")).second()
    return found.select("bin_faddr", "lib_faddr", F.round("similarity", 9).alias("similarity"))


@query(f"""WITH {BLOCKS}, m AS (SELECT f, n, n_calls, status, tiny, (SELECT string_agg(shape, ',' ORDER BY shape) FROM b WHERE b.f = fn.f) AS shapes FROM fn), p AS (SELECT t.f AS bf, count(*) AS n, min(l.f) AS first FROM m t JOIN m l USING (n, n_calls, shapes) WHERE t.status = 'P' AND l.status <> 'P' AND NOT l.tiny GROUP BY 1)
SELECT bf * 1000 AS bin_faddr, n, 'f' || first * 1000 AS name FROM p""")
def engine_first_phase(spark, sf):
    """The engine stopped after the attributes: each image function's candidates, all of equal rank."""
    tables = _tables(spark, sf)
    plain, _ = Engine(tables.of("lib"), Options(max_phase=1)).match(tables.of("target")).candidates()
    return plain.groupBy("bin_faddr").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "lib_faddr").alias("name"))


@query(f"""WITH {BLOCKS}, p AS (SELECT *, min(CASE WHEN x = 'A' THEN k END) OVER (PARTITION BY f) AS head FROM b)
SELECT f * 1000 AS faddr, string_agg((f * 1000 + k * 16)::VARCHAR, ',' ORDER BY k) FILTER (WHERE head IS NULL OR k <= head) AS kept, count(*) FILTER (WHERE head IS NULL OR k <= head) - 1 AS n_edges, coalesce(string_agg(s::VARCHAR, ',' ORDER BY k) FILTER (WHERE x = 'A'), '') AS calls FROM p GROUP BY f""")
def contracted_functions(spark, sf):
    """G1: blocks that end in a call take up what follows; nodes, edges and calls after that."""
    t = _tables(spark, sf)
    nodes, edges, sites = graph.contracted_graph(t.cfg_nodes, t.cfg_edges, t.call_sites)
    one = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["v"].cast("string"))
    kept = nodes.groupBy("faddr").agg(F.array_join(one(F.struct(F.col("baddr").alias("o"), F.col("baddr").alias("v"))), ",").alias("kept"))
    calls = sites.groupBy(F.col("faddr").alias("cf")).agg(F.array_join(one(F.struct("block_ord", "seq", F.col("target").alias("v"))), ",").alias("calls"))
    count = edges.groupBy(F.col("faddr").alias("ef")).agg(F.count(F.lit(1)).alias("n_edges"))
    out = kept.join(count, F.col("faddr") == F.col("ef"), "left").join(calls, F.col("faddr") == F.col("cf"), "left")
    return out.select("faddr", "kept", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("calls", F.lit("")).alias("calls"))


@query(f"WITH {BLOCKS}, m AS (SELECT f, string_agg(shape, ',' ORDER BY shape) AS shapes FROM b GROUP BY 1) SELECT f * 1000 AS faddr, min(f) OVER (PARTITION BY shapes) * 1000 AS first FROM m")
def shape_classes(spark, sf):
    """Each function with the first one of the same shape signature."""
    t = _tables(spark, sf)
    return shape_signatures(t.functions, t.cfg_nodes, t.statements).select("faddr", F.min("faddr").over(Window.partitionBy("shape")).alias("first"))


# filters

FUNCTIONS = """fn AS (SELECT o_orderkey AS f, CASE WHEN o_custkey % 11 = 0 THEN '$d' WHEN o_custkey % 13 = 0 THEN '' ELSE 'n' || o_custkey END AS name, o_orderstatus = 'P' AND o_custkey % 3 = 0 AS plt, o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0 AS sim FROM orders),
nd AS (SELECT l_orderkey AS f, count(*) = 1 AND sum(l_quantity::INT % 4) <= 2 AS tiny FROM lineitem GROUP BY 1), ban AS (SELECT f FROM fn LEFT JOIN nd USING (f) WHERE plt OR sim OR name IN ('', '$d', '$t') OR coalesce(tiny, false))"""


def _functions(spark, sf):
    orders, lines = read(spark, sf, "orders", "lineitem")
    name = F.when(F.col("o_custkey") % 11 == 0, "$d").when(F.col("o_custkey") % 13 == 0, "").otherwise(F.concat(F.lit("n"), F.col("o_custkey").cast("string")))
    functions = orders.select(F.lit("one").alias("object_id"), F.col("o_orderkey").alias("faddr"), name.alias("name"), ((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0)).alias("is_plt"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 2 == 0)).alias("is_simprocedure"))
    nodes = lines.select(F.lit("one").alias("object_id"), F.col("l_orderkey").alias("faddr"), F.array_repeat(F.lit(1), F.col("l_quantity").cast("int") % 4).alias("instruction_addrs"))
    return functions, nodes


@query(f"WITH {FUNCTIONS} SELECT f AS faddr FROM ban")
def banned(spark, sf):
    """Stubs, simulated, unnamed, oddly named and trivial functions."""
    return filters.banned_functions(*_functions(spark, sf)).select("faddr")


@query(f"WITH {FUNCTIONS} SELECT l_partkey AS name, l_orderkey AS rebased_addr FROM lineitem ANTI JOIN ban ON f = l_orderkey WHERE l_linenumber % 2 = 0 AND l_returnflag <> 'A' AND l_quantity <= 40 AND l_linestatus <> 'F'")
def viable_symbol_rows(spark, sf):
    """Visible, strong, global function symbols whose address is not banned; unknown flags count as false."""
    lines = read(spark, sf, "lineitem")
    flag = lambda c: F.when(c, F.lit(True))
    symbols = lines.select(F.lit("one").alias("object_id"), F.col("l_partkey").alias("name"), F.col("l_orderkey").alias("rebased_addr"), (F.col("l_linenumber") % 2 == 0).alias("is_function"), flag(F.col("l_returnflag") == "A").alias("is_hidden"), flag(F.col("l_quantity") > 40).alias("is_weak"), F.when(F.col("l_linestatus") == "F", "STB_LOCAL").alias("binding"))
    return filters.viable_symbols(symbols, filters.banned_functions(*_functions(spark, sf))).select("name", "rebased_addr")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size > 25 THEN '_UNKNOWN_LIB' ELSE p_brand END || ':' || p_name AS hook FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size % 2 = 0")
def hooked_lines(spark, sf):
    """Rows with the label of the hook at their address."""
    lines, parts = read(spark, sf, "lineitem", "part")
    hooks = parts.where("p_size % 2 = 0").select(F.lit("one").alias("object_id"), F.col("p_partkey").alias("addr"), filters.hook_label(F.when(F.col("p_size") <= 25, F.col("p_brand")), F.col("p_name")).alias("label"))
    own = lines.select(F.lit("one").alias("object_id"), "l_orderkey", "l_linenumber", "l_partkey")
    return filters.hooked(own, hooks, "l_partkey").drop("object_id")


@query("""WITH r AS (SELECT l_suppkey AS o, CASE WHEN l_returnflag = 'A' AND l_suppkey % 3 = 0 THEN 'segment' WHEN l_returnflag = 'R' THEN 'other' ELSE 'section' END AS kind, l_partkey AS low, l_partkey + l_quantity::INT AS high FROM lineitem), s AS (SELECT DISTINCT o FROM r WHERE kind = 'segment')
SELECT o, low, high, count(*) AS n FROM r WHERE kind = 'segment' OR (kind = 'section' AND o NOT IN (SELECT o FROM s)) GROUP BY ALL""")
def loaded(spark, sf):
    """An object's segments, or its sections if it has no segments."""
    x = F.col("l_returnflag")
    kind = F.when((x == "A") & (F.col("l_suppkey") % 3 == 0), "segment").when(x == "R", "other").otherwise("section")
    regions = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("object_id"), kind.alias("kind"), F.col("l_partkey").alias("low"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).alias("high"))
    return filters.loaded_regions(regions).groupBy(F.col("object_id").alias("o"), "low", "high").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem WHERE l_partkey >= l_suppkey * 10 AND l_partkey < l_suppkey * 10 + l_quantity")
def spans(spark, sf):
    """Addresses inside half-open spans."""
    low = F.col("l_suppkey") * 10
    return read(spark, sf, "lineitem").where(filters.in_span(F.col("l_partkey"), low, low + F.col("l_quantity"))).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("SELECT l_suppkey AS addr, arg_min(l_orderkey, {'a': l_returnflag = 'A', 'b': l_linenumber, 'c': l_orderkey}) AS name FROM lineitem GROUP BY 1")
def symbol_at(spark, sf):
    """The first symbol's name at each address, own symbols before extern ones."""
    lines = read(spark, sf, "lineitem")
    symbols = lines.select(F.lit("one").alias("object_id"), F.col("l_suppkey").alias("rebased_addr"), F.col("l_orderkey").alias("name"), (F.col("l_returnflag") == "A").alias("is_extern"), F.struct("l_linenumber", "l_orderkey").alias("ord"))
    return filters.symbol_names(symbols).select("addr", "name")


@query("WITH x AS (SELECT DISTINCT p_name AS name, p_partkey AS faddr, p_size <= 10 AS is_weak FROM part WHERE p_size % 5 > 0 AND p_size % 7 > 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)) SELECT name, count(*) AS n, min(faddr) AS first FROM x WHERE name = 'Part#3' OR NOT is_weak GROUP BY 1")
def exported_names(spark, sf):
    """Function symbols that have a function at their address."""
    parts, lines = read(spark, sf, "part", "lineitem")
    symbols = parts.select(F.col("p_name").alias("name"), F.lit("one").alias("object_id"), F.col("p_partkey").alias("rebased_addr"), (F.col("p_size") % 5 > 0).alias("is_function"), (F.col("p_size") % 7 == 0).alias("is_extern"), (F.col("p_size") <= 10).alias("is_weak"))
    names = graph.exported(symbols, lines.select(F.lit("one").alias("object_id"), F.col("l_partkey").alias("faddr")).distinct())
    return graph.function_by_name(names, "Part#3").unionByName(names.where("NOT is_weak")).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("faddr").alias("first"))


# refinement


@query(f"WITH {BLOCKS}, c AS (SELECT * FROM b WHERE x <> 'N') SELECT f * 1000 AS faddr, row_number() OVER (PARTITION BY f ORDER BY k // 2, k) AS pos, dense_rank() OVER (PARTITION BY f ORDER BY k // 2) AS block_pos, row_number() OVER (PARTITION BY f, k // 2 ORDER BY k) AS in_block, s AS target FROM c")
def numbered_calls(spark, sf):
    """The calls of each function, numbered over all and within blocks; two lines are a block."""
    b = _blocks(spark, sf).where("l_returnflag <> 'N'")
    sites = b.select("faddr", F.floor(F.col("k") / 2).cast("int").alias("block_ord"), F.floor(F.col("k") / 2).alias("baddr"), F.col("k").alias("seq"), F.col("l_suppkey").alias("target"))
    return refine.call_positions(sites, ["faddr"])


ROUNDS = 6
NARROW = """c0 AS (SELECT DISTINCT l_orderkey AS f, l_suppkey AS cand, 'p' || l_suppkey % 7 AS name FROM lineitem), t AS (SELECT o_orderkey AS f, 1 AS pos, o_orderkey + 1 AS target, o_custkey % 17 > 0 AS inside, o_orderstatus = 'P' AND o_custkey % 5 = 0 AS ban FROM orders
UNION ALL SELECT o_orderkey, 2, o_orderkey + 1 + o_custkey % 40, o_custkey % 17 > 0, o_orderstatus = 'P' AND o_custkey % 5 = 0 FROM orders WHERE o_custkey % 2 = 0),
l AS (SELECT s_suppkey AS cand, pos, CASE WHEN s_nationkey % 9 > 0 THEN 'p' || (s_suppkey + s_nationkey + pos) % 7 END AS callee FROM supplier, (VALUES (1), (2)) v(pos)), ti AS (SELECT DISTINCT target FROM t WHERE inside), tb AS (SELECT DISTINCT target FROM t WHERE ban),
tt AS (SELECT f, pos, target, target IN (FROM ti) AS i, target IN (FROM tb) AS b FROM t)"""


def _narrow_round(k: int) -> str:
    return f"""a{k} AS (SELECT f, pos, 'UnresolvableCallTarget' AS name FROM tt WHERE NOT i UNION SELECT f, pos, 'Ignored' FROM tt WHERE i AND b UNION SELECT tt.f, pos, c.name FROM tt JOIN c{k} c ON c.f = tt.target WHERE i AND NOT b),
o{k} AS (SELECT DISTINCT f FROM tt WHERE i AND NOT b AND target NOT IN (SELECT f FROM c{k})), s{k} AS (SELECT f FROM c{k} GROUP BY 1 HAVING count(*) > 1),
x{k} AS (SELECT DISTINCT c.f, c.cand FROM c{k} c JOIN l USING (cand) JOIN (SELECT f, pos, list(name) AS names FROM a{k} GROUP BY ALL) g ON g.f = c.f AND g.pos = l.pos WHERE c.f IN (FROM s{k}) AND c.f NOT IN (FROM o{k}) AND NOT coalesce(list_contains(names, callee), false) AND NOT list_contains(names, 'Ignored')),
c{k + 1} AS (SELECT * FROM c{k} ANTI JOIN x{k} USING (f, cand))"""


@query(f"WITH {NARROW}, {', '.join(_narrow_round(k) for k in range(ROUNDS))} SELECT f, cand FROM c{ROUNDS}")
def callee_fixpoint(spark, sf):
    """M2, M3: the loop of refinement by callees, to its fixpoint. The SQL unrolls ROUNDS rounds: sf0.01 needs no more, sf0.1 needs seven, so there the SQL keeps three rows that the loop rules out."""
    lines, orders, suppliers = read(spark, sf, "lineitem", "orders", "supplier")
    name = lambda x: F.concat(F.lit("p"), (x % 7).cast("string"))
    candidates = lines.select(F.col("l_orderkey").alias("bin_faddr"), F.lit("one").alias("library"), F.lit("one").alias("object_id"), F.col("l_suppkey").alias("lib_faddr"), name(F.col("l_suppkey")).alias("name"), F.lit(None).cast("double").alias("similarity"), F.lit(False).alias("is_guess")).distinct()
    own = orders.select(F.col("o_orderkey").alias("bin_faddr"), "o_custkey", "o_orderstatus")
    calls = own.withColumn("pos", F.lit(1)).withColumn("target", F.col("bin_faddr") + 1).unionByName(own.where("o_custkey % 2 = 0").withColumn("pos", F.lit(2)).withColumn("target", F.col("bin_faddr") + 1 + F.col("o_custkey") % 40))
    inside = calls.where("o_custkey % 17 > 0").select("target").distinct()
    banned_ = calls.where("o_orderstatus = 'P' AND o_custkey % 5 = 0").select("target").distinct()
    known = suppliers.withColumn("pos", F.explode(F.array(F.lit(1), F.lit(2))))
    library = known.select(F.lit("one").alias("object_id"), F.col("s_suppkey").alias("lib_faddr"), "pos", F.when(F.col("s_nationkey") % 9 > 0, name(F.col("s_suppkey") + F.col("s_nationkey") + F.col("pos"))).alias("callee_name"))
    found = refine.narrowed_by_callees(candidates, calls.select("bin_faddr", "pos", "target"), library, banned_, inside)
    return found.select(F.col("bin_faddr").alias("f"), F.col("lib_faddr").alias("cand"))


@query(f"""WITH {BLOCKS}, sure AS (SELECT f, c % 50 AS cand FROM fn), t AS (SELECT f, k // 2 AS bp, row_number() OVER (PARTITION BY f, k // 2 ORDER BY k) AS ib, p AS target FROM b), l AS (SELECT s_suppkey AS cand, bp, ib, 'n' || (s_nationkey + bp * 2 + ib) % 9 AS callee FROM supplier, (VALUES (0), (1), (2)) x(bp), (VALUES (1), (2)) y(ib) WHERE s_nationkey <> 3)
SELECT target, callee AS guessed FROM sure JOIN t USING (f) JOIN l USING (cand, bp, ib) QUALIFY row_number() OVER (PARTITION BY target ORDER BY f DESC, bp DESC, ib DESC) = 1""")
def caller_guesses(spark, sf):
    """M5, M6: the names that sure matches give to what they call; the last caller has its way."""
    b, orders, suppliers = _blocks(spark, sf), *read(spark, sf, "orders", "supplier")
    b = b.select((F.col("faddr") / 1000).cast("long").alias("bin_faddr"), "k", F.floor(F.col("k") / 2).cast("int").alias("block_pos"), F.col("l_partkey").alias("target"))
    calls = b.withColumn("in_block", F.row_number().over(Window.partitionBy("bin_faddr", "block_pos").orderBy("k"))).drop("k").withColumn("pos", F.lit(0))
    sure = orders.select(F.col("o_orderkey").alias("bin_faddr"), F.lit("one").alias("library"), F.lit("one").alias("object_id"), (F.col("o_custkey") % 50).alias("lib_faddr"))
    places = suppliers.withColumn("block_pos", F.explode(F.array(*map(F.lit, range(3))))).withColumn("in_block", F.explode(F.array(F.lit(1), F.lit(2))))
    name = F.concat(F.lit("n"), ((F.col("s_nationkey") + F.col("block_pos") * 2 + F.col("in_block")) % 9).cast("string"))
    library = places.select(F.lit("one").alias("object_id"), F.col("s_suppkey").alias("lib_faddr"), "block_pos", "in_block", F.lit(0).alias("pos"), F.when(F.col("s_nationkey") != 3, name).alias("callee_name"))
    return refine.guesses(sure, calls, library).select("target", "guessed")


# results


@query(f"""WITH {SCORED}, k2 AS (SELECT CASE WHEN coalesce(n, 0) > 1 THEN 'collision' WHEN o_orderstatus = 'P' THEN 'junk' WHEN n = 1 THEN 'matched' ELSE 'nothing' END AS class, coalesce(is_guess, false) AS is_guess, name FROM s LEFT JOIN e USING (addr))
SELECT count(*) FILTER (WHERE class = 'collision') AS collisions, count(*) FILTER (WHERE class = 'junk') AS junk, count(*) FILTER (WHERE class = 'matched') AS matched, count(*) FILTER (WHERE class = 'matched' AND is_guess) AS guesses, count(DISTINCT name) FILTER (WHERE class = 'matched') AS names FROM k2""")
def classes_counted(spark, sf):
    """The counts of the classes, and the result map's names."""
    candidates, symbols, _, viable, _ = _scored(spark, sf)
    classes = settled(scoring.classified(symbols.select("addr"), candidates, viable), "classes")
    return scoring.class_counts(classes).join(scoring.result_map(classes).agg(F.count_distinct("name").alias("names")), F.lit(True))


@query(f"""WITH {SCORED}, f AS (SELECT addr, string_agg(DISTINCT name, ', ' ORDER BY name) AS found FROM c GROUP BY 1), x AS (SELECT s.addr, symbol, CASE WHEN k.name IS NULL THEN CASE WHEN n = 1 AND NOT is_guess THEN 'IGNORED' ELSE 'UNSCORABLE' END WHEN o_orderstatus = 'P' THEN 'IGNORED' WHEN n IS NULL THEN 'MISSING' WHEN n > 1 THEN 'IMPRECISE' WHEN e.name = symbol THEN 'PRECISE' ELSE 'INCORRECT' END AS o FROM s LEFT JOIN e USING (addr) LEFT JOIN k ON k.name = symbol)
SELECT addr, o || ' 0x' || lower(hex(addr)) || ' ' || symbol || ': ' || coalesce(found, '-') AS line FROM x LEFT JOIN f USING (addr)""")
def score_report(spark, sf):
    """A readable line for each symbol."""
    candidates, symbols, known, _, banned_ = _scored(spark, sf)
    return scoring.report(scoring.outcomes(symbols, candidates, known, banned_), candidates)


# text and sequences


@query(f"WITH {ORDER_PAIRS} SELECT o_orderkey, levenshtein(array_to_string([x.l_returnflag for x in s], ''), array_to_string([x.l_returnflag for x in p], '')) AS distance FROM w WHERE p IS NOT NULL")
def sequence_levenshtein(spark, sf):
    """the edit distance of two lists of tokens."""
    flags = lambda c: F.transform(c, lambda x: x["l_returnflag"])
    return _order_pairs(spark, sf).select("o_orderkey", seq.levenshtein(flags("s"), flags("p")).cast("long").alias("distance"))


DOC_LINES = "string_split(text, chr(10))"


@query(f"""SELECT doc_id, md5(array_to_string([CASE WHEN starts_with(x, 'loc_') THEN x ELSE chr(9) || x END FOR x IN {DOC_LINES}], chr(10))) AS indented, md5(array_to_string([x FOR x IN {DOC_LINES}[2:] IF NOT starts_with(x, '//')], chr(10))) AS stripped FROM documents WHERE text IS NOT NULL""")
def text_layout(spark, sf):
    """Indented lines, and text without its first line and comments, of whole documents."""
    docs = read(spark, sf, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.md5(txt.indent_assembly(F.col("text"))).alias("indented"), F.md5(txt.strip_header(F.col("text"))).alias("stripped"))


def _pseudo(expression: str) -> str:
    for pattern, new in [(" // .*", ""), *((f"{p}[0-9a-f]+", f"{p}XXXX") for p in txt.ADDRESS_PREFIXES), ("v[0-9]+", "vXXX"), ("a[0-9]+", "aXXX"), ("arg_[0-9]+", "aXXX")]:
        expression = f"regexp_replace({expression}, '{pattern}', '{new}', 'gi')"
    return expression


PSEUDO_CODE = "'sub_' || lower(hex(l_partkey)) || '(v' || l_linenumber || ');' || chr(10) || 'a' || l_suppkey || ' = 1'"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {PSEUDO_CODE} AS code, {_pseudo(PSEUDO_CODE)} AS normal FROM lineitem)
SELECT l_orderkey, l_linenumber, sha256(code) AS a, sha256(normal) AS b, sha256(array_to_string(list_sort(string_split(normal, chr(10))), chr(10))) AS c FROM x""")
def code_digests(spark, sf):
    """Digests of a text, of its normalised form and of its lines in any order."""
    text = lambda c: F.col(c).cast("string")
    code = F.concat(F.lit("sub_"), F.lower(F.hex("l_partkey")), F.lit("(v"), text("l_linenumber"), F.lit(");\na"), text("l_suppkey"), F.lit(" = 1"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", txt.part_hashes(code).alias("h")).select("l_orderkey", "l_linenumber", *(F.col("h")[k].alias(c) for k, c in enumerate("abc")))
