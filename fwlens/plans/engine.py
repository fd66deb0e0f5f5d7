"""The matching engine: which library functions does a target image hold?"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fwlens.operators.attributes import function_attributes
from fwlens.operators.filters import banned_functions, counted_edges, inside_regions, loaded_regions, symbol_names, viable_symbols, without
from fwlens.operators.function_diff import packed_functions
from fwlens.operators.graph import contracted_graph
from fwlens.operators.group_diff import identical_pairs
from fwlens.operators.matching import ATTRIBUTES, best_with_ties, first_order, shape_signatures, squished
from fwlens.operators.refine import ORDER, call_positions, named_by_callers, narrowed_by_callees, without_used_names
from fwlens.operators.sequential import refined as in_order
from fwlens.operators.scoring import class_counts, classified, outcomes, result_map, score
from fwlens.plans.storage import settled
from fwlens.schema import Tables


@dataclass
class Options:
    #: contract call chains before anything else; off if the tables hold contracted graphs
    contract: bool = False
    #: join on shape signatures too, which only spares comparisons that must fail; not sound with hooks compared
    shapes: bool = True
    check_hooks: bool = False
    resolve_constants: bool = False
    #: last phase: 1 attributes, 2 comparison and best scores, 3 callees, 4 callers, 5 used names
    max_phase: int = 5
    min_similarity: float | None = None
    #: refine in order of addresses, with recursion, in one task for the image, instead of in synchronous rounds
    sequential: bool = False


@dataclass
class Described:
    """Tables with what matching needs of them."""

    tables: Tables
    banned: DataFrame
    attributes: DataFrame
    viable_symbols: DataFrame
    names: DataFrame

    @classmethod
    def of(cls, tables: Tables, options: Options) -> Described:
        banned = settled(banned_functions(tables.functions, tables.cfg_nodes), "banned")
        if options.contract:
            nodes, edges, sites = contracted_graph(tables.cfg_nodes, tables.cfg_edges, tables.call_sites)
            tables = Tables(**{**vars(tables), "cfg_nodes": settled(nodes, "nodes"), "cfg_edges": settled(edges, "edges"), "call_sites": settled(sites, "sites")})
        attributes = function_attributes(tables.functions, tables.cfg_nodes, counted_edges(tables.cfg_edges), tables.callgraph)
        if options.shapes and not options.check_hooks:
            attributes = attributes.join(shape_signatures(tables.functions, tables.cfg_nodes, tables.statements), ["object_id", "faddr"])
        else:
            attributes = attributes.withColumn("shape", F.lit(""))
        return cls(tables, banned, settled(attributes, "attributes"), viable_symbols(tables.symbols, banned), symbol_names(tables.symbols))


class Engine:
    """A database of library objects that targets are matched against."""

    def __init__(self, library: Tables, options: Options | None = None):
        self.options = options or Options()
        self.library = Described.of(library, self.options)

    def symbol_name_set(self) -> DataFrame:
        return self.library.viable_symbols.select("name").distinct()

    def match(self, target: Tables) -> Matches:
        return Matches(self, Described.of(target, self.options))


class Matches:
    """The candidates for each function of one target, phase by phase."""

    def __init__(self, engine: Engine, target: Described):
        self.engine, self.target = engine, target
        lib, on = engine.library, [*ATTRIBUTES, "shape"]
        group = F.concat_ws(":", *on).alias("group")
        viable = without(lib.attributes, lib.banned, ["object_id", "faddr"]).select("object_id", "faddr", group)
        own = target.attributes.select("object_id", "faddr", group)
        #: (object_id, faddr, group) of the target's and the library's functions that have a partner; partners have one group
        self.own = settled(own.join(viable.select("group").distinct(), "group", "left_semi"), "own")
        self.others = settled(viable.join(self.own.select("group").distinct(), "group", "left_semi"), "others")

    @functools.cached_property
    def first(self) -> DataFrame:
        """First-order pairs."""
        own = self.own.select(F.col("object_id").alias("bin_object"), F.col("faddr").alias("bin_faddr"), "group")
        pairs = first_order(self.others.withColumnRenamed("faddr", "lib_faddr"), own, ["group"])
        return settled(pairs.select("bin_object", "bin_faddr", "object_id", "lib_faddr"), "first-order")

    def second(self) -> DataFrame:
        """First-order pairs that are probably identical, with their similarity."""
        keys, options = ["object_id", "faddr"], self.engine.options
        own = packed_functions(self.target.tables, self.own).join(self.own, keys)
        others = packed_functions(self.engine.library.tables, self.others).join(self.others, keys)
        return identical_pairs(own, others, check_hooks=options.check_hooks, resolve_constants=options.resolve_constants)

    def plain(self) -> DataFrame:
        """For each target function its best candidates, all of the highest score."""
        options, lib = self.engine.options, self.engine.library.tables
        pairs = self.first.withColumn("similarity", F.lit(None).cast("double")) if options.max_phase < 2 else self.second()
        if options.min_similarity is not None:
            pairs = pairs.where(F.col("similarity") >= options.min_similarity)
        named = pairs.join(lib.functions.select("object_id", F.col("faddr").alias("lib_faddr"), "name"), ["object_id", "lib_faddr"]).join(lib.objects.select("object_id", "library"), "object_id")
        best = best_with_ties(named, ["bin_faddr"], "similarity")
        return best.select("bin_faddr", "library", "object_id", "lib_faddr", "name", "similarity", F.lit(False).alias("is_guess"))

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(plain, refined) candidates."""
        options, target, lib = self.engine.options, self.target, self.engine.library
        plain = settled(self.plain(), "plain")
        if options.max_phase < 3:
            return plain, plain
        sites = call_positions(target.tables.call_sites, ["faddr"]).withColumnRenamed("faddr", "bin_faddr")
        sites = settled(sites, "target-calls")
        callee = lib.names.select("object_id", F.col("addr").alias("target"), F.col("name").alias("callee_name"))
        calls = call_positions(lib.tables.call_sites, ["object_id", "faddr"]).join(callee, ["object_id", "target"], "left").withColumnRenamed("faddr", "lib_faddr")
        calls = calls.select("object_id", "lib_faddr", "pos", "block_pos", "in_block", "callee_name")
        calls = settled(calls.join(plain.select("object_id", "lib_faddr").distinct(), ["object_id", "lib_faddr"], "left_semi"), "library-calls")
        addresses = target.tables.call_sites.select("object_id", "target").distinct()
        inside = settled(inside_regions(addresses, loaded_regions(target.tables.regions), ["object_id"], "target").select("target").distinct(), "inside")
        banned = target.banned.select(F.col("faddr").alias("target"))
        if options.sequential:
            refined = settled(in_order(plain, sites, calls, banned, inside, callers=options.max_phase >= 4), "refined")
        else:
            refined = narrowed_by_callees(plain, sites, calls, banned, inside)
        if options.max_phase >= 4 and not options.sequential:
            refined = named_by_callers(refined, sites, calls, banned, inside)
        if options.max_phase >= 5:
            refined = settled(without_used_names(refined), "refined")
        return plain, refined

    def result(self, scored: bool = False) -> Result:
        plain, refined = self.candidates()
        one = lambda df: squished(df, ["bin_faddr"], "name", ORDER).withColumnRenamed("bin_faddr", "addr")
        target = self.target
        functions = target.tables.functions.select(F.col("faddr").alias("addr")).unionByName(refined.select(F.col("bin_faddr").alias("addr"))).distinct()
        viable = without(target.attributes, target.banned, ["object_id", "faddr"]).select(F.col("faddr").alias("addr"))
        final = settled(one(refined), "final")
        classes = classified(functions, final, viable)
        scores = None
        if scored:
            symbols = target.viable_symbols.select(F.col("rebased_addr").alias("addr"), F.col("name").alias("symbol"))
            known, banned = self.engine.symbol_name_set(), target.banned.select(F.col("faddr").alias("addr"))
            of = lambda df, phase: score(outcomes(symbols, df, known, banned), symbols, known, phase)
            scores = of(one(plain), "plain").unionByName(of(final, "final"))
        return Result(final, classes, result_map(classes), class_counts(classes), scores)


@dataclass
class Result:
    candidates: DataFrame
    classes: DataFrame
    #: (addr, name)
    names: DataFrame
    counts: DataFrame
    scores: DataFrame | None


def neighbours_of(result: Result) -> DataFrame:
    """Named functions with the names before and after them by address."""
    order = Window.orderBy("addr")
    named = result.classes.where("n > 0")
    one = F.when(F.col("n") == 1, F.col("name"))
    return named.select("addr", "name", F.lag(one).over(order).alias("previous"), F.lead(one).over(order).alias("next"))
