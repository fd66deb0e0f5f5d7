"""What leaves the engine: symbol files, dumps, flow graphs and printable forms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_.$@-]*")


def quoted(name: str) -> str:
    """A name as a YAML scalar."""
    return name if PLAIN.fullmatch(name) and name.lower() not in ("null", "true", "false", "yes", "no", "on", "off") else "'" + name.replace("'", "''") + "'"


def symbol_yaml(names: DataFrame, architecture: str, base_address: int, entry_point: int) -> str:
    """A symbol file of (addr, name): the names of one image, which the driver holds."""
    lines = [f"architecture: {quoted(architecture)}", f"base_address: {base_address}", f"entry_point: {entry_point}"]
    rows = [f"  {r['addr']}: {quoted(r['name'])}" for r in names.orderBy("addr").toLocalIterator()]
    return "\n".join([*lines, "symbols:" if rows else "symbols: {}", *rows]) + "\n"


def symbol_dump(viable_symbols: DataFrame) -> DataFrame:
    """(object_id, symbols): the viable symbols of each object as a map; of several names at an address the first in order."""
    first = viable_symbols.groupBy("object_id", "rebased_addr").agg(F.min_by("name", "ord").alias("name"))
    return first.groupBy("object_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rebased_addr", "name")))).alias("symbols"))


def flow_graphs(nodes: DataFrame, edges: DataFrame, instructions: DataFrame) -> DataFrame:
    """(object_id, faddr, nodes, edges): each function as a flow graph whose nodes list their instructions. instructions: (object_id, faddr, baddr, ix, mnemonic, operands)."""
    keys = ["object_id", "faddr"]
    listed = instructions.groupBy(*keys, "baddr").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", "mnemonic", "operands"))), lambda x: F.struct(x["mnemonic"].alias("mnemonic"), x["operands"].alias("operands"))).alias("instructions"))
    own = nodes.join(listed, [*keys, "baddr"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("baddr").alias("address"), "instructions"))).alias("nodes"))
    links = edges.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    return own.join(links, keys, "left")


def printable_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.select("object_id", "faddr", "baddr", F.format_string("<Block 0x%x, %s bytes, %s>", "baddr", F.col("size").cast("string"), "jumpkind").alias("text"))


def printable_objects(objects: DataFrame) -> DataFrame:
    return objects.select("object_id", F.format_string("<Object %s of %s>", "filename", F.coalesce("library", F.lit("-"))).alias("text"))


def printable_matches(matches: DataFrame) -> DataFrame:
    """Readable lines of (addr, library, name, similarity, is_guess)."""
    score = F.when(F.col("is_guess"), F.lit("guess")).otherwise(F.format_number("similarity", 6))
    return matches.select("addr", F.format_string("0x%x => %s:%s (%s)", F.col("addr"), F.col("library"), F.col("name"), score).alias("text"))
