"""Normalisation and comparison of decompiled and disassembled text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import quick_ratio, real_quick_ratio

# fixed values: prefixes of names that a disassembler makes up from addresses
ADDRESS_PREFIXES = ["loc_", "j_nullsub_", "nullsub_", "j_sub_", "sub_", "qword_", "dword_", "byte_", "word_", "off_", "def_", "unk_", "asc_", "stru_", "dbl_", "locret_"]
# fixed values: size keywords of assembly operands
SIZE_KEYWORDS = ["dword ptr ", "byte ptr ", "word ptr ", "qword ptr ", "short ptr"]


def normalise_pseudocode(code: Column) -> Column:
    """Comments dropped; made-up names and numbered variables and arguments replaced by fixed ones."""
    out = F.regexp_replace(code, r" // .*", "")
    for prefix in ADDRESS_PREFIXES:
        out = F.regexp_replace(out, f"(?i){prefix}[0-9a-f]+", f"{prefix}XXXX")
    out = F.regexp_replace(out, r"(?i)v[0-9]+", "vXXX")
    out = F.regexp_replace(out, r"(?i)a[0-9]+", "aXXX")
    return F.regexp_replace(out, r"(?i)arg_[0-9]+", "aXXX")


def normalise_assembly(line: Column) -> Column:
    """One line: cut at comments, made-up names, size keywords, offsets and numbered names replaced."""
    out = F.split_part(F.split_part(line, F.lit(";"), F.lit(1)), F.lit(" # "), F.lit(1))
    for prefix in ADDRESS_PREFIXES:
        out = F.regexp_replace(out, f"(?i){prefix}[0-9a-f]+", "XXXX")
    for word in SIZE_KEYWORDS:
        out = F.regexp_replace(out, f"(?i){word}[0-9a-f]+", "")
    out = F.regexp_replace(out, r"(?i)\+[a-f0-9]+h\+", "+XXXX+")
    out = F.regexp_replace(out, r"(?i)\.\.[a-f0-9]{8}", "XXX")
    out = F.regexp_replace(out, r"[ \t\n]+$", "")
    return F.regexp_replace(out, r"(?i)a[a-z]+[a-z0-9]+_[0-9]+", "aXXX")


def normalise_assembly_text(text: Column) -> Column:
    """All lines of a text, each normalised by itself."""
    return F.array_join(F.transform(F.split(text, "\n"), normalise_assembly), "\n")


def indent_assembly(text: Column) -> Column:
    """Lines that are no local labels are indented by a tab."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x.startswith("loc_"), x).otherwise(F.concat(F.lit("\t"), x))), "\n")


def strip_header(code: Column) -> Column:
    """Decompiled text without its first line and without comment lines."""
    lines = F.split(code, "\n")
    body = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.array_join(F.filter(body, lambda x: ~x.startswith("//")), "\n")


def line_ratios(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, quick, real_quick) of the lines of the texts a and b in each row: the common multiset by counts per line, so no lines are compared in pairs. Null and empty texts have no lines, and ratio 0."""
    side = lambda c, n: pairs.select(F.col(key), F.explode(F.split(F.nullif(F.col(c), F.lit("")), "\n")).alias("line"), F.lit(n).alias("side"))
    lines = side(a, 0).unionByName(side(b, 1))
    each = lines.groupBy(key, "line").agg(F.count_if(F.col("side") == 0).alias("n"), F.count_if(F.col("side") == 1).alias("m"))
    whole = each.groupBy(F.col(key).alias("of")).agg(F.sum(F.least("n", "m")).alias("common"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    joined = pairs.select(key).join(whole, F.col(key) == F.col("of"), "left")
    some = (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("m", F.lit(0)) > 0)
    return joined.select(key, F.when(some, quick_ratio(F.col("common"), F.col("n"), F.col("m"))).otherwise(0.0).alias("quick"), F.when(some, real_quick_ratio(F.col("n"), F.col("m"))).otherwise(0.0).alias("real_quick"))


def operator_multiset(ops: Column) -> Column:
    """A text that two syntax trees share exactly if they have the same operators as often: it stands for the product of a prime for each operator, which has one factorisation only."""
    return F.array_join(F.array_sort(ops), ",")


def ast_ratio(a: Column, b: Column) -> Column:
    """1 for equal multisets of operators, 0 for null, else twice the common part over the sum (a and b: arrays)."""
    names = F.array_distinct(F.concat(a, b))
    times = lambda ops, x: F.size(F.filter(ops, lambda y: y == x))
    common = F.aggregate(F.transform(names, lambda x: F.least(times(a, x), times(b, x))), F.lit(0), lambda s, x: s + x)
    ratio = F.when(F.array_sort(a) == F.array_sort(b), 1.0).otherwise(quick_ratio(common, F.size(a), F.size(b)))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(ratio)


def part_hashes(code: Column) -> Column:
    """Three digests of a text: as it is, of its normalised form, and of its normalised lines in any order. Texts that agree in a later one are alike though not equal."""
    normal = normalise_pseudocode(code)
    return F.array(F.sha2(code, 256), F.sha2(normal, 256), F.sha2(F.array_join(F.array_sort(F.split(normal, "\n")), "\n"), 256))
