"""Distances of vectors and sequences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of numbers, over the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    squares = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def _edit_distance(a: Column, b: Column, same) -> Column:
    n, m = F.size(a), F.size(b)
    # a row of the table of distances at a time; element_at counts from 1
    first = F.transform(F.array_repeat(F.lit(0), m + 1), lambda _, i: i)

    def row(before: Column, x: Column) -> Column:
        cell = lambda now, y, j: F.least(F.element_at(now, -1) + 1, F.element_at(before, j + 2) + 1, F.element_at(before, j + 1) + F.when(same(x, y), 0).otherwise(1))
        places = F.transform(b, lambda y, j: F.struct(y.alias("y"), j.alias("j")))
        return F.aggregate(places, F.array(F.element_at(before, 1) + 1), lambda now, p: F.concat(now, F.array(cell(now, p["y"], p["j"]))))

    return F.when((n == 0) | (m == 0), F.greatest(n, m)).otherwise(F.element_at(F.aggregate(a, first, row), -1))


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance with unit costs of two arrays of any type that has equality."""
    return _edit_distance(a, b, lambda x, y: x.eqNullSafe(y))


def levenshtein_shifted(a: Column, b: Column, shifts: Column) -> Column:
    """Edit distance of two arrays of numbers in which x and y agree if y - x is among the shifts."""
    return _edit_distance(a, b, lambda x, y: F.coalesce(F.array_contains(shifts, y - x), F.lit(False)))


def as_code_points(tokens: Column) -> Column:
    """An array of numbers from 0 to 55000 as text of one character each, for the built-in edit distance of strings."""
    return F.array_join(F.transform(tokens, lambda x: F.decode(F.unhex(F.lpad(F.hex(x.cast("long") + 1), 4, "0")), "UTF-16BE")), "")


def quick_ratio(common: Column, n: Column, m: Column) -> Column:
    """Twice the size of the common multiset over the sum of sizes; 0 if both are empty."""
    return F.when(n + m > 0, 2.0 * common / (n + m)).otherwise(F.lit(0.0))


def real_quick_ratio(n: Column, m: Column) -> Column:
    return F.when(n + m > 0, 2.0 * F.least(n, m) / (n + m)).otherwise(F.lit(0.0))
