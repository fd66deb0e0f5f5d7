from pyspark.sql import functions as F

from fwlens.operators import refine
from fwlens.plans.catalog_engine import ROUNDS
from fwlens.schema import CANDIDATES


def test_callees_narrow_to_the_fixpoint(spark):
    """Each function of a chain can only be told apart once its callee is, so a chain needs as many rounds as it is long."""
    n = ROUNDS + 3
    rows = [(k, "l", "o", 10 * k + c, name, None, False) for k in range(n) for c, name in ((1, "x"), (2, "y"))] + [(n, "l", "o", 10 * n + 1, "x", None, False)]
    candidates = spark.createDataFrame(rows, CANDIDATES)
    positions = spark.createDataFrame([(k, 1, k + 1) for k in range(n)], "bin_faddr long, pos int, target long")
    calls = spark.createDataFrame([("o", 10 * k + c, 1, name) for k in range(n) for c, name in ((1, "x"), (2, "y"))], "object_id string, lib_faddr long, pos int, callee_name string")
    inside, banned = positions.select("target").distinct(), positions.select("target").where("false")
    found = refine.narrowed_by_callees(candidates, positions, calls, banned, inside)
    assert found.agg(F.count(F.lit(1)), F.min("name"), F.max("name")).first() == (n + 1, "x", "x")
