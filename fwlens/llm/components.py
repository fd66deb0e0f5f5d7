"""Connected components of a link table, distributed: every vertex takes its smallest neighbour as parent, parents are
followed to their roots by pointer jumping, and the links are contracted to links between roots, until none is left.

The vertices that still have links at least halve in each round. Each round's tables are written to shared storage,
which cuts the lineage and survives lost executors, and dropped when the next
round has been written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds


def _links(a, b, df: DataFrame) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for each vertex of the links; component is the smallest vertex reachable. Null ends are no links."""
    rounds = Rounds(links.sparkSession)
    edges = rounds.settle(_links(F.col(a), F.col(b), links), "links")
    labels = rounds.settle(edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().withColumn("component", F.col("vertex")), "labels")
    while edges.limit(1).count():
        ends = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        parents = ends.groupBy(F.col("e.a").alias("v")).agg(F.min("e.b").alias("p")).select("v", F.least("v", "p").alias("p"), F.lit(True).alias("moved"))
        parents, moved = rounds.settle(parents, "parents"), True
        while moved:
            up = parents.select(F.col("v").alias("v2"), F.col("p").alias("p2"))
            before, jumped = parents, parents.join(up, F.col("p") == F.col("v2")).select("v", F.col("p2").alias("p"), (F.col("p") != F.col("p2")).alias("moved"))
            parents = rounds.settle(jumped, "parents")
            rounds.drop(before)
            moved = bool(parents.where("moved").limit(1).count())
        roots = lambda end, own=parents: own.select(F.col("v").alias(f"{end}_v"), F.col("p").alias(f"{end}_p"))
        old = labels, edges, parents
        labels = rounds.settle(labels.join(roots("l"), F.col("component") == F.col("l_v"), "left").select("vertex", F.coalesce("l_p", "component").alias("component")), "labels")
        contracted = edges.join(roots("a"), F.col("a") == F.col("a_v")).join(roots("b"), F.col("b") == F.col("b_v"))
        edges = rounds.settle(_links(F.col("a_p"), F.col("b_p"), contracted), "links")
        rounds.drop(*old)
    rounds.drop(edges)
    return labels
