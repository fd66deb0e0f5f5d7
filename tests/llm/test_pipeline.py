import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fwlens.llm.common import stored, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_queries_are_registered():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_stages(spark):
    docs, before = table(spark, SF, "documents"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").count() == 0
        if name != "secrets":
            assert docs.exceptAll(before).count() == 0
        else:
            assert docs.count() == before.count() and docs.where(F.col("n_chars") != F.length("text")).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_repeated_rows_and_rows_without_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "A b c d e", "y"), (None, "a b c d e", "z"), (3, None, "w"), (4, "", "v")], "doc_id long, text string, source string")
    got = corpus_pipeline.one_of_each(spark, docs, SF).collect()
    assert sorted(((r["doc_id"] or 0), r["source"]) for r in got) == [(0, "z"), (1, "x"), (3, "w")]


def test_odd_rows_pass_all_stages(spark, odd, none):
    for df in (odd, none):
        docs = df.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), "stage")
        assert docs.columns[:3] == ["doc_id", "piece", "start"]
