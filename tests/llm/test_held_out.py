"""Accuracy on rows that the models did not learn from, and texts beyond every chunk."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fwlens.llm import importance, language, simple8b
from fwlens.llm.common import table

SF = "/root/testdata/sf0.01"
own_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@own_tables
def test_languages_held_out(spark):
    found = language.op6_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    right, n = found.where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count(F.lit(1))).first()
    assert n > 200 and right >= 0.97


@own_tables
def test_quality_against_labels(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    kept = importance.Resampling(docs, labels).drawn(docs).select("doc_id", F.lit(1.0).alias("kept"))
    by = {r["quality"]: r["share"] for r in docs.join(labels, "doc_id").join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0.0))).alias("share")).collect()}
    assert by[1] >= 0.9 and by[0] <= 0.1


def test_a_token_beyond_the_table_of_powers_has_one_slot():
    token = b"x" * (5 << 20)
    alone, _ = importance.features([token])
    after, _ = importance.features([b"cat dog " + token])
    assert len(alone) and set(alone.tolist()) <= set(after.tolist())


def test_languages_of_texts_beyond_the_chunk(spark):
    text = "die Katze schläft auf dem Sofa und träumt von Fischen " * 45000  # beyond 2,000,000 characters
    train = [(k, t, lang) for k, (t, lang) in enumerate([("die Katze und der Hund", "de"), ("the cat and the dog", "en")] * 30)]
    df = spark.createDataFrame([*train, (1000, text, "de"), (1001, text[: len(text) // 2], None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.languages(df, language.default_model(df), spans=False).collect()}
    assert found[1000] == found[1001] == "de"


def test_pages_beyond_one(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = {k: f"{k} some words and numbers {k * k} " * 4000 for k in range(25)}
    df = spark.createDataFrame([(None if k > 22 else k // 3, t) for k, t in texts.items()], "doc_id long, text string")
    simple8b.write_ids(df, path, str(tmp_path / "ids"))
    rows = sorted(simple8b.read_documents(spark, str(tmp_path / "ids")).collect(), key=lambda r: r["start"])
    want = sorted(len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert sorted(r["n_tokens"] for r in rows) == want and sum(want) > 2 * simple8b.PAGE_IDS
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in rows]
    assert ids == sorted(ids)
