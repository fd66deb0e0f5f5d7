"""Languages of mixed texts: scripts narrow the candidates, words get scores, and Viterbi labels the spans.

A word is a run of letters. Its script, from fixed ranges of code points, leaves the languages that were seen to use
that script. Its score under a language is the sum of log-probabilities of its letter trigrams, with marks for the
word's ends, in hashed tables. The best path through a text's words pays a penalty for each change of language; runs of
one label are the spans. The label with most letters is the text's language, its share of the letters the score.

The tables are learned from a sample of labelled rows, ``PER_LANGUAGE`` rows of each language in expectation, chosen by
a hash of the id; trigram counts are summed on the executors and only the tables, of fixed size, reach the driver.

Defined results: a null text or one without letters is ``und`` with score 0 and no spans; a word of a script that no
language used scores the same under all; ties go to the first language in order; repeated rows give a row each; an
empty table gives no rows, and without labelled rows all texts are ``und``; further columns are not read.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, map_arrow, table

# fixed values: first code points of ranges by script, from the blocks of Unicode
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1400, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
]
NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))
BUCKET_BITS, PER_LANGUAGE, PENALTY, RARE = 16, 400, 12.0, 1e-3
CHUNK_CHARS = 1_500_000
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    """For each code point 0, or 1 + the number of its script if it is a letter."""
    starts = np.array([s for s, _ in SCRIPTS])
    numbers = np.array([NAMES.index(n) for _, n in SCRIPTS])
    script = numbers[np.searchsorted(starts, np.arange(0x110000), side="right") - 1]
    letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, script + 1, 0).astype(np.uint8)


@dataclass
class Words:
    """The words of a batch of texts: where each begins in the joined text, its size, script and text, and the bucket of each of its trigrams."""

    begin: np.ndarray
    size: np.ndarray
    script: np.ndarray
    text: np.ndarray
    buckets: np.ndarray  # size + 1 for each word


def words_of(texts: list[str]) -> Words:
    sizes = np.array([len(t) for t in texts], np.int64)
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letters()[cp]
    inside = kind > 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = np.cumsum(sizes)
    first = (ends - sizes)[sizes > 0]
    starts[first] = inside[first]
    begin = np.flatnonzero(starts)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | starts[1:]
    size = np.flatnonzero(stops) + 1 - begin
    # the word between two marks, one trigram for each of its letters and one for its end
    n = size + 2
    at = np.cumsum(n) - n
    code = np.zeros(int(n.sum()), np.uint64)
    place = np.repeat(at + 1 - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    code[place] = cp[inside]
    mix = np.uint64(0x9E3779B97F4A7C15)
    h = (code[:-2] * np.uint64(0x100000001B3) + code[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] if len(code) > 2 else np.zeros(0, np.uint64)
    buckets = ((h * mix) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    # trigrams begin at each place of a word but its last two; words have size + 2 places, so size + 0 remain, never across words
    keep = np.ones(len(buckets), bool)
    keep[(at[1:] - 1)[at[1:] - 1 < len(keep)]] = False
    keep[(at[1:] - 2)[at[1:] - 2 < len(keep)]] = False
    return Words(begin, size, kind[begin].astype(np.int64) - 1, np.searchsorted(ends, begin, side="right"), buckets[keep])


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # by bucket and language
    allowed: np.ndarray  # by script and language, 0 or a penalty
    penalty: float = PENALTY

    def scores(self, w: Words) -> np.ndarray:
        """By word and language."""
        if not len(w.size):
            return np.zeros((0, len(self.languages)))
        begins = np.cumsum(w.size) - w.size
        return np.add.reduceat(self.logp[w.buckets], begins, axis=0) + self.allowed[w.script]

    def paths(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best label of each word; texts with the given numbers of words advance together."""
        order = np.argsort(-counts, kind="stable")
        n, begin = counts[order], (np.cumsum(counts) - counts)[order]
        labels = np.zeros(len(scores), np.int64)
        if not len(scores):
            return labels
        active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")
        back = np.zeros(scores.shape, bool)  # whether the best way to a label is a change from the best label before
        best = np.zeros(len(scores), np.int64)
        value = scores[begin[: active[0]]].copy()
        best[begin[: active[0]]] = value.argmax(axis=1)
        for t in range(1, int(n[0])):
            m = active[t]
            rows = begin[:m] + t
            value = value[:m]
            high = value.max(axis=1) - self.penalty
            change = value < high[:, None]
            back[rows] = change
            value = np.where(change, high[:, None], value) + scores[rows]
            best[rows] = value.argmax(axis=1)
        some = order[: active[0]]
        at = (np.cumsum(counts) - 1)[some]
        label = best[at]
        labels[at] = label
        for t in range(int(n[0]) - 1, 0, -1):
            m = active[t]
            rows = begin[:m] + t
            label = np.where(n[:m] - 1 == t, best[rows], labels[rows])
            labels[rows] = label
            labels[rows - 1] = np.where(back[rows, label], best[rows - 1], label)
        return labels


def sample_of(df: DataFrame, lang: Column, key: Column, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Labelled rows, about per_language of each language: those whose hashed key lies below the language's share."""
    labelled = df.where(lang.isNotNull())
    # a row for each language
    shares = labelled.groupBy(lang.alias("of")).agg(F.count(F.lit(1)).alias("n")).select("of", (F.lit(float(per_language)) / F.col("n")).alias("share"))
    return labelled.join(F.broadcast(shares), lang == F.col("of")).where(F.pmod(F.xxhash64(F.lit("language sample"), key), F.lit(1 << 30)) < F.col("share") * (1 << 30)).drop("of", "share")


def fit(labelled: DataFrame, penalty: float = PENALTY) -> Model:
    """From rows (lang, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        langs, texts = np.array(batch.column("lang").to_pylist()), batch.column("text").to_pylist()
        rows = []
        for lang in np.unique(langs).tolist():
            w = words_of([t.lower() for t, own in zip(texts, langs, strict=True) if own == lang])
            for base, values in ((0, w.buckets), (1 << BUCKET_BITS, w.script)):
                found, n = np.unique(values, return_counts=True)
                rows.append((np.full(len(found), lang, object), found + base, n))
        columns = [np.concatenate(x) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["lang", "slot", "n"])

    counts = map_arrow(labelled.select("lang", F.coalesce("text", F.lit("")).alias("text")), run, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most languages x (buckets + scripts) rows
    langs = sorted(set(found.column("lang").to_pylist()))
    size = 1 << BUCKET_BITS
    n = np.zeros((size + len(NAMES), len(langs)))
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        n[found.column("slot").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    grams, scripts = n[:size], n[size:]
    logp = np.log((grams + 0.05) / (grams.sum(axis=0) + 0.05 * size))
    used = scripts > RARE * scripts.sum(axis=0)
    allowed = np.where(used | ~used.any(axis=1)[:, None], 0.0, -1e3)
    return Model(langs, logp, allowed, penalty)


def label_texts(texts: list[str], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of the letters, spans) of each text; a span is (start, end, language), by code points."""
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    if not model.languages:
        return out
    lowered = [t.lower() for t in texts]
    # few code points become several in lower case; such texts are taken as they are, so that places hold
    lowered = [a if len(a) == len(b) else b for a, b in zip(lowered, texts, strict=True)]
    w = words_of(lowered)
    if not len(w.size):
        return out
    counts = np.bincount(w.text, minlength=len(texts))
    labels = model.paths(model.scores(w), counts)
    k = len(model.languages)
    weight = np.bincount(w.text * k + labels, w.size, len(texts) * k).reshape(-1, k)
    total, best = weight.sum(axis=1), weight.argmax(axis=1)
    base = np.cumsum([0, *map(len, lowered)])[w.text]
    change = np.ones(len(labels), bool)
    change[1:] = (labels[1:] != labels[:-1]) | (w.text[1:] != w.text[:-1])
    starts = np.flatnonzero(change)
    stops = np.append(starts[1:], len(labels)) - 1
    spans: list[list] = [[] for _ in texts]
    for t, a, b, label in zip(w.text[starts].tolist(), (w.begin - base)[starts].tolist(), (w.begin + w.size - base)[stops].tolist(), labels[starts].tolist(), strict=True):
        spans[t].append((a, b, model.languages[label]))
    for t in np.flatnonzero(total).tolist():
        out[t] = (model.languages[best[t]], float(weight[t, best[t]] / total[t]), spans[t])
    return out


def labelled_batches(texts: list[str], model: Model):
    a, held = 0, 0
    for b, t in enumerate(texts, 1):
        held += len(t)
        if held > CHUNK_CHARS or b == len(texts):
            yield from label_texts(texts[a:b], model)
            a, held = b, 0


def languages(df: DataFrame, model: Model, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score[, spans]) of each whole text. The model, of fixed size, is sent once to each executor."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<start: int, end: int, lang: string>>" * spans

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [*labelled_batches(batch.column("text").to_pylist(), shared.value)]
        columns = [batch.column("doc_id"), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())]
        if spans:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            columns.append(pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], kind))
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return map_arrow(ids_and_texts(df, id_col, text_col), run, schema)


def labelled_rows(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(rec, lang_pred, score): the rows of df as structs, with the language of each whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.struct("*").alias("rec"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [*labelled_batches(batch.column("text").to_pylist(), shared.value)]
        return pa.RecordBatch.from_arrays([batch.column("rec"), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64())], names=["rec", "lang_pred", "score"])

    return map_arrow(rows, run, f"rec {rows.schema['rec'].dataType.simpleString()}, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def default_model(docs: DataFrame) -> Model:
    """Learned from text and lang of documents outside the held-out fold."""
    own = docs.select(F.col("doc_id"), F.col("text"), F.col("lang")).where(F.coalesce(fold(F.col("doc_id")) != 1, F.lit(True)))
    return fit(sample_of(own, F.col("lang"), F.col("doc_id")))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the folds that are not held out; nulls, repeated rows and empty tables as in this module's docstring."""
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, default_model(docs), spans=False)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
