"""Token ids in Simple-8b files: 64-bit words whose top four bits say how many ids of how many bits the other sixty hold.

A file is a Parquet part of pages. A page holds the ids of whole documents, one after another, in blocks of 1024 ids;
``block_words`` gives the word at which each block begins, so blocks are coded, and can be decoded, side by side. Ids
that need more than 60 bits are escapes: a word with selector 0, then the id as a word of its own. The last word of a
block may be padded with zeros.

Defined results: documents stand in ascending order of id (null first; equal ids by a hash of the text); a null text is the empty
text, which still has its end id; repeated rows are all kept; an empty table gives no pages; further columns of the
input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import read_vocabulary
from .common import give_back, ids_and_texts, scratch_path, table
from .library_tokens import encoder_of

# fixed values: the selectors of Simple-8b as (ids in a word, bits of each); 0 is the escape, 1 a run of zeros
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNTS = np.array([c for c, _ in SELECTORS])
BLOCK = 1024
PAGE_IDS = 1 << 18
#: distinct words whose ids a task keeps; beyond them rare ones are forgotten and encoded again
WORDS_KEPT = 600_000
PAD = 120


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id; beyond 2^53 rounding may give one more for the largest of a width, which is still room enough."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids."""
    n = len(ids)
    blocks = -(-n // block)
    width = block + PAD
    grid = np.zeros((blocks, width), np.uint64)
    full = np.zeros(blocks * block, np.uint64)
    full[:n] = ids
    grid[:, :block] = full.reshape(blocks, block)
    bits = bit_lengths(grid)
    # for each place the selector with the most ids that fits there: maxima over windows of powers of two, joined;
    # selectors that hardly any window of so many independent ids would fit are not tried
    below = np.cumsum(np.bincount(bits[:, :block].ravel(), minlength=65)) / max(1, blocks * block)
    tried = [k for k in range(15, 0, -1) if below[SELECTORS[k][1]] ** SELECTORS[k][0] * n > 1e-3]
    maxima, size = {1: bits}, 1
    while tried and 2 * size <= SELECTORS[tried[-1]][0]:
        m = maxima[size].copy()
        np.maximum(m[:, :-size], maxima[size][:, size:], out=m[:, :-size])
        size *= 2
        maxima[size] = m
    choice = np.zeros((blocks, width), np.uint8)
    for s in tried:
        count, b = SELECTORS[s]
        p = 1 << (count.bit_length() - 1)
        high = maxima[p]
        if count > p:
            high = high.copy()
            np.maximum(high[:, : width - count + p], maxima[p][:, count - p :], out=high[:, : width - count + p])
        np.copyto(choice, s, where=high <= b)
    # all blocks advance together
    at, rows = np.zeros(blocks, np.int64), np.arange(blocks)
    ends = np.full(blocks, block)
    if blocks:
        ends[-1] = n - (blocks - 1) * block
    flat_choice, places = choice.ravel(), []
    while len(rows):
        p = rows * width + at
        places.append(p)
        at = at + COUNTS[flat_choice[p]]
        go = at < ends[rows]
        rows, at = rows[go], at[go]
    place = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
    chosen = flat_choice[place]
    takes = np.where(chosen == 0, 2, 1)
    target = np.cumsum(takes) - takes
    words, flat = np.zeros(takes.sum(), np.uint64), grid.ravel()
    for s in np.unique(chosen).tolist():
        mine = chosen == s
        count, b = SELECTORS[s]
        if s == 0:
            words[target[mine] + 1] = flat[place[mine]]
            continue
        word = np.full(mine.sum(), s << 60, np.uint64)
        for j in range(count if b else 0):
            word |= flat[place[mine] + j] << np.uint64(j * b)
        words[target[mine]] = word
    return words, target[np.searchsorted(place, np.arange(blocks) * width)].astype(np.int64)


def decode(words: np.ndarray, block_words: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of the given blocks, all words at once."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(selector == 0).tolist():  # an escape is rare; the word after it is none
        if not raw[k]:
            raw[k + 1] = True
    head = np.flatnonzero(~raw)
    selector = selector[head]
    count = COUNTS[selector]
    which = np.searchsorted(block_words, head, side="right") - 1
    ends = np.cumsum(count)
    begins = ends - count
    first = np.searchsorted(head, block_words)
    offset = begins - begins[first][which]
    keep = np.minimum(count, np.minimum(block, n - which * block) - offset)
    to = which * block + offset
    for s in np.unique(selector).tolist():
        mine = selector == s
        c, b = SELECTORS[s]
        if s == 0:
            out[to[mine]] = words[head[mine] + 1]
            continue
        w, t, k = words[head[mine]], to[mine], keep[mine]
        for j in range(c if b else 0):
            go = k > j
            out[t[go] + j] = (w[go] >> np.uint64(j * b)) & np.uint64((1 << b) - 1)
    return out


PAGES = "shard int, page int, doc_ids array<long>, starts array<long>, sizes array<long>, n_ids long, block_words array<long>, words binary"


def write_ids(df: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the texts in ascending order of id, an end id after each, and write them as pages below path."""
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(tokenizer_path))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, page, start = encoder_of(content), TaskContext.get().partitionId(), 0, 0
        encoder.words.most = WORDS_KEPT
        held_ids: list[np.ndarray] = []
        held_docs: list = []
        held_sizes: list[int] = []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held_ids).astype(np.uint64)
            words, block_words = encode(ids)
            sizes = np.array(held_sizes, np.int64)
            row = [shard, page, held_docs, start + np.cumsum(sizes) - sizes, sizes, len(ids), block_words, words.astype("<u8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in PAGES.split(", ")])

        held = 0
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for a in range(0, len(docs), 512):
                ids, counts = encoder.encode(texts.slice(a, 512).to_pylist())
                for doc, own in zip(docs[a : a + 512], np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    held_ids += [own, np.array([end_id], own.dtype)]
                    held_docs.append(doc)
                    held_sizes.append(len(own) + 1)
                    held += len(own) + 1
                    if held >= PAGE_IDS:
                        yield close()
                        page, start, held = page + 1, start + held, 0
                        held_ids, held_docs, held_sizes = [], [], []
        if held_docs:
            yield close()
        give_back()

    # the hash splits an id that many rows share; equal rows alone stay together
    rows = ids_and_texts(df, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").drop("mark")
    ordered.mapInArrow(pages, PAGES).write.parquet(path)


def page_ids(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """The ids of page k of a batch."""
    words = np.frombuffer(batch.column("words")[k].as_py(), "<u8")
    return decode(words, np.array(batch.column("block_words")[k].as_py(), np.int64), batch.column("n_ids")[k].as_py())


def read_documents(spark, path: str, ids: bool = True) -> DataFrame:
    """Read pages back: (doc_id, start, n_tokens, ids_crc32[, ids]), start counting all ids before the document."""
    pages = spark.read.schema(PAGES).parquet(path)
    schema = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                flat = page_ids(batch, k)
                sizes = np.array(batch.column("sizes")[k].as_py(), np.int64)
                cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
                raw = memoryview(flat.astype("<u4").tobytes())
                columns = [
                    batch.column("doc_ids")[k].values,
                    pa.array(np.full(len(sizes), batch.column("shard")[k].as_py(), np.int32)),
                    batch.column("starts")[k].values,
                    pa.array(sizes),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])
        give_back()

    # a row for each shard, and there are as many shards as the writer had tasks
    before = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    shards = pages.groupBy(F.col("shard").alias("of")).agg(F.sum("n_ids").alias("n")).select("of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = pages.mapInArrow(run, schema).join(F.broadcast(shards), F.col("shard") == F.col("of"))
    return docs.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def op3_simple8b_ids(spark, sf_dir: str) -> DataFrame:
    """The ids of all documents, written in Simple-8b pages and described from the files."""
    import public_tokenizers

    path = scratch_path(spark, "simple8b")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_documents(spark, path, ids=False)
