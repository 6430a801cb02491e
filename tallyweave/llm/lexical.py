"""Ranked lexical search over document-sharded postings with integer impacts.

An index is a table of shards, each of whole documents of about SHARD_BYTES of text (a longer document is a shard of
its own). A shard holds compressed sparse rows: its distinct terms, where the postings of each begin, and a document
and an impact for each posting. The impact is the part of a score that no query changes, so it is a number of the
index: (10^9 tf) div (1000 tf + 8 m), with m from the document's length and the corpus means. A search multiplies it
by the term's weight, term at a time, into a dense array of the shard's documents, and takes the k best with all ties
of the last, which doc_id then decides. Tasks keep the k best of all shards they read; a window merges the tasks'.

What goes to executors is one block of items at a time: at most BLOCK_TERMS pairs of an item and a term on average, so
an item set of any size takes more passes over the index, not more memory. Document frequencies are counted in a pass
over the terms alone, for the terms of a block.

Defined results: a null text, or one without terms, is no document of the statistics and is never found; texts of any
length are indexed whole; rows that repeat are documents each for itself; a null doc_id is a document like others, and
comes first among equal scores; rows of one item_id are one item with the terms of all, each once, a null item_id too;
an item without terms, or whose terms no document holds, has no rows; equal scores are by doc_id, and rows equal in both
take ranks in any order; empty tables give empty results; extra columns of any name are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from tallyweave.llm.textnp import byte_class, chunks, coded_terms, words
from tallyweave.staging import mapped, written

SHARD_BYTES, BLOCK_TERMS = 4 << 20, 1 << 20
#: Terms are runs of ASCII letters and digits and of all that is not ASCII.
BREAKS = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
NEWLINE = byte_class((0x0A, 0x0A))
#: Stands for a null doc_id in shards.
NO_ID = -(1 << 63)


@dataclass
class Index:
    shards: DataFrame  # ids, terms, starts, docs, impacts, each the bytes of an array
    documents: int  # with at least one term
    terms: int  # all of them, with repeats


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms all have together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = total = 0
        for b in batches:
            for _, _, data, offsets in chunks(b.column(0)):
                n = np.diff(words(data, offsets, BREAKS)[2])
                full, total = full + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([full]), pa.array([total])], names=["documents", "terms"])

    row = mapped(docs.select(F.col("text").cast("string").alias("text")), run, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, at: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Of postings with tf occurrences in documents `at`, whose lengths are in `length`."""
    exact = 90 * int(length.max(initial=0)) * documents >= 1 << 63
    m = 100 - 90 + (90 * length.astype(object if exact else np.int64) * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m.astype(np.int64)[at])


def shard(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, documents: int, terms: int) -> tuple[bytes, ...]:
    """The compressed sparse rows of some documents."""
    names, code, doc = coded_terms(data, offsets, BREAKS)
    n = len(ids)
    place, tf = np.unique(code * n + doc, return_counts=True)
    at = place % n if len(place) else place
    starts = np.searchsorted(place, np.arange(len(names) + 1) * n)
    weight = impacts(tf, np.bincount(doc, minlength=n), at, documents, terms) if len(place) else place
    text = b"\n".join(x.as_buffer().to_pybytes() for x in names)
    return ids.tobytes(), text, starts.astype(np.int32).tobytes(), at.astype(np.int32).tobytes(), weight.astype(np.int32).tobytes()


COLUMNS = ["ids", "terms", "starts", "docs", "impacts"]


def index(docs: DataFrame) -> Index:
    """The index of all documents, written once to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    documents, terms = statistics(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for i, j, data, offsets in chunks(b.column(1), SHARD_BYTES):
                made = shard(ids[i:j], data, offsets, documents, terms)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made], names=COLUMNS)

    return Index(written(mapped(rows, run, ", ".join(f"{c} binary" for c in COLUMNS)), "lexical-shards"), documents, terms)


def _terms(names: bytes) -> pa.StringArray:
    """The terms of a shard in their order."""
    data = np.frombuffer(names, np.uint8)
    return coded_terms(data, np.array([0, len(data)]), NEWLINE)[0]


def _found(asked: pa.Array, names: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Which asked terms a shard has, and their places in it."""
    place = pc.index_in(asked, value_set=_terms(names)).fill_null(-1).to_numpy(zero_copy_only=False)
    have = np.flatnonzero(place >= 0)
    return have, place[have]


def _bytes(b: pa.RecordBatch, column: str, row: int) -> bytes:
    return b.column(b.schema.get_field_index(column))[row].as_buffer()


def frequencies(shards: DataFrame, asked: list[str]) -> dict[str, int]:
    """In how many documents each asked term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = pa.array(asked, pa.string()), np.zeros(len(asked), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                have, place = _found(wanted, _bytes(b, "terms", r))
                starts = np.frombuffer(_bytes(b, "starts", r), np.int32)
                total[have] += starts[place + 1] - starts[place]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    rows = mapped(shards.select("terms", "starts"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {asked[r["term"]]: r["n"] for r in rows.collect()}


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, equal ones by ascending id."""
    at = np.arange(len(score))
    if len(score) > k:
        last = score[np.argpartition(score, len(score) - k)[len(score) - k]]
        at = np.flatnonzero(score >= last)  # with all ties of the last
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _search(index: Index, item_type, queries: dict, k: int) -> DataFrame:
    """(item_id, doc_id, score): of each item, the k best of each task."""
    asked = sorted({t for terms in queries.values() for t in terms})
    df = frequencies(index.shards, asked)
    number = {t: i for i, t in enumerate(t for t in asked if t in df)}
    weights = np.array([weight(index.documents, df[t]) for t in number], np.int64)
    items = [(item, np.array(sorted(number[t] for t in terms if t in number), np.int64)) for item, terms in queries.items()]
    sent = index.shards.sparkSession.sparkContext.broadcast((list(number), weights, items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, items = sent.value
        names = pa.array(names, pa.string())
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for b in batches:
            for r in range(b.num_rows):
                ids, starts, docs, impact = (np.frombuffer(_bytes(b, c, r), t) for c, t in (("ids", np.int64), ("starts", np.int32), ("docs", np.int32), ("impacts", np.int32)))
                place = np.full(len(names), -1)
                have, there = _found(names, _bytes(b, "terms", r))
                place[have] = there
                for q, (_, terms) in enumerate(items):
                    score = np.zeros(len(ids), np.int64)
                    for t in terms[place[terms] >= 0]:
                        s, e = starts[place[t]], starts[place[t] + 1]
                        score[docs[s:e]] += weights[t] * impact[s:e]
                    ahead = np.flatnonzero(score >= max(1, top[q][0][-1] if len(top[q][0]) == k else 1))
                    if len(ahead):
                        all_scores, all_ids = np.append(top[q][0], score[ahead]), np.append(top[q][1], ids[ahead])
                        at = best(all_scores, all_ids, k)
                        top[q] = all_scores[at], all_ids[at]
        owner = np.repeat(np.arange(len(items)), [len(s) for s, _ in top])
        scores, ids = (np.concatenate([np.zeros(0, np.int64), *(x[c] for x in top)]) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in items], to_arrow_type(item_type)).take(pa.array(owner)), pa.array(ids, mask=ids == NO_ID), pa.array(scores)], names=["item_id", "doc_id", "score"])

    schema = StructType([StructField("item_id", item_type), StructField("doc_id", LongType()), StructField("score", LongType())])
    return mapped(index.shards, run, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(1)):
                names, code, doc = coded_terms(data, offsets, BREAKS)
                pairs = np.unique(doc * max(1, len(names)) + code)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(pairs // max(1, len(names)))), names.take(pa.array(pairs % max(1, len(names))))], names=["item_id", "term"])

    rows = items.select("item_id", F.col("text").cast("string").alias("text"))
    return mapped(rows, run, StructType([rows.schema["item_id"], StructField("term", rows.schema["text"].dataType)])).distinct()


def search(index: Index, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item."""
    pairs = written(item_terms(items), "lexical-items")
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    found = None
    for block in range(blocks):
        queries: dict = {}
        for r in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            queries.setdefault(r["item_id"], []).append(r["term"])
        rows = _search(index, items.schema["item_id"].dataType, queries, k)
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
