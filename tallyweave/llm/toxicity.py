"""Toxicity by multiple-instance learning: a document is a bag of sentences, of which one toxic sentence is enough.

A sentence's score is a logistic function of its character n-grams (3 to 5 code points of words and their edges,
hashed to BUCKETS); a document's is the noisy-or of its sentences' scores, 1 - prod(1 - s). Only documents have labels:
the gradient of the noisy-or tells how much each sentence answers for its document's, so the sentences that make a
document toxic come out of the training, and are told by place.

The fit uses a sample of labelled documents chosen by a hash of doc_id, about ROWS of each label and CHARS characters of
each label at most; a label of which fewer are chosen weighs more, so that shares stay the corpus'. Executors count in
how many sampled documents of each label each n-gram is, and the FEATURES n-grams that tell labels apart best (by the
likelihood ratio) are the features. What is collected is their places in the sampled sentences. The weights are fitted
on the driver by full-batch gradients with momentum (Adam), and a soft threshold that leaves most of them at zero.

Prediction reads every whole text: three table lookups a character and sums by sentence and by document.

Defined results: null and empty texts, and texts without a word, have score 0; so have all texts where the sample
has no document of one of the labels; equal texts get equal scores, also in rows that repeat; a label counts as 1 if one
of a document's label rows is 1, and null labels are none; a null doc_id has no label and is not held out; a text without
sentence ends is one sentence, however long; extra columns of any name are carried in `row`; an empty table gives an
empty result; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tallyweave.llm.langid import code_points, held_out
from tallyweave.llm.textnp import chunks, mix
from tallyweave.staging import mapped, written

BUCKETS, ORDERS = 1 << 20, (3, 4, 5)
ROWS, CHARS, FEATURES, LEAST = 4000, 6_000_000, 2048, 3
RATE, BIAS = 0.1, -4.0
#: Steps of the fit and the threshold's strength in them.
PHASES = ((60, 1e-4), (140, 1e-4), (100, 0.0))
#: From this score a document is predicted toxic, and a sentence is an offending one.
TOXIC, OFFENDING = 0.7, 0.5
ENDS = ".!?\n。！？"


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Of each code point of the basic plane: its lower case where that is one code point, 0 where it is no part of a word."""
    lower = [chr(i).lower() for i in range(1 << 16)]
    table = np.array([ord(c) if len(c) == 1 else i for i, c in enumerate(lower)], np.uint32)
    table[[i for i in range(0x80) if not chr(i).isalnum()]] = 0
    table[[ord(c) for c in ENDS]] = 0
    return table


@dataclass
class Bags:
    """Sentences of a chunk of documents. Symbols stand with one 0 before each document and one after the last, so each
    sentence has an edge before it: the place of its document's 0, or of the sentence end before it."""

    symbols: np.ndarray
    heads: np.ndarray  # the edge before each sentence, then the end
    document: np.ndarray  # of each sentence
    offset: np.ndarray  # of each document's 0
    full: np.ndarray  # whether a sentence has a word


def bags(data: np.ndarray, offsets: np.ndarray) -> Bags:
    points, first = code_points(data, offsets)
    n = len(first) - 1
    offset = first[:-1] + np.arange(n)
    padded = np.zeros(len(points) + n + 1, np.uint32)
    at = np.arange(len(points)) + np.repeat(np.arange(1, n + 1), np.diff(first))
    padded[at] = points
    ends = np.isin(padded, np.array([ord(c) for c in ENDS], np.uint32))
    heads = np.union1d(offset, np.flatnonzero(ends))
    small = padded < (1 << 16)
    symbols = np.where(small, _symbols()[np.where(small, padded, 0)], padded)
    full = np.maximum.reduceat(symbols > 0, heads) if n else np.zeros(0, bool)
    return Bags(symbols, np.append(heads, len(padded) - 1), np.searchsorted(offset, heads, "right") - 1, offset, full)


def ngrams(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """Of each order: the bucket of the n-gram at every place, BUCKETS where it is not within one word and its edges."""
    wide, value = symbols.astype(np.uint64), symbols.astype(np.uint64)
    word = symbols > 0
    inner = np.ones(len(symbols), bool)
    for order in range(2, max(ORDERS) + 1):
        n = max(0, len(symbols) - order + 1)
        value = value[:n] * np.uint64(0x110001) + wide[order - 1 : order - 1 + n]
        if order > 2:
            inner = inner[:n] & word[order - 2 : order - 2 + n]  # all symbols but the first and the last
        if order in ORDERS:
            bucket = (mix(value + np.uint64(order << 60)) >> np.uint64(44)).astype(np.int32)
            yield np.where(inner[:n], bucket, BUCKETS)


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS + 1, the last one 0
    bias: float

    def sentences(self, b: Bags) -> np.ndarray:
        """The score of each sentence; 0 for one without a word."""
        z = np.full(len(b.document), self.bias)
        for bucket in ngrams(b.symbols):
            inside = b.heads[:-1] < len(bucket)
            if inside.any():
                z[inside] += np.add.reduceat(self.weights.take(bucket), b.heads[:-1][inside])
        return np.where(b.full, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0)


def noisy_or(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1 - prod(1 - s) over runs of scores that begin at `first`."""
    return -np.expm1(np.add.reduceat(np.log1p(-np.minimum(scores, 1 - 1e-12)), first))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame | None:
    """(text, toxic, weight): the sample that a fit uses, of documents that are not held out; None if it lacks a label."""
    marks = labels.where("toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = {r["toxic"]: r for r in texts.select("doc_id", F.char_length("text").alias("chars")).join(marks, "doc_id").groupBy("toxic").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()}
    if not {0, 1} <= set(sizes):
        return None
    rate = {y: min(1.0, rows / sizes[y]["n"], chars / max(1, sizes[y]["chars"])) for y in (0, 1)}
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30))
    wanted = F.when(F.col("toxic") == 1, F.lit(int((1 << 30) * rate[1]))).otherwise(F.lit(int((1 << 30) * rate[0])))
    chosen = texts.join(F.broadcast(marks.where(place < wanted)), "doc_id")  # about 2 ROWS ids
    return written(chosen.select("text", "toxic", F.when(F.col("toxic") == 1, F.lit(1 / rate[1])).otherwise(F.lit(1 / rate[0])).alias("weight"), F.xxhash64("doc_id", "text").alias("place")), "toxicity-sample")


def features(sample: DataFrame) -> np.ndarray:
    """The buckets that tell labels apart best, in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), np.int64)
        for b in batches:
            toxic = b.column(1).to_numpy()
            for i, j, data, offsets in chunks(b.column(0)):
                bag = bags(data, offsets)
                for bucket in ngrams(bag.symbols):
                    doc = np.searchsorted(bag.offset, np.arange(len(bucket)), "right") - 1
                    once = np.unique(doc * (BUCKETS + 1) + bucket)
                    for y in (0, 1):
                        counts[y] += np.bincount((once % (BUCKETS + 1))[toxic[i:j][once // (BUCKETS + 1)] == y], minlength=BUCKETS + 1)
        at = np.flatnonzero(counts[:, :BUCKETS].any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["bucket", "clean", "toxic"])

    rows = mapped(sample.select("text", "toxic"), run, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")).where(F.col("a") + F.col("b") >= LEAST)
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    a, b, both = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    total = n.get(0, 0) + n.get(1, 0)
    ratio = sum((part(x, e) for x, e in ((a, both * n.get(0, 0) / total), (b, both * n.get(1, 0) / total), (n.get(0, 0) - a, (total - both) * n.get(0, 0) / total), (n.get(1, 0) - b, (total - both) * n.get(1, 0) / total))), F.lit(0.0))
    best = rows.select("bucket", F.round(ratio, 9).alias("ratio")).orderBy(F.desc("ratio"), "bucket").limit(FEATURES)
    return np.array(sorted(r["bucket"] for r in best.collect()), np.int64)


@dataclass
class Examples:
    """Sentences in compressed sparse rows of features, and documents as runs of sentences."""

    feature: np.ndarray
    sentence: np.ndarray  # of each feature
    first: np.ndarray  # sentence of each document
    toxic: np.ndarray
    weight: np.ndarray


def examples(sample: DataFrame, chosen: np.ndarray) -> Examples | None:
    """The chosen features of the sampled sentences, in the order of `place`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(BUCKETS + 1, -1, np.int32)
        number[chosen] = np.arange(len(chosen))
        for b in batches:
            for i, j, data, offsets in chunks(b.column(0)):
                bag = bags(data, offsets)
                kept = np.cumsum(bag.full) - 1  # numbers of sentences with a word
                found, where = [], []
                for bucket in ngrams(bag.symbols):
                    f = number[bucket]
                    at = np.flatnonzero(f >= 0)
                    found.append(f[at])
                    where.append(np.searchsorted(bag.heads, at, "right") - 1)
                feature, sentence = np.concatenate(found), np.concatenate(where)
                order = np.argsort(sentence, kind="stable")
                feature, sentence = feature[order], sentence[order]
                bounds = np.searchsorted(bag.document, np.arange(j - i + 1))
                cut = np.searchsorted(sentence, bounds)
                base = np.append(0, kept + 1)[bounds]
                out = [(feature[s:e].tobytes(), (kept[sentence[s:e]] - k).astype(np.int32).tobytes(), int(m - k)) for s, e, k, m in zip(cut, cut[1:], base, base[1:])]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in (1, 2, 3)), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int64())], names=["toxic", "weight", "place", "feature", "sentence", "sentences"])

    rows = mapped(sample.select("text", "toxic", "weight", "place"), run, "toxic int, weight double, place long, feature binary, sentence binary, sentences long").where("sentences > 0").collect()
    rows.sort(key=lambda r: (r["place"], r["toxic"]))
    if len({r["toxic"] for r in rows}) < 2:
        return None
    first = np.concatenate([[0], np.cumsum([r["sentences"] for r in rows])])
    sentence = [np.frombuffer(r["sentence"], np.int32).astype(np.int64) + s for r, s in zip(rows, first)]
    return Examples(np.concatenate([np.frombuffer(r["feature"], np.int32) for r in rows]), np.concatenate(sentence), first, np.array([r["toxic"] for r in rows], float), np.array([r["weight"] for r in rows]))


def ascend(x: Examples, w: np.ndarray, epochs: int, l1: float) -> np.ndarray:
    """Weights of the features, then the bias, after some steps of the noisy-or's likelihood and a soft threshold."""
    count, n = len(w) - 1, int(x.first[-1])
    m, v = np.zeros(count + 1), np.zeros(count + 1)
    share = x.weight / x.weight.sum()
    for step in range(1, epochs + 1):
        z = np.bincount(x.sentence, w[x.feature], n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        p = np.clip(noisy_or(s, x.first[:-1]), 1e-9, 1 - 1e-9)
        answers = np.repeat(share * np.where(x.toxic == 1, -(1 - p) / p, 1.0), np.diff(x.first)) * s
        g = np.append(np.bincount(x.feature, answers[x.sentence], count), answers.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        size = RATE / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = w - size * m / (1 - 0.9**step)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - size[:-1] * l1, 0)
    return w


def fit(x: Examples, count: int) -> tuple[np.ndarray, float]:
    """Weights of the features, and the bias: with the threshold on all features, then on those that are left of them,
    then without it, as the threshold also takes from the weights that it leaves."""
    w, kept, out = np.append(np.zeros(count), BIAS), np.arange(count), np.zeros(count)
    for epochs, l1 in PHASES:
        w = ascend(x, w, epochs, l1)
        left = np.flatnonzero(w[:-1])
        number = np.full(count, -1)
        number[left] = np.arange(len(left))
        inside = number[x.feature] >= 0
        x = Examples(number[x.feature[inside]], x.sentence[inside], x.first, x.toxic, x.weight)
        w, kept, count = np.append(w[left], w[-1]), kept[left], len(left)
    out[kept] = w[:-1]
    return out, float(w[-1])


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of the labels of documents that are not held out."""
    sample = labelled(docs, labels)
    if sample is None:
        return None
    chosen = features(sample)
    found = examples(sample, chosen)
    if found is None:
        return None
    weights, bias = fit(found, len(chosen))
    table = np.zeros(BUCKETS + 1, np.float32)
    table[chosen] = weights
    return Model(table, bias)


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, score, offending) for each row: row is a struct of all its columns; offending are the sentences of a high
    score, from and to a code point (end exclusive), in order."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            row = b.column(0)
            score, where = np.zeros(b.num_rows), [[]] * b.num_rows
            for i, j, data, offsets in chunks(row.field(row.type.get_field_index("text"))) if m else ():
                bag = bags(data, offsets)
                s = m.sentences(bag)
                score[i:j] = noisy_or(s, np.searchsorted(bag.document, np.arange(j - i)))
                for k in np.flatnonzero(s >= OFFENDING):
                    doc, start = bag.document[k], bag.heads[k] - bag.offset[bag.document[k]]
                    end = bag.heads[k + 1] - bag.offset[doc] - 1
                    where[i + doc] = [*where[i + doc], {"start": int(start), "end": int(end), "score": float(s[k])}]
            yield pa.RecordBatch.from_arrays([row, pa.array(score), pa.array(where, pa.list_(span))], names=["row", "score", "offending"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    sentence = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())])
    return mapped(rows, run, StructType([rows.schema["row"], StructField("score", DoubleType()), StructField("offending", ArrayType(sentence))]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, held_out, score, predicted, offending): learns from documents that are not held out, scores all."""
    found = scores(docs, learn(docs, labels))
    return found.select("row", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "offending")
