"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of code points (ASCII letters in lower case), hashed to BUCKETS. A feature's value
is its share of the text's n-grams times its inverse document frequency in the fitting sample. The model is
trained by follow-the-regularised-leader with elastic-net penalties, which leaves most weights at zero, and its
logits are divided by a temperature fitted on documents kept out of the training.

The fit is on the driver, on a bounded sample: about PER_LANGUAGE documents of each of the LANGUAGES most frequent
languages, chosen by a hash of doc_id (all of them where there are fewer). Executors count the n-grams of the chosen
texts, so what is collected is at most BUCKETS numbers a document, however long it is. Prediction reads every whole
text; its cost is one table lookup for each n-gram, as the features enter the logits linearly.

A model also tells what it does not know: `known` is the share of a text's n-grams that the sample holds. Its
documents kept out of the training set two limits, each on the way from what chance gives (1 in k languages; the
share of buckets in use) to what nearly all of those documents reach: a quarter of it for the score, as a text of
two learned languages is not unknown, and half of it for `known`. Texts below one of them are of no learned language;
`recognised` says so, and the contract's lang_pred stays the likeliest language.

Defined results: null text, and text without a letter, is `und` with score 0; without any labelled row all texts
are `und`; equal texts get equal predictions, also in rows that repeat; of equally likely languages the first by
name is told; a null doc_id is not held out; texts of any length are read whole; lang, source and doc_id are no
inputs of a prediction; extra columns of any name are carried in `row`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tallyweave.llm.bpe import LETTER, _classes
from tallyweave.llm.textnp import chunks, mix
from tallyweave.staging import mapped

BUCKETS, ORDERS, PER_LANGUAGE, LANGUAGES, EPOCHS = 1 << 16, 3, 600, 256, 3
ALPHA, BETA, L1, L2, SCALE = 0.5, 1.0, 0.002, 0.02, 30.0
#: One of CALIBRATE documents of the sample is kept for the temperature.
CALIBRATE = 5
#: Share of those documents that may fall short of what sets the limits, and how far towards it the limits are.
OUTLIERS, SCORE_WAY, KNOWN_WAY = 0.01, 0.25, 0.5


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk of UTF-8 documents, and the n+1 offsets of the documents."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, heads[offsets]


def ngram_buckets(points: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
    """For each order: bucket of the n-gram at every place, BUCKETS where it leaves its document."""
    lower = np.where((points >= 0x41) & (points <= 0x5A), points + 0x20, points).astype(np.uint64)
    value = np.zeros(len(points), np.uint64)
    for order in range(1, ORDERS + 1):
        n = len(points) - order + 1
        if n <= 0:
            return
        value = value[:n] * np.uint64(0x110001) + lower[order - 1 : order - 1 + n] + np.uint64(1)
        bucket = (mix(value + np.uint64(order << 60)) >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1)
        for back in range(1, order):  # the last places of each document
            at = first[1:] - back
            bucket[at[(at >= first[:-1]) & (at < n)]] = BUCKETS
        yield bucket


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): idf times weight
    bias: np.ndarray
    temperature: float
    seen: np.ndarray  # of each bucket: whether the sample has an n-gram there
    least_score: float = 0.0
    least_known: float = 0.0

    def columns(self) -> list[np.ndarray]:
        """The weights of each language, and whether a bucket is in use, each with a 0 for the place past the buckets."""
        if "_columns" not in self.__dict__:
            self._columns = [np.append(c, 0.0) for c in (*self.table.T, self.seen)]
        return self._columns

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of each document, whether it has a letter, and the share of its n-grams that are known."""
        points, first = code_points(data, offsets)
        columns = self.columns()
        sums, count = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        full = np.flatnonzero(np.diff(first))
        letters, known = np.zeros(len(offsets) - 1, bool), np.zeros(len(offsets) - 1)
        if len(full):
            heads = first[:-1][full]
            letters[full] = np.maximum.reduceat(_classes()[points] == LETTER, heads)
            for order, bucket in enumerate(ngram_buckets(points, first), 1):
                h = heads[heads < len(bucket)]
                f = full[: len(h)]
                count += np.maximum(np.diff(first) - order + 1, 0)
                for k in range(len(self.languages)):
                    sums[f, k] += np.add.reduceat(columns[k].take(bucket), h)
                known[f] += np.add.reduceat(columns[-1].take(bucket), h)
        return sums * (SCALE / np.maximum(count, 1))[:, None] + self.bias, letters, known / np.maximum(count, 1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: An example: the buckets of its n-grams, how often it has each, and its language.
Example = tuple[np.ndarray, np.ndarray, str]


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts of the n-grams of each document."""
    for s, e in zip(offsets, offsets[1:]):
        points, first = code_points(data[s:e], np.array([0, e - s]))
        found = [bucket[bucket < BUCKETS] for bucket in ngram_buckets(points, first)]
        yield np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)


def fit(rows: list[Example]) -> Model:
    """A model from examples in a fixed order."""
    languages = sorted({lang for *_, lang in rows})
    held = [(ids, n * (SCALE / max(1, n.sum())), languages.index(lang)) for ids, n, lang in rows]
    df = np.zeros(BUCKETS)
    for ids, _, _ in held:
        df[ids] += 1
    idf = np.log((1 + len(held)) / (1 + df)) + 1
    k = len(languages)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    train = [x for i, x in enumerate(held) if i % CALIBRATE] or held
    order = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for i in order.permutation(len(train)):
            ids, share, y = train[i]
            at = np.append(ids, BUCKETS)  # the last row is the bias
            x = np.append(share * idf[ids], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    kept = held[::CALIBRATE]
    logits = np.array([(share * idf[ids]) @ w[ids] + w[-1] for ids, share, _ in kept])
    y = np.array([x[2] for x in kept])
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    temperature = float(min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss))
    used = np.zeros(BUCKETS, bool)
    used[np.concatenate([ids for ids, *_ in train])] = True
    known = [(share * used[ids]).sum() / max(share.sum(), 1e-9) for ids, share, _ in kept]
    limits = [chance + way * (np.quantile(x, OUTLIERS) - chance) for chance, x, way in ((1 / k, softmax(logits / temperature).max(1), SCORE_WAY), (used.mean(), known, KNOWN_WAY))]
    return Model(languages, w[:-1] * idf[:, None], w[-1], temperature, used, *map(float, limits))


def training_sample(docs: DataFrame, usable=None) -> list[Example]:
    """About PER_LANGUAGE labelled texts of each language as examples, by a hash of doc_id, in that hash's order."""
    rows = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    if usable is not None:
        rows = rows.where(usable)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30))
    wanted = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(int((1 << 30) * min(1.0, PER_LANGUAGE / r["n"])))) for r in counts])
    chosen = rows.withColumn("place", place).where(F.col("place") < wanted).select("place", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(2)):
                made = list(counted(data, offsets))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in (0, 1)), *(pa.array([x[c] for x in made], pa.list_(pa.int32())) for c in (0, 1))], names=["place", "lang", "ids", "counts"])

    found = mapped(chosen, run, "place long, lang string, ids array<int>, counts array<int>").collect()
    return [(np.array(r["ids"], np.int64), np.array(r["counts"], np.int64), r["lang"]) for r in sorted(found)]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(row, lang_pred, score, recognised) for each row; row is a struct of all its columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows for each language, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            row = b.column(0)
            names = np.full(b.num_rows, "und", object)
            scores, sure = np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            for i, j, data, offsets in chunks(row.field(row.type.get_field_index("text"))) if m else ():
                logits, letters, known = m.logits(data, offsets)
                p = softmax(logits / m.temperature)
                best = p.argmax(1)
                names[i:j] = np.where(letters, np.array(m.languages, object)[best], "und")
                scores[i:j] = np.where(letters, p[np.arange(j - i), best], 0.0)
                sure[i:j] = letters & (scores[i:j] >= m.least_score) & (known >= m.least_known)
            yield pa.RecordBatch.from_arrays([row, pa.array(names, pa.string()), pa.array(scores), pa.array(sure)], names=["row", "lang_pred", "score", "recognised"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return mapped(rows, run, StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("recognised", BooleanType())]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is for testing alone; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(row, held_out, lang_pred, score, recognised): learns from documents that are not held out, predicts all."""
    rows = training_sample(docs, ~held_out(F.col("doc_id")))
    return predict(docs, fit(rows) if rows else None).select("row", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", "recognised")
