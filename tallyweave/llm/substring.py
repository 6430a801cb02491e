"""Removal of passages that repeat across documents, by suffix automata of reference shards.

The reference of a corpus is the corpus itself, so its automata cannot be one broadcast of bounded size. It is cut
into shards by content, and the documents' passages are dealt to the shards that can match them:

1. Every window of `window` words has an anchor: the smallest hash among its ANCHOR-word runs. Equal windows have
   equal anchors, so a shard (all passages around one anchor) holds every match of its windows. A passage is a
   run of windows with one anchor. Anchors that one document alone has are dropped, which is most of the corpus.
2. Passages that are equal word for word fold into the one of the smallest doc_id (a combinable minimum); the
   windows of the others are removable. The anchors that still have different passages make the shards.
3. A shard's automaton is built over its passages in ascending doc_id, each state keeping the first document
   that holds its strings; the passages then stream through it. The matching statistic at a word, cut to
   `window`, names the state and so the first document of that window; windows with a smaller one are removable.
4. An anchor of over SHARD passages (a passage that a third of all documents share has that many contexts) or over
   SHARD_WORDS words makes no shard. Its passages are cut into parts by the anchor's place in the window, and step
   2 folds these again: parts inside the shared passage fold, the others have few rivals and make shards. Parts
   that are still too many or too long go window by window through a combinable minimum, which no key can skew. So
   a task holds the automaton of SHARD_WORDS words at most, about 1 kB each.

Equality of passages, parts and windows is that of two 64-bit hashes each, 128 bits together: among 10**13 of them
the chance that any two different ones are taken for equal is below 10**-12.

`remove_reference` is the plain form for another table as the reference, such as a benchmark: it is cut into shards
of about REFERENCE_WORDS words, the automaton of one after the other is broadcast, and all documents stream through.

Defined results: null text and text of under `window` words lose nothing; rows with a null doc_id lose nothing
and are no reference; rows of one doc_id are one document and do not remove each other's words; texts of any
length are read whole; of equal texts the one of the smallest doc_id keeps its words; an empty table gives an
empty result; only doc_id and text are read, other columns are carried in `row`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyweave.llm.minhash import grouped_rows
from tallyweave.llm.textnp import _power, chunks, inside, mix, ngram_hashes, span_hashes, words
from tallyweave.staging import mapped, written

ANCHOR, SHARD, PART, SHARD_WORDS = 20, 256, 8, 1 << 17
#: Words of a reference whose automaton is broadcast at once (about 1 kB each).
REFERENCE_WORDS = 100_000
#: Turns a word's hash into its second one.
_SECOND = np.uint64(0x5851F42D4C957F2D)


class SuffixAutomaton:
    """Suffix automaton of several sequences; each state knows the first label that was added with its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len, self.label = [-1], [0], [None]

    def _state(self, length: int, label, edges: dict) -> int:
        self.next.append(edges)
        self.len.append(length)
        self.link.append(0)
        self.label.append(label)
        return len(self.len) - 1

    def add(self, sequence: Sequence, label) -> None:
        last = 0
        for item in sequence:
            known = self.next[last].get(item)
            if known is not None and self.len[known] == self.len[last] + 1:
                last = known
                continue
            new = None if known is not None else self._state(self.len[last] + 1, label, {})
            p = last
            while new is not None and p >= 0 and item not in self.next[p]:
                self.next[p][item] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
                last = new
                continue
            q = self.next[p][item]
            if self.len[q] == self.len[p] + 1:
                target = q
            else:
                target = self._state(self.len[p] + 1, self.label[q], dict(self.next[q]))
                self.link[target] = self.link[q]
                self.link[q] = target
                while p >= 0 and self.next[p].get(item) == q:
                    self.next[p][item] = target
                    p = self.link[p]
            if new is None:
                last = target
            else:
                self.link[new] = target
                last = new

    def windows(self, sequence: Sequence, window: int) -> Iterator[tuple[int, object]]:
        """(start, first label) of each window of the sequence that occurs, by matching statistics cut to `window`."""
        state = length = 0
        nexts, link, size, label = self.next, self.link, self.len, self.label
        for i, item in enumerate(sequence):
            while state and item not in nexts[state]:
                state = link[state]
                length = size[state]
            state = nexts[state].get(item, 0)
            length = length + 1 if state else 0
            while state and size[link[state]] >= window:
                state = link[state]
                length = size[state]
            if length >= window:
                yield i - window + 1, label[state]


def _runs(marks: list[int]) -> list[tuple[int, int]]:
    """Runs (first, end) of ascending integers."""
    out: list[list[int]] = []
    for x in marks:
        if out and out[-1][1] == x:
            out[-1][1] = x + 1
        else:
            out.append([x, x + 1])
    return [(a, b) for a, b in out]


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, content, proof, doc_id, tag, pos, n): runs of n windows from word `pos` with one anchor; content and proof
    are hashes of its words."""
    reach = window - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = (b.column(k) for k in (0, 1))
            for i, j, data, offsets in chunks(b.column(2)):
                starts, ends, first = words(data, offsets)
                hashes = span_hashes(data, starts, ends)
                grams = ngram_hashes(hashes, ANCHOR)
                n = len(hashes) - window + 1
                if n <= 0:
                    continue
                low, width = grams, 1
                while 2 * width <= reach:
                    low, width = np.minimum(low[: len(low) - width], low[width:]), 2 * width
                low = np.minimum(low[:n], low[reach - width : reach - width + n])
                ok = np.flatnonzero(inside(first, window))
                low = low[ok]
                owner = np.searchsorted(first, ok, "right") - 1
                head = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (ok[1:] != ok[:-1] + 1) | (owner[1:] != owner[:-1])])) if len(ok) else ok
                size = np.diff(np.append(head, len(ok)))
                at, owner = ok[head], owner[head]
                up, down = _power(len(hashes) + 1)
                end = at + size + window - 1
                both = []
                for items in (hashes, mix(hashes ^ _SECOND)):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(items * up[: len(items)])])
                    both.append(pa.array(mix((sums[end] - sums[at]) * down[at] + size.astype(np.uint64)).view(np.int64)))
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low[head].view(np.int64)), *both, ids.slice(i, j - i).take(rows), tags.slice(i, j - i).take(rows), pa.array((at - first[:-1][owner]).astype(np.int32)), pa.array(size.astype(np.int32))],
                    names=["anchor", "content", "proof", "doc_id", "tag", "pos", "n"],
                )

    return mapped(docs.where("doc_id is not null"), run, "anchor long, content long, proof long, doc_id long, tag long, pos int, n int")


def _parts(grams: np.ndarray, anchor: int, n: int) -> Iterator[tuple[int, int, int]]:
    """(first window, end window, group): cuts a run of n windows where their anchor's place in them enters another
    group of PART places. The place depends on the window's words alone, so equal windows are in equal groups."""
    places = np.flatnonzero(grams == anchor)
    at = places[np.searchsorted(places, np.arange(n))]
    group = (at - np.arange(n)) // PART
    cuts = np.flatnonzero((at[1:] != at[:-1]) | (group[1:] != group[:-1])) + 1
    heads = [0, *cuts.tolist(), n]
    for s, e in zip(heads, heads[1:]):
        yield s, e, int(group[s])


def _signed(data: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


PASSAGE = "key long, content long, proof long, doc_id long, tag long, places array<int>, n int, passage binary, windows array<long>, proofs array<long>"


def passages(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted runs. Runs whose anchor is in over SHARD passages are cut into parts, which carry a key
    of their own, hashes of their content and of their windows, which are null of other runs.
    Equal parts of one document are one row with all their places, as a line can repeat many times in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            lists = b.column(3).to_pylist()
            for i, j, data, offsets in chunks(b.column(2)):
                starts, ends, first = words(data, offsets)
                grams = whole = proofs = None
                raw = data.tobytes()
                for r in range(i, j):
                    base = int(first[r - i])
                    key = (b.column(0)[r].as_py(), b.column(1)[r].as_py())
                    parts: dict[tuple[int, int], tuple] = {}
                    for x in lists[r]:
                        s, n = base + x["pos"], x["n"]
                        if x["members"] <= SHARD:
                            out.append((x["anchor"], None, None, *key, [x["pos"]], n, raw[starts[s] : ends[s + n + window - 2]], None, None))
                            continue
                        if grams is None:
                            hashes = span_hashes(data, starts, ends)
                            grams, whole = (ngram_hashes(hashes, k).view(np.int64) for k in (ANCHOR, window))
                            proofs = ngram_hashes(mix(hashes ^ _SECOND), window).view(np.int64)
                        for low, high, group in _parts(grams[s : s + n + window - ANCHOR], x["anchor"], n):
                            text = b" ".join(raw[starts[s + low] : ends[s + high + window - 2]].split())
                            part = (_signed(b"%d %d" % (x["anchor"], group))[0], *_signed(text))
                            if part not in parts:
                                parts[part] = (*part, *key, [], high - low, text, *(h[s + low : s + high].tolist() for h in (whole, proofs)))
                            parts[part][5].append(x["pos"] + low)
                    out += parts.values()
                    if len(out) > 20_000 or r == b.num_rows - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=names)
                        out = []

    names = ["key", "content", "proof", "doc_id", "tag", "places", "n", "passage", "windows", "proofs"]
    kinds = [*[pa.int64()] * 5, pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    by_doc = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "members", "pos", "n")).alias("runs"))
    # Documents are no skewed key, so the sides are dealt by them outright; each task then makes about as many rows.
    key = ["doc_id", "tag"]
    return mapped(docs.repartition(*key).join(by_doc.repartition(*key), key).select("doc_id", "tag", "text", "runs"), run, PASSAGE)


SPAN = "doc_id long, tag long, places array<int>, low int, high int"
SPAN_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32())


def matched(found: DataFrame, window: int) -> DataFrame:
    """Spans (words place + low to place + high) of windows that a document of a smaller doc_id has, from the automata
    of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_rows(batches, 1):
            automaton, held, out = SuffixAutomaton(), [], []
            for _, doc, tag, places, text in rows:
                held.append((doc, tag, places, text.split()))
                automaton.add(held[-1][3], doc)
            for doc, tag, places, items in held:
                out += [(doc, tag, places, a, b + window - 1) for a, b in _runs([k for k, first in automaton.windows(items, window) if first < doc])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SPAN_TYPES)], names=["doc_id", "tag", "places", "low", "high"])

    return mapped(found.repartition("key").sortWithinPartitions("key", "doc_id", "tag"), run, SPAN)


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, n_words, n_removed, kept) of rows (doc_id, tag, row); kept is the words outside the spans, joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, lists = b.column(0), b.column(1).to_pylist()
            for i, j, data, offsets in chunks(row.field(row.type.get_field_index("text"))):
                starts, ends, first = words(data, offsets)
                cover = np.zeros(len(starts) + 1, np.int64)
                for r in range(i, j):
                    if lists[r]:
                        base = first[r - i]
                        np.add.at(cover, [base + p + x["low"] for x in lists[r] for p in x["places"]], 1)
                        np.add.at(cover, [base + p + x["high"] for x in lists[r] for p in x["places"]], -1)
                keep = np.cumsum(cover[:-1]) == 0
                count = np.concatenate([[0], np.cumsum(keep)])
                size = (ends - starts)[keep]
                at, dense = np.concatenate([[0], np.cumsum(size + 1)]), np.cumsum(size) - size
                flat = np.full(at[-1], 0x20, np.uint8)
                each = np.arange(size.sum())
                flat[np.repeat(at[:-1] - dense, size) + each] = data[np.repeat(starts[keep] - dense, size) + each]
                raw = flat.tobytes()
                lows, highs = at[count[first[:-1]]].tolist(), at[count[first[1:]]].tolist()
                kept = [raw[x : max(x, y - 1)].decode() for x, y in zip(lows, highs)]
                n, left = np.diff(first), np.diff(count[first])
                yield pa.RecordBatch.from_arrays([row.slice(i, j - i), pa.array(n, pa.int64()), pa.array(n - left, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_words", "n_removed", "kept"])

    by_doc = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("places", "low", "high")).alias("spans"))
    kind = StructType([docs.schema["row"], *(StructField(c, t) for c, t in (("n_words", LongType()), ("n_removed", LongType()), ("kept", StringType())))])
    return mapped(docs.join(by_doc, ["doc_id", "tag"], "left").select("row", "spans"), run, kind)


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """Spans over the rows (doc_id, tag, text): words that windows of earlier documents cover."""
    found = written(anchors(docs, window), "anchors")
    shared = written(found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor"), "shared")
    marks = written(found.join(shared, "anchor"), "marks")
    later, firsts = folded(marks, "anchor", window)
    texts = written(passages(docs, firsts.select("anchor", "members", "doc_id", "tag", "pos", "n"), window), "passages")
    rest, parts = folded(texts.where("content is not null"), "key", window)
    shards = [x.select("key", "doc_id", "tag", "places", "passage") for x in (texts.where("content is null"), parts.where(F.col("members") <= SHARD))]
    single = parts.where(F.col("members") > SHARD).select("doc_id", "tag", "places", F.posexplode(F.arrays_zip("windows", "proofs")).alias("low", "window"))
    single = written(single.select("doc_id", "tag", "places", "low", "window.windows", "window.proofs"), "windows")
    equal = ["windows", "proofs"]
    owners = written(single.groupBy(*equal).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select(*equal, "first"), "owners")
    hot = single.join(owners, equal).where("first < doc_id").select("doc_id", "tag", "places", "low", (F.col("low") + window).alias("high"))
    whole = [x.select("doc_id", "tag", places.alias("places"), F.lit(0).alias("low"), (F.col("n") + (window - 1)).alias("high")) for x, places in ((later, F.array("pos")), (rest, F.col("places")))]
    return whole[0].union(whole[1]).union(matched(shards[0].union(shards[1]), window)).union(hot)


def folded(runs: DataFrame, key: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Runs (key, content, proof, doc_id, n, …) that an earlier document has word for word; and of the others those
    whose key has several contents, with their number as `members`, which is over SHARD where they are too many words."""
    content = [key, "content", "proof"]
    firsts = written(runs.groupBy(*content).agg(F.min("doc_id").alias("first"), F.max("n").alias("size")), "firsts")
    size = F.sum((F.col("size") + (window - 1)).cast("long"))
    members = F.greatest(F.count("*"), F.when(size > SHARD_WORDS, F.lit(SHARD + 1)).otherwise(F.lit(0)))
    contested = written(firsts.groupBy(key).agg(members.alias("members"), F.count("*").alias("different")).where("different > 1").select(key, "members"), "contested")
    judged = written(runs.join(firsts.drop("size"), content), "judged")
    return judged.where("doc_id > first"), judged.where("doc_id = first").join(contested, key)


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as (doc_id, tag, text) and as (doc_id, tag, row); tag tells texts of one doc_id apart."""
    key = [docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("tag")]
    return docs.select(*key, docs["text"]), docs.select(*key, F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """(row, n_words, n_removed, kept) for each row of docs; row is a struct of all its columns."""
    texts, rows = _keyed(docs)
    return without(rows, repeated_spans(texts, window))


def reference_shards(reference: DataFrame, window: int, most: int) -> list[DataFrame]:
    """(text) rows of about `most` words each. Texts of over half that are cut into parts that overlap by window - 1 words."""
    words_ = F.filter(F.split(F.coalesce(reference["text"], F.lit("")), "[ \\x09-\\x0D]+"), lambda w: w != "")
    part = max(window, most // 2)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)), F.lit(part - window + 1))
    cut = reference.select(words_.alias("words")).where(F.size("words") >= window).withColumn("at", F.explode(starts))
    texts = written(cut.select(F.slice("words", F.col("at"), F.lit(part)).alias("words")).distinct().select(F.array_join("words", " ").alias("text"), F.size("words").alias("size")), "reference")
    n = -(-(texts.agg(F.sum("size")).first()[0] or 0) // most)
    if n < 2:
        return [texts.select("text")]
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(n)))
    return [dealt.where(F.col("shard") == k).select("text") for k in range(n)]


def reference_spans(docs: DataFrame, shard: DataFrame, window: int) -> DataFrame:
    """Spans of the rows (doc_id, tag, text) that windows of a shard cover; its automaton is broadcast."""
    automaton = SuffixAutomaton()
    for r in shard.toLocalIterator():
        automaton.add(r["text"].encode().split(), 0)
    sent = docs.sparkSession.sparkContext.broadcast((automaton.next, automaton.link, automaton.len, automaton.label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = SuffixAutomaton()
        held.next, held.link, held.len, held.label = sent.value
        for b in batches:
            out = []
            for doc, tag, text in zip(*(c.to_pylist() for c in b.columns)):
                found = _runs([k for k, _ in held.windows((text or "").encode().split(), window)])
                out += [(doc, tag, [0], a, e + window - 1) for a, e in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SPAN_TYPES)], names=["doc_id", "tag", "places", "low", "high"])

    return mapped(docs, run, SPAN)


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 50, most: int = REFERENCE_WORDS) -> DataFrame:
    """Like `remove_repeats`, of the words that windows of a reference (column text) cover. A pass over docs for each shard."""
    texts, rows = _keyed(docs.where("doc_id is not null"))
    spans = None
    for shard in reference_shards(reference, window, most):
        found = written(reference_spans(texts, shard, window), "spans")
        spans = found if spans is None else spans.union(found)
    nulls = _keyed(docs.where("doc_id is null"))[1]
    return without(rows.union(nulls), spans)


def digests(removed: DataFrame) -> DataFrame:
    return removed.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
