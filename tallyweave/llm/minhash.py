"""Near-duplicate components by min-max hashing, with links confirmed on full shingle sets.

1. Signatures. Each permutation (a random affine map of 64-bit shingle hashes) is evaluated once and gives two
   values, the minimum and the maximum, so 64 evaluations give 128 values of the lower variance of min-max
   hashing. 32 bands of 4 values (two minima, two maxima) miss a pair of similarity 0.8 once in 20 million.
2. Documents of equal shingle sets fold into one node (their smallest doc_id), by a combinable aggregate.
3. Nodes that share a band meet in that band's bucket. Each node is decided on full shingle sets against its hubs,
   the smallest and the largest node of its buckets. The components of these links, the labels, take a group of copies
   in one pass: its nodes are linked, so no pair of them needs to be looked at again.
4. Buckets that hold several labels are left. Blocks of the nodes outside the label of most of them meet each other
   and that label's blocks, which never meet among themselves. Signatures are compared there, and only the trees
   of the pairs of different labels whose estimate is within five standard errors of the threshold leave the
   bucket, as a star each: one edge a row, never all pairs.
5. The components of these edges are small clusters that hold every link between labels. In each cluster the pairs are
   decided on full shingle sets, again block against block: an inverted index over one block's shingles gives the
   intersections of a document with the whole block at once. Stars over the trees of true links leave.
6. Components of the links, and back to all documents.

Every table that grows with the corpus stays distributed; blocks bound what one task holds.

Defined results: null or empty text, or text without words, has no shingles and is linked with nothing; rows
that repeat a doc_id count as one document, whatever their texts; a row without a doc_id is linked with nothing,
has no component_id and is kept; texts of any length are read whole; of a component the smallest doc_id is kept, so
there are no ties; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.components import components
from tallyweave.llm.textnp import LOWER, chunks, inside, mix, ngram_hashes, span_hashes, words
from tallyweave.staging import mapped, written

PERMUTATIONS, BANDS = 64, 32
ROWS = 2 * PERMUTATIONS // BANDS
#: Nodes of a bucket that one task compares with each other.
BLOCK = 1024
#: Nodes of a hub that one task decides at once.
HUB_BLOCK = 32
#: Buckets that a node shares with its hub: of 32, a pair of similarity 0.8 shares 13 on average.
SHARED = BANDS // 4
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_SALT = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, and the n+1 offsets of the documents."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    n = len(offsets) - 1
    grams = ngram_hashes(hashes, width)
    ok = inside(first, width)
    owner = np.searchsorted(first, np.flatnonzero(ok), "right") - 1
    values = grams[ok]
    size = np.diff(first)
    for k in range(1, width):  # documents of fewer words: the whole sequence
        short = np.flatnonzero(size == k)
        if len(short):
            values = np.concatenate([values, ngram_hashes(hashes, k)[first[short]] ^ np.uint64(k)])
            owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(n + 1))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands, sig): set_key names the whole set; sig has the lowest byte of each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in chunks(b.column(1)):
                values, at = shingle_sets(data, offsets, width)
                n, size = j - i, np.diff(at)
                full = np.flatnonzero(size)
                sums = np.zeros((2, n), np.uint64)
                bands = np.zeros((len(full), BANDS), np.uint64)
                sig = np.zeros((len(full), 2 * PERMUTATIONS), np.uint8)
                if len(full):
                    heads = at[:-1][full]
                    for k, salt in enumerate((0x1234567, 0x7654321)):
                        sums[k, full] = np.add.reduceat(mix(values ^ np.uint64(salt)), heads)
                    for p in range(PERMUTATIONS):
                        v = values * _A[p] + _B[p]
                        for k, low in enumerate((np.minimum.reduceat(v, heads), np.maximum.reduceat(v, heads))):
                            low = mix(low)
                            sig[:, 2 * p + k] = low & np.uint64(0xFF)
                            band = (2 * p + k) // ROWS
                            bands[:, band] = mix(bands[:, band] * np.uint64(0x9E3779B97F4A7C15) + low + _SALT[band])
                keys = np.zeros((n, 16), np.uint8)
                keys[:, :8], keys[:, 8:] = (sums[k].view(np.uint8).reshape(n, 8) for k in (0, 1))
                none = size == 0
                where = np.concatenate([[0], np.cumsum(~none)])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, n),
                        pa.array(size, pa.int64()),
                        pa.array([None if x else keys[r].tobytes() for r, x in enumerate(none)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(where * BANDS, pa.int32()), pa.array(bands.view(np.int64).ravel())),
                        pa.array([None if x else sig[where[r]].tobytes() for r, x in enumerate(none)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "bands", "sig"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return mapped(rows, run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary")


class Trees:
    """Which rows of one block hang together: a tree number for each row."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, row: int, others: np.ndarray) -> None:
        found = np.unique(self.of[others])
        found = found[found != self.of[row]]
        if len(found):
            found = np.append(found, self.of[row])
            self.of[np.isin(self.of, found)] = found.min()

    def stars(self, ids: list[int]) -> list[tuple[int, int]]:
        """An edge from each row that has not the smallest id of its tree to that id."""
        least: dict[int, int] = {}
        trees = self.of.tolist()
        for i, t in zip(ids, trees):
            least[t] = min(i, least.get(t, i))
        return [(i, least[t]) for i, t in zip(ids, trees) if i != least[t]]


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal first `keys` columns, from batches sorted by them."""
    held, now = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:keys] != now:
                if held:
                    yield held
                held, now = [], row[:keys]
            held.append(row)
    if held:
        yield held


def block_pairs(nodes: DataFrame, per_block: str) -> DataFrame:
    """Each row once for each pair of blocks (low < high, or low = high) of its group that its block is part of.

    nodes: node, major, and the group's numbers of rows that are major and that are not (majors, minors). Major rows are
    linked already, so their blocks, the last of a group, meet only blocks of minor rows."""
    parts = nodes.withColumns({f"{k}_parts": F.expr(f"greatest(1, cast(ceil({k} / ({per_block})) as int))") for k in ("minors", "majors")})
    own = F.expr("cast(if(major, minors_parts + pmod(xxhash64(node, 5), majors_parts), pmod(xxhash64(node, 5), minors_parts)) as int)")
    dealt = parts.withColumn("own", own).withColumn("with", F.explode(F.expr("sequence(0, minors_parts - 1 + if(major, 0, majors_parts))")))
    return dealt.withColumn("low", F.least("own", "with")).withColumn("high", F.greatest("own", "with")).withColumn("side", F.expr("if(own = low, 0, 1)")).drop("minors_parts", "majors_parts", "with", "own")


def mixed(rows: DataFrame, group: str) -> DataFrame:
    """(group, major_label, majors, minors) of the groups that hold several labels: the label of most rows, how many
    have it and how many have not."""
    sizes = rows.groupBy(group, "label").agg(F.count("*").alias("n"))
    of = sizes.groupBy(group).agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("members"), F.count("*").alias("labels")).where("labels > 1")
    return of.select(group, F.col("most.label").alias("major_label"), F.col("most.n").alias("majors"), (F.col("members") - F.col("most.n")).alias("minors"))


def meetings(nodes: DataFrame) -> DataFrame:
    """(node, met): the buckets of several nodes that a node is in, BANDS at most, with their smallest and largest node."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    common = written(rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"), "buckets")
    return written(rows.join(common, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "low", "high")).alias("met")), "met")


def hub_links(docs: DataFrame, met: DataFrame, width: int, threshold: float) -> DataFrame:
    """Edges (a, b) between nodes and their hubs whose full sets are similar enough.

    A node's hubs are the smallest and the largest node that come up most often in its buckets, if in SHARED of them. A
    hub of many nodes meets them in parts of HUB_BLOCK."""

    def most_shared(end: str) -> Column:
        ends = F.col(f"met.{end}")
        counted = F.transform(F.array_distinct(ends), lambda hub: F.struct(F.size(F.filter(ends, lambda x: x == hub)).alias("n"), (-hub).alias("minus")))
        return F.array_max(counted)

    hubs = met.select("node", most_shared("low").alias("first"), most_shared("high").alias("second"))
    hubs = hubs.select("node", F.explode(F.array("first", F.when(-F.col("first.minus") != F.col("node"), F.col("second")))).alias("hub"))
    pairs = written(hubs.where(f"hub.n >= {SHARED}").select("node", (-F.col("hub.minus")).alias("hub")).where("hub <> node").distinct(), "hubs")
    groups = written(pairs.groupBy("hub").agg(F.expr(f"cast(ceil(count(*) / {HUB_BLOCK}) as int)").alias("parts")), "hub_parts")
    followers = pairs.join(groups, "hub").select(F.col("hub").alias("label"), F.expr("cast(pmod(xxhash64(node, 5), parts) as int)").alias("high"), F.lit(1).alias("side"), "node")
    heads = groups.select(F.col("hub").alias("label"), F.explode(F.expr("sequence(0, parts - 1)")).alias("high"), F.lit(0).alias("side"), F.col("hub").alias("node"))
    texts = docs.select(docs["doc_id"].cast("long").alias("node"), docs["text"]).join(followers.unionByName(heads), "node")
    return confirmed(texts.select("label", F.lit(-1).alias("low"), "high", "side", "node", "text"), width, threshold)


def likely_edges(nodes: DataFrame, labelled: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b): in each bucket, stars over the trees of the pairs of different labels whose estimate comes near the
    threshold. labelled: (node, label, met), the label of what is linked already."""
    rows = labelled.select("node", "label", F.explode("met.bucket").alias("bucket"))
    open_ = written(mixed(rows, "bucket"), "mixed")
    met = rows.join(open_, "bucket").select("node", "label", F.struct("bucket", (F.col("label") == F.col("major_label")).alias("major"), "majors", "minors").alias("at"))
    met = met.groupBy("node", "label").agg(F.collect_list("at").alias("met"))  # at most BANDS for each node
    met = nodes.select("node", "n_shingles", "sig").join(met, "node").select("node", "label", "n_shingles", "sig", F.inline("met"))
    dealt = block_pairs(met, str(BLOCK)).select("bucket", "low", "high", "side", "node", "n_shingles", "sig", "label")
    values = 2 * PERMUTATIONS
    floor = threshold - 5 * (threshold * (1 - threshold) / values) ** 0.5
    agree = values * (floor + (1 - floor) / 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in grouped_rows(batches, 3):
            same = rows_[0][1] == rows_[0][2]
            at = {s: [r for r in rows_ if r[3] == s] for s in (0, 1)}
            left, right = at[0], at[0] if same else at[1]
            ids = [r[4] for r in left] + ([] if same else [r[4] for r in right])
            if len(ids) < 2 or not left or not right:
                continue
            sig = [np.frombuffer(b"".join(r[6] for r in s), np.uint8).reshape(len(s), values) for s in (left, right)]
            size = [np.array([r[5] for r in s], float) for s in (left, right)]
            label = [np.array([r[7] for r in s], np.int64) for s in (left, right)]
            trees = Trees(len(ids))
            shift = 0 if same else len(left)
            for k in range(len(left)):
                near = (size[1] >= threshold * size[0][k]) & (size[0][k] >= threshold * size[1]) & (label[1] != label[0][k])
                if same:
                    near[: k + 1] = False
                near = np.flatnonzero(near)
                near = near[(sig[1][near] == sig[0][k]).sum(1) >= agree]
                trees.join(k, near + shift)
            if out := trees.stars(ids):
                yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in out], pa.int64()) for s in (0, 1)], names=["a", "b"])

    return mapped(dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high"), run, "a long, b long").distinct()


def true_links(docs: DataFrame, clusters: DataFrame, width: int, threshold: float) -> DataFrame:
    """Edges (a, b): in each cluster, stars over the trees of the pairs whose full sets are similar enough.

    clusters: (node, cluster, major, majors, minors). A block takes about 2 * sqrt(members) documents, 64 at least."""
    texts = docs.select(docs["doc_id"].cast("long").alias("node"), docs["text"]).join(clusters, "node")
    dealt = block_pairs(texts, "greatest(64, least(4096, 2 * sqrt(majors + minors)))")
    return confirmed(dealt.select(F.col("cluster").alias("label"), "low", "high", "side", "node", "text"), width, threshold)


def confirmed(dealt: DataFrame, width: int, threshold: float) -> DataFrame:
    """Edges (a, b): stars over the trees of the similar pairs between the sides 0 and 1 of a group (label, low, high),
    or within side 0 where low = high."""
    part = round(threshold * 100)

    def sets(texts_: list[str]) -> list[np.ndarray]:
        out = []
        for _, _, data, offsets in chunks(pa.array(texts_, pa.string())):
            values, at = shingle_sets(data, offsets, width)
            out += [values[s:e] for s, e in zip(at, at[1:])]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_ in grouped_rows(batches, 3):
            same = rows_[0][1] == rows_[0][2]
            left = [r for r in rows_ if r[3] == 0]
            right = left if same else [r for r in rows_ if r[3] == 1]
            ids = [r[4] for r in left] + ([] if same else [r[4] for r in right])
            if len(ids) < 2 or not left or not right:
                continue
            held = sets([r[5] for r in left])
            size = np.array([len(s) for s in held])
            owner = np.repeat(np.arange(len(held)), size)
            flat = np.concatenate(held)
            order = np.argsort(flat, kind="stable")
            universe, head = np.unique(flat[order], return_index=True)
            owner, head = owner[order], np.append(head, len(flat))
            trees = Trees(len(ids))
            shift = 0 if same else len(left)
            for m, s in enumerate(held if same else sets([r[5] for r in right])):
                k = np.minimum(np.searchsorted(universe, s), max(len(universe) - 1, 0))
                k = k[universe[k] == s] if len(universe) else k[:0]
                n = head[k + 1] - head[k]
                both = np.bincount(owner[np.repeat(head[k] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(held))
                ok = 100 * both >= part * (size + len(s) - both)
                ok &= both > 0
                trees.join(m + shift, np.flatnonzero(ok))
            if out := trees.stars(ids):
                yield pa.RecordBatch.from_arrays([pa.array([x[s] for x in out], pa.int64()) for s in (0, 1)], names=["a", "b"])

    return mapped(dealt.repartition("label", "low", "high").sortWithinPartitions("label", "low", "high", "side"), run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    sigs = written(signatures(docs, width), "signatures")
    folded = written(sigs.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node")), "sets")
    members = written(sigs.where("set_key is not null").select("doc_id", "set_key").join(folded, "set_key").select("doc_id", "node").distinct(), "members")
    nodes = sigs.join(members.where("doc_id = node").select("doc_id", "node"), "doc_id")
    met = meetings(nodes)
    near_hub = written(hub_links(docs, met, width, threshold), "hub_links")
    linked = components(near_hub)
    labelled = written(met.join(linked, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    likely = components(likely_edges(nodes, labelled, threshold)).withColumnRenamed("label", "cluster")
    found = written(likely.join(labelled.select("node", "label"), "node"), "found")
    sizes = written(mixed(found, "cluster"), "sizes")
    clusters = written(found.join(sizes, "cluster").select("node", "cluster", (F.col("label") == F.col("major_label")).alias("major"), "majors", "minors"), "clusters")
    links = true_links(docs, clusters, width, threshold).union(near_hub)
    repeated = members.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("c")).where("b <> c")
    links = links.union(repeated.select(F.col("doc_id").alias("a"), F.explode(F.array("b", "c")).alias("b")))
    labels = components(links)
    named = members.join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("component"))
    out = sigs.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))
