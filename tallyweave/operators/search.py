"""Vector search of many queries: exact in blocks, and an inverted-file index for larger tables.

Both are one step: vectors and queries are dealt to groups, a task compares the queries of a group with its vectors
block against block, keeps k of each query, and the k best of all groups remain. The exact search deals every query
to every group, so its work is rows times queries, as its contract says. The index deals a query to the groups of
its nearest cells only. Groups hold at most about GROUP vectors: a cell of more (a vector that a third of all rows
share) is several groups, and no vector or query is left out.

Distances are squared L2; equal ones go by id. Null vectors match nothing, nor do vectors of another length
than most queries (of an index: than most vectors of its sample) have; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.staging import mapped, written

#: Vectors of a group, and queries and vectors that are compared at once.
GROUP, TILE = 32_768, 128
#: Vectors that an index is fitted on at most, chosen by a hash of their id; rounds of the fit.
SAMPLE, ROUNDS, LEAST_RECALL = 50_000, 8, 0.97


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, through one matrix product; exact to about 1e-12 of the norms."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, distances) of the k nearest: those that the matrix product puts near the k-th are computed anew."""
    for low in range(0, len(queries), TILE):
        part = queries[low : low + TILE]
        about = distances(part, vectors)
        least = np.partition(about, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
        slack = 1e-9 * ((part * part).sum(1) + (vectors * vectors).sum(1).max() + 1)
        for r in range(len(part)):
            near = np.flatnonzero(about[r] <= least[r] + slack[r])
            true = ((vectors[near] - part[r]) ** 2).sum(1)
            order = np.lexsort((ids[near], true))[:k]
            yield low + r, ids[near][order], true[order]


def _dealt(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance) from vectors (group, id, v) and queries (group, id, v): k rows a query of all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, held = None, [], []
        packed = None
        for b in batches:
            groups, sides = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(groups) | np.diff(sides)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(groups)]):
                if e == s:
                    continue
                if groups[s] != group:
                    group, ids, held, packed = groups[s], [], [], None
                matrix, names = _matrix(b.column(3).slice(s, e - s)), b.column(2).slice(s, e - s).to_numpy(zero_copy_only=False)
                if sides[s] == 0:
                    ids.append(names)
                    held.append(matrix)
                    continue
                if not held:
                    continue
                packed = packed or (np.concatenate(held), np.concatenate(ids))
                out = list(_best(matrix, packed[0], packed[1], k))
                size = [len(x[1]) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[[x[0] for x in out]], size)), pa.array(np.concatenate([x[1] for x in out])), pa.array(np.concatenate([x[2] for x in out]))], names=["query_id", "id", "distance"])

    both = vectors.select("group", F.lit(0).alias("side"), "id", "v").unionByName(queries.select("group", F.lit(1).alias("side"), "id", "v"))
    found = mapped(both.repartition("group").sortWithinPartitions("group", "side"), run, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def _rows(df: DataFrame, id_column: str, column: str) -> DataFrame:
    return df.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def _groups(size: Column, group: int) -> Column:
    return F.greatest(F.ceil(size / F.lit(group)), F.lit(1)).cast("int")


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 15, id_column: str = "vec_id", column: str = "embedding", group: int = GROUP) -> DataFrame:
    """(query_id, id, distance, nth): the k nearest vectors of each query row, itself included if it is in the table."""
    asked = _rows(queries, id_column, column)
    width = asked.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, id long, distance double, nth int")
    held, asked = (x.where(F.size("v") == width["width"]) for x in (_rows(vectors, id_column, column), asked))
    groups = max(1, -(-held.count() // group))
    dealt = held.withColumn("group", F.pmod(F.xxhash64("id", F.lit("group")), F.lit(groups)).cast("int"))
    return _dealt(dealt, asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), k)


def index_kind(n: int) -> dict[str, int | str]:
    """What the table's size asks for: a flat (exact) search to 1000 vectors, else an inverted file of `nlist` cells."""
    if n <= 1000:
        return {"kind": "flat"}
    nlist = min(int(n**0.5), 1000)
    return {"kind": "ivf", "nlist": nlist, "nprobe": min(nlist // 4, 50)}


@dataclass(frozen=True)
class Index:
    """Cells of an inverted file, and how many of the nearest ones a query visits."""

    centres: np.ndarray
    nprobe: int

    @staticmethod
    def fit(vectors: DataFrame, nlist: int, nprobe: int, id_column: str = "vec_id", column: str = "embedding", k: int = 15) -> Index:
        """Cells by k-means on at most about SAMPLE vectors, chosen by a hash of their id. Of that sample, each 50th is
        searched in the others, and nprobe grows until LEAST_RECALL of the exact answers are found."""
        rows = _rows(vectors, id_column, column)
        share = min(1.0, SAMPLE / max(1, rows.count()))
        chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < int((1 << 30) * share)).collect()
        width = Counter(len(r["v"]) for r in chosen).most_common(1)
        points = np.array([r["v"] for r in sorted(chosen) if len(r["v"]) == width[0][0]], float)
        different = np.unique(points, axis=0)
        centres = different[np.random.default_rng(7).permutation(len(different))[:nlist]]
        cell = lambda x, m: np.concatenate([np.argsort(distances(x[s : s + TILE], centres), axis=1, kind="stable")[:, :m] for s in range(0, len(x), TILE)])
        for _ in range(ROUNDS):
            own = cell(points, 1)[:, 0]
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            n = np.bincount(own, minlength=len(centres))
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        own, asked = cell(points, 1)[:, 0], points[::50]
        near = cell(asked, len(centres))
        true = [ids for _, ids, _ in _best(asked, points, np.arange(len(points)), k)]
        nprobe = max(1, nprobe)
        while nprobe < len(centres) and np.mean([np.isin(own[t], near[q, :nprobe]).mean() for q, t in enumerate(true)]) < LEAST_RECALL:
            nprobe += max(1, nprobe // 4)
        return Index(centres, min(nprobe, len(centres)))

    def cells(self, rows: DataFrame, most: int) -> DataFrame:
        """rows (id, v) with their `most` nearest cells, nearest first. The centres are at most 1000 rows."""
        sent = rows.sparkSession.sparkContext.broadcast(self.centres)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                near = [np.argsort(distances(x, sent.value), axis=1, kind="stable")[:, :most] for x in (_matrix(b.column(1).slice(s, TILE)) for s in range(0, b.num_rows, TILE))]
                flat = np.concatenate(near).astype(np.int32) if near else np.zeros((0, most), np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, most, dtype=np.int32)), pa.array(flat.ravel()))], names=["id", "v", "cells"])

        return mapped(rows.where(F.size("v") == self.centres.shape[1]), run, "id long, v array<double>, cells array<int>")

    def neighbours(self, vectors: DataFrame, queries: DataFrame, k: int = 15, id_column: str = "vec_id", column: str = "embedding", group: int = GROUP) -> DataFrame:
        """Like `exact_neighbours`, over all vectors, each in its cell, but only over the cells nearest to a query."""
        placed = written(self.cells(_rows(vectors, id_column, column), 1).select("id", "v", F.col("cells")[0].alias("cell")), "cells")
        parts = placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", _groups(F.col("n"), group).alias("parts"))  # a row for each cell
        named = lambda cell, part: (F.col(cell).cast("long") * F.lit(1 << 32) + part).alias("group")
        held = placed.join(F.broadcast(parts), "cell").select(named("cell", F.pmod(F.xxhash64("id", F.lit("group")), F.col("parts"))), "id", "v")
        asked = self.cells(_rows(queries, id_column, column), self.nprobe).select("id", "v", F.explode("cells").alias("cell"))
        asked = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(named("cell", F.col("part")), "id", "v")
        return _dealt(held, asked, k)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 15, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, id, distance, nth) by the search that the table's size asks for."""
    kind = index_kind(vectors.where(F.col(column).isNotNull()).count())
    if kind["kind"] == "flat":
        return exact_neighbours(vectors, queries, k, id_column, column)
    return Index.fit(vectors, kind["nlist"], kind["nprobe"], id_column, column, k).neighbours(vectors, queries, k, id_column, column)
