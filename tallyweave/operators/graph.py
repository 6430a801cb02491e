"""Vector search through navigable small-world graphs, for tables between a flat search and an inverted file.

Vectors are dealt to shards of about SHARD by a hash of their id, and each shard is one graph: a vector is linked to its
LINKS nearest, to vectors that have it among theirs, and to FAR random ones, so that a walk gets anywhere in few
steps. A search walks all graphs: from the nearest of a shard's entry points it expands the nearest vector that is not
expanded yet, keeps the BEAM best ones seen, and ends when all of these are expanded. Queries come in blocks, a row a
block and shard, and the queries of a block walk side by side in one array.

Equal vectors of a shard are one node, which stands for all their ids, so copies cannot crowd the links. How wide a beam
must be depends on the vectors: each shard searches FIT of its own nodes exactly and keeps the narrowest beam that finds
LEAST_RECALL of their nearest; a search is never narrower than that.

The graphs are a table of one row for each shard, so an index is built once and read again. Distances are squared L2, of
the vectors as they are; equal ones go by id. Null vectors and vectors of another length than the index' match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.search import LEAST_RECALL, TILE, _rows, distances
from tallyweave.staging import mapped, written

SHARD, BLOCK = 8192, 512
LINKS, FAR, BEAM = 16, 4, 96
#: Nodes by which a shard fits its beam, and the narrowest beam.
FIT, NARROW = 128, 24


def linked(points: np.ndarray, links: int = LINKS, far: int = FAR) -> np.ndarray:
    """Neighbours of each vector, -1 where there are fewer."""
    n = len(points)
    k = min(links, n - 1)
    near = np.zeros((n, k), np.int32)
    for s in range(0, n if k else 0, TILE):
        away = distances(points[s : s + TILE], points)
        away[np.arange(len(away)), np.arange(s, s + len(away))] = np.inf
        near[s : s + TILE] = np.argpartition(away, k - 1, axis=1)[:, :k]
    random = np.random.default_rng(n).integers(0, max(n, 1), (n, far), dtype=np.int32)
    begin = np.repeat(np.arange(n, dtype=np.int32), k)
    back = np.full((n, links), -1, np.int32)  # of those that have a vector among their nearest, at most `links`
    order = np.argsort(near.ravel(), kind="stable")
    target, source = near.ravel()[order], begin[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    back[target[nth < links], nth[nth < links]] = source[nth < links]
    return np.concatenate([near, back, random], axis=1)


def walked(queries: np.ndarray, points: np.ndarray, links: np.ndarray, k: int, beam: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query: the places and distances of the k best found (-1 where there are fewer), and how many vectors it was
    compared with. without: of each query, a node that is not there for it."""
    n, q = len(points), len(queries)
    beam = min(max(beam, k), n)
    entries = np.unique(np.linspace(0, n - 1, max(1, min(n, int(n**0.5)))).astype(np.int64))
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True  # stands for no neighbour
    away = distances(queries, points[entries])
    seen[:, entries] = True
    if without is not None:
        seen[np.arange(q), without] = True
        away[entries[None, :] == without[:, None]] = np.inf
    first = np.argsort(away, axis=1, kind="stable")[:, :beam]
    best, score = entries[first], np.take_along_axis(away, first, 1)
    if best.shape[1] < beam:
        best = np.concatenate([best, np.full((q, beam - best.shape[1]), n)], axis=1)
        score = np.concatenate([score, np.full((q, beam - score.shape[1]), np.inf)], axis=1)
    best = np.where(np.isfinite(score), best, n)
    open_ = best < n
    compared = np.full(q, len(entries))
    rows = np.arange(q)
    padded = np.concatenate([links, np.full((1, links.shape[1]), -1, links.dtype)])
    norms = (points * points).sum(1)
    while len(active := rows[open_.any(1)]):
        at = open_[active].argmax(1)  # the beam is in order, so the first open one is the nearest
        node = best[active, at]
        open_[active, at] = False
        around = np.sort(np.where(padded[node] < 0, n, padded[node]).astype(np.int64), axis=1)
        around[:, 1:][around[:, 1:] == around[:, :-1]] = n
        new = ~seen[active[:, None], around]
        around = np.where(new, around, n)
        seen[active[:, None], around] = True
        compared[active] += new.sum(1)
        near = points[np.minimum(around, n - 1)]
        dist = norms[np.minimum(around, n - 1)] - 2 * np.einsum("qkd,qd->qk", near, queries[active]) + (queries[active] ** 2).sum(1)[:, None]
        dist = np.where(new, np.maximum(dist, 0), np.inf)
        ids, scores, opens = np.concatenate([best[active], around], 1), np.concatenate([score[active], dist], 1), np.concatenate([open_[active], new], 1)
        order = np.argsort(scores, axis=1, kind="stable")[:, :beam]
        best[active], score[active], open_[active] = (np.take_along_axis(x, order, 1) for x in (ids, scores, opens))
    return np.where(best < n, best, -1), score, compared


def fitted_beam(points: np.ndarray, links: np.ndarray, k: int) -> int:
    """The narrowest beam tried with which a walk finds LEAST_RECALL of the k nearest of FIT nodes; at most all nodes. Each is
    searched as if it was not in the graph, for a query that is in it is the easier one."""
    n, k = len(points), min(k, len(points) - 1)
    if k < 1:
        return n
    own = np.unique(np.linspace(0, n - 1, min(n, FIT)).astype(np.int64))
    asked = points[own]
    about = distances(asked, points)
    about[np.arange(len(own)), own] = np.inf
    least = np.partition(about, k - 1, axis=1)[:, k - 1] + 1e-9 * ((asked * asked).sum(1) + (points * points).sum(1).max() + 1)
    beam = max(NARROW, k)
    while beam < n:
        _, score, _ = walked(asked, points, links, k, beam, own)
        if (score[:, :k] <= least[:, None]).mean() >= LEAST_RECALL:
            break
        beam += beam // 2
    return min(beam, n)


@dataclass(frozen=True)
class Graphs:
    """shards: (shard, ids, starts, vectors, links, beam), arrays as bytes; the ids of node i are those from starts[i] to starts[i + 1]."""

    shards: DataFrame
    width: int

    @staticmethod
    def build(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", shard: int = SHARD, k: int = 15) -> Graphs:
        """k: the number of nearest for which the beams are fitted."""
        rows = written(_rows(vectors, id_column, column), "graph-vectors")
        widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
        width, n = (widths["width"], widths["n"]) if widths else (0, 0)
        count = max(1, -(-n // shard))

        def make(table: pa.Table) -> pa.Table:
            ids = table.column("id").to_numpy()
            points = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            nodes, first, node = np.unique(points, axis=0, return_index=True, return_inverse=True)
            place = np.empty(len(nodes), np.int64)
            by_id = np.argsort(ids[first], kind="stable")  # any order that the vectors do not give, so that entries are spread
            place[by_id] = np.arange(len(nodes))
            nodes, node = nodes[by_id], place[node.ravel()]
            order, starts = np.lexsort((ids, node)), np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(nodes)))])
            links = linked(nodes)
            return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids[order], starts.astype(np.int64), nodes, links)), pa.array([fitted_beam(nodes, links, k)], pa.int32())], names=["shard", "ids", "starts", "vectors", "links", "beam"])

        dealt = rows.where(F.size("v") == width).withColumn("shard", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(count)).cast("int"))
        return Graphs(written(dealt.groupBy("shard").applyInArrow(make, "shard int, ids binary, starts binary, vectors binary, links binary, beam int"), "graphs"), width)

    def neighbours(self, queries: DataFrame, k: int = 15, id_column: str = "vec_id", column: str = "embedding", beam: int = BEAM) -> DataFrame:
        """(query_id, id, distance, nth, compared): the k best found of each query, and with how many different vectors it was
        compared. beam: the least width; a shard's own fit may ask for more."""
        width = self.width
        asked = _rows(queries, id_column, column).where(F.size("v") == width)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, BLOCK):
                    part = b.slice(s, BLOCK)
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (part.column(0).to_numpy().tobytes(), part.column(1).flatten().to_numpy(zero_copy_only=False).tobytes())], names=["asked", "points"])

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    get = lambda c, kind: np.frombuffer(b.column(b.schema.get_field_index(c))[r].as_buffer(), kind)  # noqa: E731, B023
                    ids, starts, names = get("ids", np.int64), get("starts", np.int64), get("asked", np.int64)
                    points, wanted = get("vectors", np.float64).reshape(len(starts) - 1, -1), get("points", np.float64).reshape(len(names), -1)
                    wide = max(beam, b.column(b.schema.get_field_index("beam"))[r].as_py())
                    place, _, compared = walked(wanted, points, get("links", np.int32).reshape(len(points), -1), k, wide)
                    hit = place >= 0
                    owner, node = np.repeat(np.arange(len(names)), hit.sum(1)), place[hit]
                    copies = np.minimum(starts[node + 1] - starts[node], k)  # the first k ids of a node are enough
                    true = np.repeat(((points[node] - wanted[owner]) ** 2).sum(1), copies)
                    named = ids[np.repeat(starts[node] - np.cumsum(copies) + copies, copies) + np.arange(len(true))]
                    owner = np.repeat(owner, copies)
                    order = np.lexsort((named, true, owner))
                    nth = np.arange(len(order)) - np.searchsorted(owner, owner)
                    order, lead = order[nth < k], (nth == 0)[nth < k]
                    yield pa.RecordBatch.from_arrays([pa.array(names[owner[order]]), pa.array(named[order]), pa.array(true[order]), pa.array(compared[owner[order]]), pa.array(lead)], names=["query_id", "id", "distance", "compared", "first"])

        # A row for each block and shard: the blocks of an unbounded query set, beside each graph.
        blocks = written(mapped(asked, packed, "asked binary, points binary"), "query-blocks")
        shards = self.shards.count()
        dealt = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards - 1))))).join(self.shards, "shard")
        found = mapped(dealt.select("ids", "starts", "vectors", "links", "beam", "asked", "points"), walk, "query_id long, id long, distance double, compared long, first boolean")
        each = found.withColumn("shards", F.sum(F.when(F.col("first"), F.col("compared")).otherwise(0)).over(Window.partitionBy("query_id")))
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).select("query_id", "id", "distance", "nth", F.col("shards").alias("compared"))
