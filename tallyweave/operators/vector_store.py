"""A vector index on disk: an inverted file that is a table with one partition for each cell.

The centres are fitted once and are an artefact beside the table. A load assigns its vectors to cells; only the cells
that rows enter or leave are written again, each as a new version of the cell, and one small file says which version of
each cell holds. That file is replaced by one rename, so a reader sees a load as a whole or not at all. A search reads
the partitions that its queries' nearest cells name. Rows carry a hash of the content that they were made from, so a
refresh finds what is new, changed or gone by a comparison of hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.search import GROUP, Index, _dealt, _groups, _rows
from tallyweave.sources.files import load_or_empty, save
from tallyweave.staging import written

CENTRES, CELLS = "cell int, centre array<double>, nprobe int", "cell int, version string"
ROWS = "id long, v array<double>, hash string, cell int, version string"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def build(vectors: DataFrame, path: str, nlist: int, nprobe: int = 1, id_column: str = "vec_id", column: str = "embedding", hash_column: str | None = None) -> VectorStore:
        """An index of all vectors at a new path. A row has the hash of hash_column, or of its vector."""
        store = VectorStore(vectors.sparkSession, path)
        index = Index.fit(vectors, nlist, nprobe, id_column, column)
        save(vectors.sparkSession.createDataFrame([(k, c.tolist(), index.nprobe) for k, c in enumerate(index.centres)], CENTRES), f"{store.path}/centres")
        store.upsert(vectors, id_column, column, hash_column)
        return store

    def index(self) -> Index:
        """Centres and cells to visit: at most 1000 rows."""
        rows = sorted(self.spark.read.schema(CENTRES).parquet(f"{self.path}/centres").collect())
        return Index(np.array([r["centre"] for r in rows], float), rows[0]["nprobe"] if rows else 1)

    def _versions(self) -> dict[int, str]:
        """The version of each cell that holds: a row a cell."""
        return {r["cell"]: r["version"] for r in load_or_empty(self.spark, f"{self.path}/cells", CELLS).collect()}

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """(id, v, hash, cell) of all cells, or of some: the others' folders are not read."""
        held = {c: v for c, v in self._versions().items() if cells is None or c in set(cells)}
        if not held:
            return self.spark.createDataFrame([], ROWS).drop("version")
        return self.spark.read.schema(ROWS).parquet(f"{self.path}/rows").where(F.col("version").isin(sorted({*held.values()})) & F.concat_ws("/", F.col("cell"), "version").isin([f"{c}/{v}" for c, v in held.items()]) & F.col("cell").isin([*held])).drop("version")

    def _write(self, kept: DataFrame, touched: list[int]) -> None:
        """kept: all rows that the touched cells hold from now on."""
        version, versions = uuid.uuid4().hex, self._versions()
        rows = written(kept.select("id", "v", "hash", "cell"), "cell-rows")
        filled = {r["cell"] for r in rows.select("cell").distinct().collect()}  # cells, of which there are at most 1000
        if filled:
            rows.withColumn("version", F.lit(version)).repartition("cell").write.mode("append").partitionBy("cell", "version").parquet(f"{self.path}/rows")
        versions = {c: v for c, v in versions.items() if c not in touched} | dict.fromkeys(filled, version)
        save(self.spark.createDataFrame(sorted(versions.items()), CELLS).coalesce(1), f"{self.path}/cells")

    def vacuum(self) -> int:
        """Deletes versions of cells that hold no more, once no reader uses them; returns how many."""
        jvm, held = self.spark._jvm, {f"cell={c}/version={v}" for c, v in self._versions().items()}
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/cell=*/version=*")) or []
        old = [x.getPath() for x in found if "/".join(x.getPath().toString().split("/")[-2:]) not in held]
        for place in old:
            fs.delete(place, True)
        return len(old)

    def upsert(self, vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", hash_column: str | None = None) -> list[int]:
        """Adds vectors, in place of those of the same ids; returns the cells that were written again."""
        ids = F.col(id_column).cast("long").alias("id")
        hashes = vectors.select(ids, (F.col(hash_column).cast("string") if hash_column else F.sha2(F.col(column).cast("string"), 256)).alias("hash"))
        index = self.index()
        placed = index.cells(_rows(vectors, id_column, column), 1).select("id", "v", F.col("cells")[0].alias("cell"))
        new = written(placed.join(hashes, "id").dropDuplicates(["id"]).select("id", "v", "hash", "cell"), "new-vectors")
        left = self.rows().select("id", "cell").join(new.select("id"), "id", "left_semi").select("cell")
        touched = [r["cell"] for r in new.select("cell").union(left).distinct().collect()]
        self._write(self.rows(touched).join(new.select("id"), "id", "left_anti").unionByName(new), touched)
        return sorted(touched)

    def delete(self, ids: DataFrame, id_column: str = "vec_id") -> list[int]:
        """Removes vectors by id; returns the cells that were written again."""
        gone = ids.select(F.col(id_column).cast("long").alias("id")).distinct()
        touched = [r["cell"] for r in self.rows().select("id", "cell").join(gone, "id", "left_semi").select("cell").distinct().collect()]
        if touched:
            self._write(self.rows(touched).join(gone, "id", "left_anti"), touched)
        return sorted(touched)

    def changes(self, source: DataFrame, id_column: str, hash_column: str) -> DataFrame:
        """(id, change): new, changed and gone ids of a source against the index, by content hashes; no vector is read."""
        now = source.select(F.col(id_column).cast("long").alias("id"), F.col(hash_column).cast("string").alias("now"))
        both = now.join(self.rows().select("id", F.col("hash").alias("then")), "id", "full")
        change = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("now") != F.col("then"), "changed")
        return both.select("id", change.alias("change")).where("change is not null")

    def refresh(self, source: DataFrame, id_column: str = "vec_id", column: str = "embedding", hash_column: str = "hash") -> list[int]:
        """The index of a source again, by what has changed alone; returns the cells that were written again."""
        found = written(self.changes(source, id_column, hash_column), "vector-changes")
        due = source.join(found.where("change <> 'gone'").select(F.col("id").alias(id_column)), id_column, "left_semi")
        cells = self.delete(found.where("change = 'gone'"), "id")
        return sorted({*cells, *(self.upsert(due, id_column, column, hash_column) if not due.isEmpty() else [])})

    def neighbours(self, queries: DataFrame, k: int = 15, id_column: str = "vec_id", column: str = "embedding", group: int = GROUP) -> DataFrame:
        """(query_id, id, distance, nth) over the cells nearest to each query, whose partitions alone are read."""
        index = self.index()
        asked = written(index.cells(_rows(queries, id_column, column), index.nprobe).select("id", "v", F.explode("cells").alias("cell")), "visits")
        cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
        held = self.rows(cells)
        parts = held.groupBy("cell").agg(F.count("*").alias("n")).select("cell", _groups(F.col("n"), group).alias("parts"))  # a row for each cell
        named = lambda part: (F.col("cell").cast("long") * F.lit(1 << 32) + part).alias("group")
        placed = held.join(F.broadcast(parts), "cell").select(named(F.pmod(F.xxhash64("id", F.lit("group")), F.col("parts"))), "id", "v")
        wanted = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(named(F.col("part")), "id", "v")
        return _dealt(placed, wanted, k)
