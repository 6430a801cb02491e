"""Streams of vendor rows into partitioned tables: each micro-batch is one upsert, safe to repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyweave.operators.upsert import without_keys
from tallyweave.sources.files import load_or_empty
from tallyweave.staging import written


def upsert_partitions(batch: DataFrame, path: str, keys: list[str], by: str, order: list[str] | None = None) -> None:
    """Rewrites the partitions of `by` that the batch touches: their rows whose keys are new stay, the batch replaces the rest.

    Of a batch's rows with equal keys the last one by `order`, then by all columns, is taken, so a repeated batch
    writes the same rows. Nulls in keys and in `by` are values like any other."""
    spark = batch.sparkSession
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in [*(order or []), *(c for c in batch.columns if c not in (order or []))]])
    latest = written(batch.withColumn("_nth", F.row_number().over(newest)).where("_nth = 1").drop("_nth"), "latest")
    touched = [r[0] for r in latest.select(by).distinct().collect()]  # partitions of one micro-batch
    held = F.col(by).isin([x for x in touched if x is not None])
    existing = load_or_empty(spark, path, batch.schema).where(held | F.col(by).isNull() if None in touched else held)
    kept = written(without_keys(existing, latest, keys).unionByName(latest), "kept")
    kept.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def stream_upserts(rows: DataFrame, path: str, keys: list[str], by: str, checkpoint: str, order: list[str] | None = None) -> StreamingQuery:
    """A query that ends when all available input is in the table."""
    return rows.writeStream.foreachBatch(lambda batch, _: upsert_partitions(batch, path, keys, by, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
