"""What changed in a source tree since its last manifest, so that only those files are read and cut again.

A manifest is a table (path, size, modified, hash). A new one comes from the tree's listing, which opens no file: files of
which path, size and time are as they were keep their hash, and the others alone are read. Two manifests are compared by
one full outer join of paths; a content that left one path and came to another is a rename.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.sources.files import CODE_TYPES, SKIPPED

MANIFEST = "path string, size long, modified timestamp, hash string"
#: So many files are read by name; of more, the tree is read as one.
BY_NAME = 10_000


def _tree(spark: SparkSession, root: str, types: tuple[str, ...], skipped: tuple[str, ...]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(types) + "}").load(root)
    return files.where(~F.col("path").rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in skipped) + ")/"))


def listing(spark: SparkSession, root: str, types: tuple[str, ...] = CODE_TYPES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, size, modified) of the files below root; none is opened."""
    return _tree(spark, root, types, skipped).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def contents(spark: SparkSession, root: str, wanted: DataFrame, types: tuple[str, ...] = CODE_TYPES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, size, modified, content) of the files whose paths are in `wanted`; up to BY_NAME of them no other is opened."""
    paths = [r["path"] for r in wanted.select("path").distinct().limit(BY_NAME + 1).collect()]
    named = lambda files: files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    if not paths:
        return spark.createDataFrame([], "path string, size long, modified timestamp, content binary")
    if len(paths) > BY_NAME:
        return named(_tree(spark, root, types, skipped)).join(wanted.select("path").distinct(), "path", "left_semi")
    return named(spark.read.format("binaryFile").load(paths))


def manifest(spark: SparkSession, root: str, before: DataFrame | None = None, types: tuple[str, ...] = CODE_TYPES, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """The manifest of a tree as it is now. before: the last one, whose hashes hold for files of the same size and time."""
    before = before if before is not None else spark.createDataFrame([], MANIFEST)
    both = listing(spark, root, types, skipped).join(before, ["path", "size", "modified"], "left")
    read = contents(spark, root, both.where("hash is null"), types, skipped)
    return both.where("hash is not null").select("path", "size", "modified", "hash").unionByName(read.select("path", "size", "modified", F.sha2("content", 256).alias("hash")))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, old_path) between two manifests (path, hash): added, changed, removed, and renamed from old_path.

    Of several removed and added files of one content the first by path are paired, then the next; what is left over was
    removed or added."""
    old, new = before.select("path", F.col("hash").alias("old_hash")), after.select("path", F.col("hash").alias("new_hash"))
    both = old.join(new, "path", "full")
    nth = lambda rows, h: rows.withColumn("nth", F.row_number().over(Window.partitionBy(h).orderBy("path"))).withColumnRenamed(h, "hash")
    gone = nth(both.where("new_hash is null").select(F.col("path"), "old_hash"), "old_hash").withColumnRenamed("path", "old_path")
    come = nth(both.where("old_hash is null").select("path", "new_hash"), "new_hash")
    moves = gone.join(come, ["hash", "nth"], "full")
    kind = F.when(F.col("old_path").isNull(), "added").when(F.col("path").isNull(), "removed").otherwise("renamed")
    moved = moves.select(F.coalesce("path", "old_path").alias("path"), kind.alias("change"), F.when(kind == "renamed", F.col("old_path")).alias("old_path"))
    return both.where("old_hash <> new_hash").select("path", F.lit("changed").alias("change"), F.lit(None).cast("string").alias("old_path")).unionByName(moved)


def due(found: DataFrame) -> DataFrame:
    """(path) of the files that are to be read again: those added and changed. A renamed one has its content under another path."""
    return found.where(F.col("change").isin("added", "changed")).select("path")
