"""Tables written between steps into the folder that driver and executors share, and Arrow steps of bounded memory."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@lru_cache(1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='tallyweave-')}"


def shared_folder(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names. Where it is unset, a temporary folder serves a session of one
    machine (master local[…]); on a cluster that is a ValueError, as each executor would write to its own disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tallyweave/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written once as Parquet and read again: cuts the lineage, and survives lost executors."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows in one Arrow batch; a larger row is a batch of its own.
BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Freed memory of this worker goes back to the machine, as idle workers of earlier steps stay alive for a while."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the GNU C library has it
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """From now on batches hold at most BATCH_BYTES: a setting of the session, which has none by rows and bytes for one step."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                give_back()

        yield from function(each())
        give_back()

    return df.mapInArrow(run, schema)
