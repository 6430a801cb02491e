"""Folds over ordered rows of a key, of which no task holds more than one batch.

Rows are dealt by key and sorted within their partition, so a key's rows come one after another in as many Arrow batches
as they need. A step function sees one row at a time with the key's state, which is carried from batch to batch, and
yields rows as soon as they are known. So a key of any number of rows takes the memory of its state, not of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyweave.staging import mapped

#: Rows of a result in one batch.
OUT = 8192


def folded(df: DataFrame, keys: list[str], order: list[Column], start: Callable[[tuple], Any], step: Callable[[Any, dict], Iterator[tuple]], finish: Callable[[Any], Iterator[tuple]], schema: StructType) -> DataFrame:
    """The rows that step and finish yield for each key's rows in order.

    start(key) makes a key's state; step(state, row) changes it; finish(state) comes after the key's last row. A null in a
    key is a value like any other. Rows equal in the order come in any order, so it should name all that matters."""
    columns = df.columns
    names = [c for c in columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, out = to_arrow_schema(schema), []
        key, state = None, None

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], f.type) for c, f in enumerate(wanted)], schema=wanted)
            out.clear()
            return made

        for b in batches:
            held = {c: b.column(k).to_pylist() for k, c in enumerate(columns)}
            own = list(zip(*(held[c] for c in keys)))
            for r in range(b.num_rows):
                if key is None or own[r] != key:
                    if key is not None:
                        out.extend(finish(state))
                    key, state = own[r], start(own[r])
                out.extend(step(state, {c: held[c][r] for c in names}))
                if len(out) >= OUT:
                    yield batch()
        if key is not None:
            out.extend(finish(state))
        yield batch()

    return mapped(df.repartition(*keys).sortWithinPartitions(*[F.col(k) for k in keys], *order), run, schema)
