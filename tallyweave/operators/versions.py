"""Versions of values over time: a load's validity intervals are merged into those that are there.

At each time the version that holds is the one of the latest start among those that cover it; of equal starts the
one of the newest load, then the last by the load's own order. So a late version holds until the next later start, an
open one until the next, a closed one gives way to the open one around it again when it ends, and the result does not
depend on the order in which loads with different starts came in. Versions of a key never overlap in the result.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.operators.fold import folded

ALWAYS = dt.date.max


def merged_versions(existing: DataFrame, load: DataFrame, keys: list[str], start: str = "effective_date", end: str = "end_date", order: list[str] | None = None) -> DataFrame:
    """The table after a load: columns of existing, in any number of dates, vendors or other keys.

    Intervals hold from start to before end; a null end is open; an interval without a start, or that ends by its start,
    holds never and is left out. order: columns of the load by which the last of equal starts wins; ties go by all
    columns. A key's versions come sorted by start and are swept once: what is kept in memory is the versions that are
    not over yet, so a key of very many versions, one after the other, takes no memory."""
    rows = existing.withColumn("_load", F.lit(0)).unionByName(load.select(*[F.col(c) for c in existing.columns], F.lit(1).alias("_load")))
    rank = [*(order or []), *(c for c in existing.columns if c not in (order or []))]
    rows = rows.where(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    names = [c for c in existing.columns if c not in keys]
    schema = StructType([existing.schema[c] for c in existing.columns])

    columns = existing.columns

    def begin(key: tuple) -> dict:
        """live: (end, values) of versions that are not over, the one that holds last; each ends before the one below it."""
        return {"key": dict(zip(keys, key)), "live": [], "since": ALWAYS}

    def piece(state: dict, until: dt.date) -> Iterator[tuple]:
        """The part of the version that holds that ends at `until`."""
        if state["since"] < until:
            values = state["key"] | state["live"][-1][1] | {start: state["since"], end: None if until == ALWAYS else until}
            yield tuple(values[c] for c in columns)
            state["since"] = until

    def advance(state: dict, until: dt.date) -> Iterator[tuple]:
        """All parts before `until`."""
        live = state["live"]
        while live and live[-1][0] <= until:
            yield from piece(state, live[-1][0])
            live.pop()
        if live:
            yield from piece(state, until)

    def step(state: dict, row: dict) -> Iterator[tuple]:
        low, high, live = row[start], row[end] or ALWAYS, state["live"]
        yield from advance(state, low)
        while live and live[-1][0] <= high:  # it ends by the new one's end, so it holds no more
            live.pop()
        live.append((high, {c: row[c] for c in names}))
        state["since"] = low

    def finish(state: dict) -> Iterator[tuple]:
        yield from advance(state, ALWAYS)

    return folded(rows, keys, [F.col(start), F.col("_load"), *[F.col(c) for c in rank if c not in keys and c != start]], begin, step, finish, schema)
