"""Checks in flight: measurements that a write gathers of its own rows, and rules that decide whether it counts.

The measurements are an Observation of the plan that writes, so rows are read and made once. The rows go to a place
beside the target; only if all rules hold does the load take its place there, so a failed one leaves the target as it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyweave.staging import fresh_path


class CheckFailed(ValueError):
    """What did not hold, with the measurements: (rule, metrics)."""

    def __init__(self, failed: list[str], metrics: dict):
        super().__init__(f"checks failed: {', '.join(failed)}; measured {metrics}")
        self.failed, self.metrics = failed, metrics


def market_metrics() -> dict[str, Column]:
    """Rows, missing and bad prices, days without volume, and the range of dates of market data."""
    return {
        "rows": F.count(F.lit(1)),
        "null_close": F.count_if(F.col("close").isNull()),
        "not_positive": F.count_if(F.col("close") <= 0),
        "zero_volume": F.count_if(F.col("volume") == 0),
        "first_date": F.min("as_of_date"),
        "last_date": F.max("as_of_date"),
    }


def checked(rows: DataFrame, metrics: dict[str, Column], rules: dict[str, Callable[[dict], bool]], load: Callable[[DataFrame], None]) -> dict:
    """Writes rows and measures them in one pass, then gives what was written to `load` if every rule holds of the
    metrics; returns these. Else CheckFailed, and nothing is loaded. The metrics of no rows are those of Spark's aggregates."""
    seen, path = Observation(), fresh_path(rows.sparkSession, "checked")
    rows.observe(seen, *[c.alias(n) for n, c in metrics.items()]).write.parquet(path)
    found = seen.get
    if failed := [name for name, holds in rules.items() if not holds(found)]:
        raise CheckFailed(failed, found)
    load(rows.sparkSession.read.schema(rows.schema).parquet(path))
    return found
