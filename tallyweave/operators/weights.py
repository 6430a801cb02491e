"""Portfolio weights: equal, market and price, with benchmark reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators.returns import KEYS
from tallyweave.schemas import require
from tallyweave.staging import written

METHODS = ("equal_weighted", "market_weighted", "price_weighted")


def held_shares(df: DataFrame, price: str = "close") -> DataFrame:
    """df with held_shares replaced, in dates and portfolios of benchmark rows only, by the share of market value.

    Market value is market_cap where that column exists, else shares_outstanding times price; a null value stays
    null, and all shares are 0.0 where the values sum to 0. Other rows keep their held_shares."""
    if "market_cap" not in df.columns:
        require(df, "shares_outstanding")
    value = F.col("market_cap") if "market_cap" in df.columns else F.col("shares_outstanding") * F.col(price)
    group = Window.partitionBy("as_of_date", "portfolio_short_name")
    benchmark = F.col("portfolio_type") == "Benchmark"
    all_benchmark = F.min(F.coalesce(benchmark, F.lit(False))).over(group)
    mv = F.when(benchmark, value.cast("double"))
    total = F.sum(mv).over(group)
    share = F.when(mv.isNotNull(), F.when(total == 0, 0.0).otherwise(F.try_divide(mv, total)))
    own = F.col("held_shares").cast("double") if "held_shares" in df.columns else F.lit(None).cast("double")
    return df.withColumn("held_shares", F.when(all_benchmark, share).otherwise(own))


def method_of(default: str, overrides: dict[str, str | list[str]] | None) -> Column:
    """The method of each portfolio; a list stands for its first element."""
    chosen = {k: v[0] if isinstance(v, (list, tuple)) else v for k, v in (overrides or {}).items()}
    for method in [default, *chosen.values()]:
        if method not in METHODS:
            raise ValueError(f"unknown weighting {method!r}; known: {', '.join(METHODS)}")
    out = F.lit(default)
    for name, method in chosen.items():
        out = F.when(F.col("portfolio_short_name") == name, F.lit(method)).otherwise(out)
    return out


def portfolio_weights(df: DataFrame, price: str = "close", method: str = "equal_weighted", overrides: dict | None = None, dense: bool = True) -> DataFrame:
    """(keys, weight). With dense, every security of a portfolio has a row on every date, 0.0 where it has no quote.

    The market weight takes the price of the row before in the list of all dates, 0 if the security has no quote on
    that date. That is a lag with a check of the date's ordinal, so the dense grid of prices is never built; only
    the output is made dense, if asked for, by each quote filling the dates up to the next one. The cells are
    written once, so that the list of dates and the weights are read from there."""
    require(df, "as_of_date", "portfolio_short_name", "security_id", "portfolio_type", price)
    shared = held_shares(df, price).where(" and ".join(f"{k} is not null" for k in KEYS))
    cells = written(shared.groupBy(*KEYS).agg(F.avg(F.col(price).cast("double")).alias("px"), F.avg("held_shares").alias("held")), "cells")
    # One row for each calendar day, so its window may be one task; Catalyst broadcasts it by its size.
    dates = written(cells.select("as_of_date").distinct().withColumn("nth", F.row_number().over(Window.orderBy("as_of_date"))), "dates")
    day = Window.partitionBy("as_of_date", "portfolio_short_name")
    line = Window.partitionBy("portfolio_short_name", "security_id").orderBy("nth")
    rows = cells.join(dates, "as_of_date")
    rows = rows.withColumns({"held": F.coalesce("held", F.lit(0.0)), "px": F.coalesce("px", F.lit(0.0))})
    rows = rows.withColumn("px_before", F.when(F.lag("nth").over(line) == F.col("nth") - 1, F.lag("px").over(line)).otherwise(0.0))
    value = F.col("held") * F.col("px_before")
    holds = F.col("held") != 0
    weight = {
        "equal_weighted": F.when(holds, F.try_divide(F.lit(1.0), F.sum(holds.cast("int")).over(day))),
        "market_weighted": F.try_divide(value, F.sum(value).over(day)),
        "price_weighted": F.try_divide(F.col("px"), F.sum("px").over(day)),
    }
    chosen = F.lit(None).cast("double")
    for name, column in weight.items():
        chosen = F.when(method_of(method, overrides) == name, column).otherwise(chosen)
    weighted = rows.select("as_of_date", "nth", "portfolio_short_name", "security_id", F.coalesce(chosen, F.lit(0.0)).alias("weight"))
    if not dense:
        return weighted.drop("nth").select(*KEYS, "weight")
    n_dates = dates.agg(F.coalesce(F.max("nth"), F.lit(0))).first()[0]
    low = F.when(F.lag("nth").over(line).isNull(), 1).otherwise(F.col("nth"))
    high = F.coalesce(F.lead("nth").over(line) - 1, F.lit(n_dates))
    filled = weighted.withColumns({"low": low, "high": high}).select("portfolio_short_name", "security_id", F.col("nth").alias("own"), "weight", F.explode(F.sequence("low", "high")).alias("nth"))
    return filled.join(dates, "nth").select(*KEYS, F.when(F.col("nth") == F.col("own"), F.col("weight")).otherwise(0.0).alias("weight"))
