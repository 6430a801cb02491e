"""Historical and parametric value at risk, for all portfolios in one plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.staging import written


@dataclass(frozen=True)
class Var:
    lookback_days: int = 250
    horizon_days: int = 1
    confidence: float = 0.95

    @property
    def z(self) -> float:
        return NormalDist().inv_cdf(1 - self.confidence)

    def label(self, kind: str) -> str:
        return f"{self.horizon_days}-Day {int(self.confidence * 100)}% {kind} VaR"


def recent_dates(returns: DataFrame, lookback: int) -> list[dt.date]:
    """The last `lookback` dates over all portfolios, latest first; a ValueError if there are fewer."""
    dates = [r[0] for r in returns.select("as_of_date").distinct().orderBy(F.desc("as_of_date")).limit(lookback).collect()]
    if len(dates) < lookback:
        raise ValueError(f"{lookback} dates are needed, {len(dates)} are there")
    return dates


def latest_weights(weights: DataFrame) -> DataFrame:
    """Weights of the last date of all. They are written first, so that finding the date and reading it are two scans
    of one table; the date reaches the second as a filter."""
    weights = written(weights, "weights")
    last = weights.agg(F.max("as_of_date")).first()[0]
    return weights.where(F.col("as_of_date") == F.lit(last).cast("date")).select("portfolio_short_name", "security_id", "weight")


def historical_var(returns: DataFrame, weights: DataFrame, var: Var, column: str = "log_return", dates: list[dt.date] | None = None) -> DataFrame:
    """(portfolio_short_name, value): the (1 - confidence) quantile of daily sums of weight times return.

    A date on which a portfolio has no return counts as 0, as do null returns. Not scaled to the horizon. The last
    dates are a range, so the lookback is a filter that reaches the scan."""
    dates = dates or recent_dates(returns, var.lookback_days)
    used = returns.where(F.col("as_of_date") >= F.lit(dates[-1]))
    daily = used.join(weights, ["portfolio_short_name", "security_id"]).groupBy("portfolio_short_name", "as_of_date").agg(F.sum(F.col("weight") * F.col(column)).alias("pnl"))
    grid = weights.select("portfolio_short_name").distinct().select("portfolio_short_name", F.explode(F.array(*map(F.lit, dates))).alias("as_of_date"))
    all_days = grid.join(daily, ["portfolio_short_name", "as_of_date"], "left")
    return all_days.groupBy("portfolio_short_name").agg(F.percentile(F.coalesce("pnl", F.lit(0.0)), 1 - var.confidence).alias("value"))


def covariances(returns: DataFrame, column: str = "log_return") -> DataFrame:
    """(portfolio_short_name, i, j, cov): sample covariance over the dates on which both securities have a return.

    A row for each pair, so the matrix itself; `sigmas` does without it."""
    a = returns.select("portfolio_short_name", "as_of_date", F.col("security_id").alias("i"), F.col(column).alias("x"))
    b = returns.select("portfolio_short_name", "as_of_date", F.col("security_id").alias("j"), F.col(column).alias("y"))
    half = a.join(b, ["portfolio_short_name", "as_of_date"]).where("i <= j").groupBy("portfolio_short_name", "i", "j").agg(F.covar_samp("x", "y").alias("cov"))
    return half.unionByName(half.where("i < j").select("portfolio_short_name", F.col("j").alias("i"), F.col("i").alias("j"), "cov"))


def sigmas(weighted: DataFrame) -> DataFrame:
    """(portfolio_short_name, sigma) from (portfolio_short_name, security_id, as_of_date, x), x a weight times a return:
    the root of the sum of all pairwise covariances of x, each over the dates on which both securities have one.

    Securities that have returns on the same dates are one column, their sum, as covariance is linear while the
    dates are the same. Pairs are joined between such columns only: one if no return is missing, a few with
    listings and holidays, however many securities there are."""
    known = weighted.where("x is not null")
    days = known.groupBy("portfolio_short_name", "security_id").agg(F.md5(F.array_join(F.sort_array(F.collect_set(F.col("as_of_date").cast("string"))), ",")).alias("days"))
    columns = written(known.join(days, ["portfolio_short_name", "security_id"]).groupBy("portfolio_short_name", "days", "as_of_date").agg(F.sum("x").alias("x")), "columns")
    other = columns.select("portfolio_short_name", "as_of_date", F.col("days").alias("other"), F.col("x").alias("y"))
    pairs = columns.join(other, ["portfolio_short_name", "as_of_date"]).where("days <= other").groupBy("portfolio_short_name", "days", "other").agg(F.covar_samp("x", "y").alias("cov"))
    return pairs.groupBy("portfolio_short_name").agg(F.sqrt(F.sum(F.col("cov") * F.when(F.col("days") < F.col("other"), 2.0).otherwise(1.0))).alias("sigma"))


def parametric_var(returns: DataFrame, weights: DataFrame, var: Var, column: str = "log_return", dates: list[dt.date] | None = None) -> DataFrame:
    """(portfolio_short_name, value): mean + z * sigma * sqrt(horizon); the mean is not scaled. Only returns after the
    lookback are read."""
    dates = dates or recent_dates(returns, var.lookback_days)
    used = returns.where(F.col("as_of_date") >= F.lit(dates[-1]))
    weighted = used.join(weights, ["portfolio_short_name", "security_id"]).select("portfolio_short_name", "security_id", "as_of_date", (F.col("weight") * F.col(column)).alias("x"))
    means = weighted.groupBy("portfolio_short_name", "security_id").agg(F.avg("x").alias("mean")).groupBy("portfolio_short_name").agg(F.sum("mean").alias("mean"))
    return means.join(sigmas(weighted), "portfolio_short_name").select("portfolio_short_name", (F.col("mean") + F.lit(var.z * var.horizon_days**0.5) * F.col("sigma")).alias("value"))


def var_report(returns: DataFrame, weights: DataFrame, var: Var, column: str = "log_return", check: bool = False) -> DataFrame:
    """Two metric rows for each portfolio. Returns of the lookback and weights are computed once, into written tables.

    check: a ValueError where the weights and the returns of the lookback do not name the same securities."""
    keys = ["portfolio_short_name", "security_id", "as_of_date"]
    returns = written(returns.select(*keys, column), "returns")
    dates = recent_dates(returns, var.lookback_days)
    returns, weights = returns.where(F.col("as_of_date") >= F.lit(dates[-1])), written(weights, "weights")
    if check:
        aligned(returns, weights)
    out = None
    for kind, rows in (("Historical", historical_var(returns, weights, var, column, dates)), ("Parametric", parametric_var(returns, weights, var, column, dates))):
        named = {"AsOfDate": F.lit(dates[0]), "PortfolioShortName": F.col("portfolio_short_name"), "MetricName": F.lit(var.label(kind)), "MetricType": F.lit("Risk"), "MetricLevel": F.lit("Portfolio"), "MetricValue": F.col("value")}
        rows = rows.select(*[c.alias(n) for n, c in named.items()])
        out = rows if out is None else out.unionByName(rows)
    return out


def unaligned(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(portfolio_short_name, security_id, missing_in) of securities that only returns or only weights name."""
    keys = ["portfolio_short_name", "security_id"]
    a, b = returns.select(*keys).distinct(), weights.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("missing_in", F.lit("weights")).unionByName(b.join(a, keys, "left_anti").withColumn("missing_in", F.lit("returns")))


def aligned(returns: DataFrame, weights: DataFrame) -> None:
    """A ValueError if a portfolio's weights and returns do not name the same securities."""
    if not unaligned(returns, weights).isEmpty():
        raise ValueError("weights and returns have different securities")
