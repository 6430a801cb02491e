"""Hand-computed frames for the rules that a plain version would get wrong."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import returns, risk, temporal, weights
from tallyweave.operators.portfolio import portfolio_market_data

D = [dt.date(2024, 1, k) for k in range(1, 9)]
COLUMNS = "as_of_date date, port_id long, portfolio_short_name string, portfolio_type string, security_id long, close double, held_shares double, shares_outstanding double"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def quotes(spark, prices, kind="Portfolio", held=1.0):
    return frame(spark, [(D[k], 1, "P", kind, s, p, held, 10.0) for s, line in prices.items() for k, p in enumerate(line) if p != "-"])


def found(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_market_weight_uses_the_zero_filled_price_of_the_day_before(spark):
    w = found(weights.portfolio_weights(quotes(spark, {1: [10.0, "-", 11.0], 2: [5.0, 6.0, 7.0]}), method="market_weighted"), "as_of_date", "security_id", "weight")
    assert w == {(D[0], 1): 0, (D[0], 2): 0, (D[1], 1): 0, (D[1], 2): 1, (D[2], 1): 0, (D[2], 2): 1}


def test_sparse_weights_are_the_dense_ones_that_are_not_zero(spark):
    df = quotes(spark, {1: [10.0, "-", 11.0, 12.0], 2: [5.0, 6.0, 7.0, 7.5]})
    for method in weights.METHODS:
        dense = found(weights.portfolio_weights(df, method=method), "as_of_date", "security_id", "weight")
        sparse = found(weights.portfolio_weights(df, method=method, dense=False), "as_of_date", "security_id", "weight")
        assert {k: v for k, v in dense.items() if v} == {k: v for k, v in sparse.items() if v}


def test_first_date_has_a_portfolio_return_of_zero(spark):
    df = quotes(spark, {1: [10.0, 12.0]})
    out = found(returns.portfolio_returns(weights.portfolio_weights(df), returns.constituent_returns(df)), "as_of_date", "portfolio_return")
    assert out[(D[0],)] == 0.0 and out[(D[1],)] == pytest.approx(0.2)


def test_null_price_loses_its_own_and_the_next_return(spark):
    out = returns.constituent_returns(quotes(spark, {1: [10.0, None, 12.0, 13.0]})).collect()
    assert [(r["as_of_date"], r["simple_return"]) for r in out] == [(D[3], pytest.approx(13 / 12 - 1))]


def test_price_that_is_not_positive_gives_no_return(spark):
    out = returns.constituent_returns(quotes(spark, {1: [10.0, 0.0, 12.0, 13.0]})).collect()
    assert [r["as_of_date"] for r in out] == [D[3]]


def test_log_returns_add_up(spark):
    out = returns.constituent_returns(quotes(spark, {1: [10.0, 11.0, 9.0, 14.0]})).agg(F.sum("log_return")).first()[0]
    assert out == pytest.approx(math.log(1.4))


def test_equal_weights_without_shares_are_zero(spark):
    w = found(weights.portfolio_weights(quotes(spark, {1: [10.0], 2: [5.0]}, held=0.0)), "security_id", "weight")
    assert w == {(1,): 0.0, (2,): 0.0}


def test_benchmark_shares(spark):
    df = quotes(spark, {1: [10.0], 2: [30.0]}, "Benchmark")
    assert found(weights.held_shares(df), "security_id", "held_shares") == {(1,): 0.25, (2,): 0.75}
    none = df.withColumn("market_cap", F.lit(0.0))
    assert found(weights.held_shares(none), "security_id", "held_shares") == {(1,): 0.0, (2,): 0.0}


def test_benchmark_market_weight_applies_the_price_twice(spark):
    df = quotes(spark, {1: [10.0, 10.0], 2: [30.0, 30.0]}, "Benchmark")
    w = found(weights.portfolio_weights(df, method="market_weighted"), "as_of_date", "security_id", "weight")
    assert w[(D[1], 1)] == pytest.approx(0.25 * 10 / (0.25 * 10 + 0.75 * 30))


def test_weights_sum_to_one_or_zero(spark):
    df = quotes(spark, {1: [10.0, 11.0, 12.0], 2: [5.0, "-", 7.0], 3: [1.0, 2.0, "-"]})
    for method in weights.METHODS:
        for r in weights.portfolio_weights(df, method=method).groupBy("as_of_date").agg(F.sum("weight").alias("w")).collect():
            assert r["w"] == pytest.approx(1) or r["w"] == 0


def test_override_takes_the_first_of_a_list_and_unknown_methods_raise(spark):
    df = quotes(spark, {1: [10.0], 2: [30.0]})
    w = found(weights.portfolio_weights(df, overrides={"P": ["price_weighted", "equal_weighted"]}), "security_id", "weight")
    assert w == {(1,): 0.25, (2,): 0.75}
    with pytest.raises(ValueError):
        weights.portfolio_weights(df, method="cap")
    with pytest.raises(ValueError):
        returns.constituent_returns(df.drop("port_id"))


def test_pairwise_covariance(spark):
    lines = {1: [1.0, 2.0, 4.0, None], 2: [2.0, 1.0, None, 5.0]}
    df = spark.createDataFrame([("P", D[k], s, x) for s, line in lines.items() for k, x in enumerate(line)], "portfolio_short_name string, as_of_date date, security_id long, log_return double")
    c = found(risk.covariances(df), "i", "j", "cov")
    assert c[(1, 1)] == pytest.approx(7 / 3) and c[(1, 2)] == c[(2, 1)] == pytest.approx(-0.5) and c[(2, 2)] == pytest.approx(13 / 3)


def test_sigmas_equal_the_whole_matrix(spark):
    import random

    rng = random.Random(2)
    rows = [(p, D[k], s, rng.gauss(0, 1), rng.random()) for p in ("A", "B", "C") for s in range(9) for k in range(8) if p == "A" or rng.random() < 0.7]
    df = spark.createDataFrame(rows, "portfolio_short_name string, as_of_date date, security_id long, log_return double, ignored double")
    weight = {(p, s): rng.random() for p in ("A", "B", "C") for s in range(8)}
    weights_ = spark.createDataFrame([(*k, w) for k, w in weight.items()], "portfolio_short_name string, security_id long, weight double")
    want = {}
    for r in risk.covariances(df).collect():
        pair = [weight.get((r["portfolio_short_name"], r[c])) for c in "ij"]
        if None not in pair and r["cov"] is not None:
            want[r["portfolio_short_name"]] = want.get(r["portfolio_short_name"], 0) + pair[0] * pair[1] * r["cov"]
    x = df.join(weights_, ["portfolio_short_name", "security_id"]).withColumn("x", F.col("weight") * F.col("log_return"))
    assert {r["portfolio_short_name"]: r["sigma"] ** 2 for r in risk.sigmas(x).collect()} == pytest.approx(want)


def test_var(spark):
    df = spark.createDataFrame([("P", D[k], 1, float(x)) for k, x in enumerate([1, 2, 3, 4])], "portfolio_short_name string, as_of_date date, security_id long, log_return double")
    one = spark.createDataFrame([("P", 1, 1.0)], "portfolio_short_name string, security_id long, weight double")
    assert risk.historical_var(df, one, risk.Var(4)).first()["value"] == pytest.approx(1.15)
    v = risk.Var(4, 4, 0.95)
    assert risk.parametric_var(df, one, v).first()["value"] == pytest.approx(2.5 + v.z * math.sqrt(5 / 3) * 2)
    assert risk.Var(confidence=0.57).label("Historical") == "1-Day 56% Historical VaR"
    with pytest.raises(ValueError):
        risk.recent_dates(df, 5)
    low, high = (risk.historical_var(df, one, risk.Var(4, 1, c)).first()["value"] for c in (0.9, 0.99))
    assert high <= low


def test_aligned(spark):
    df = spark.createDataFrame([("P", 1)], "portfolio_short_name string, security_id long")
    risk.aligned(df, df)
    with pytest.raises(ValueError):
        risk.aligned(df, df.withColumn("security_id", F.lit(2)))


def test_asof_ties_nulls_and_no_look_ahead(spark):
    left = spark.createDataFrame([(1, D[3]), (1, D[0]), (2, D[3]), (None, D[3]), (1, None)], "k long, t date")
    right = spark.createDataFrame([(1, D[1], 1, 10.0), (1, D[1], 2, 20.0), (1, D[4], 1, 30.0), (None, D[0], 1, 5.0)], "k long, u date, seq int, v double")
    out = temporal.asof_join(left, right, ["k"], "t", "u", {"v": "v"}, ["seq"])
    assert found(out, "k", "t", "v") == {(1, D[3]): 20.0, (1, D[0]): None, (2, D[3]): None, (None, D[3]): None, (1, None): None}


def test_asof_by_period_equals_the_plain_form(spark):
    import random

    rng = random.Random(6)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(20_000)) if rng.random() < 0.95 else None
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    left = spark.createDataFrame([(key(), at(), k) for k in range(800)], "k long, t timestamp, row int")
    right = spark.createDataFrame([(key(), at(), k, float(k)) for k in range(150)], "k long, u timestamp, seq int, v double")
    plain, split = (temporal.asof_join(left, right, ["k"], "t", "u", {"v": "v", "u": "since"}, ["seq"], period) for period in (None, "day"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(plain) == rows(split) and plain.where("v is not null").count() > 300


def test_spine(spark):
    start, end = dt.date(2025, 1, 2), dt.date(2025, 1, 6)
    assert [r[0].day for r in temporal.date_spine(spark, start, end, True).orderBy("dt").collect()] == [2, 3, 4, 5, 6, 7]
    assert [r[0].day for r in temporal.business_days(spark, start, end).orderBy("dt").collect()] == [2, 3, 6]
    assert temporal.date_spine(spark, end, start).isEmpty()


def test_expand_intervals_clips_and_skips_reversed_ones(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 4), None), (2, dt.date(2023, 1, 1), dt.date(2024, 1, 2)), (3, dt.date(2024, 3, 1), None)], "k long, start_date date, end_date date")
    out = sorted((r["k"], r["dt"].day) for r in temporal.expand_intervals(df, dt.date(2024, 1, 1), dt.date(2024, 1, 8)).collect())
    assert out == [(1, 4), (1, 5), (1, 8), (2, 1), (2, 2)]


def test_portfolio_market_data_names_vendors(spark):
    portfolio = spark.createDataFrame([(1, "P", "Port", "Portfolio")], "port_id long, portfolio_short_name string, portfolio_name string, portfolio_type string")
    holdings = spark.createDataFrame([(D[2], 1, 7, 2.0), (D[3], 1, 8, 2.0)], "as_of_date date, port_id long, security_id long, held_shares double")
    securities = spark.createDataFrame([(7, "S", "A"), (8, "T", "A")], "security_id long, symbol string, source_vendor string")
    prices = spark.createDataFrame([(D[2], 7, 9.0)], "as_of_date date, security_id long, close double")
    facts = spark.createDataFrame([(7, "m", 5.0, "F", D[0], D[1]), (7, "other", 6.0, "F", D[1], None)], "security_id long, metric_type string, metric_value double, source_vendor string, effective_date date, end_date date")
    r = portfolio_market_data(portfolio, holdings, securities, prices, facts, "m").collect()
    assert len(r) == 1 and (r[0]["security_source_vendor"], r[0]["fundamental_source_vendor"], r[0]["metric_value"]) == ("A", "F", 5.0)
    assert portfolio_market_data(portfolio, holdings, securities, prices).count() == 1
