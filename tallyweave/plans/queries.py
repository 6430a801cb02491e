"""The catalogue: each query applies library operators to the derived views, and has SQL of the same result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.scalar import date_range, half_even, last_weekday, snake_case_column
from tallyweave.operators import chunking, membership, quality, retrieval, returns, risk, search, temporal, upsert, weights
from tallyweave.operators.portfolio import portfolio_market_data
from tallyweave.plans import views
from tallyweave.plans.registry import query, rounded
from tallyweave.plans.views import ctes, table
from tallyweave.sources import vendor
from tallyweave.staging import written

NOW, DAY = dt.datetime(2024, 2, 1, 12), dt.date(2024, 2, 1)
VAR = risk.Var(lookback_days=24, horizon_days=1, confidence=0.95)
Z = VAR.z
FIRST, LAST = dt.date(2024, 1, 1), dt.date(2024, 1, 30)


RETURNS = "select as_of_date, portfolio_short_name, security_id, round(simple_return, 6) as simple_return, round(log_return, 6) as log_return from returns"


@query(ctes("portfolio", "market", "returns") + RETURNS)
def constituent_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(returns.constituent_returns(views.market(spark, sf)), "simple_return", "log_return")


@query(ctes("portfolio", "market_sparse", "returns") + RETURNS)
def constituent_returns_sparse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(returns.constituent_returns(views.market_sparse(spark, sf)), "simple_return", "log_return")


@query(ctes("portfolio", "market", "grid") + "select as_of_date, portfolio_short_name, security_id, round(held, 6) as held_shares from shared")
def held_shares_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights.held_shares(views.market(spark, sf)).select("as_of_date", "portfolio_short_name", "security_id", "held_shares"), "held_shares")


def _weights_sql(column: str, market: str = "market_sparse") -> str:
    return ctes("portfolio", market, "grid") + f"select as_of_date, portfolio_short_name, security_id, round({column}, 6) as weight from methods"


def _weights(spark: SparkSession, sf: str, method: str) -> DataFrame:
    return rounded(weights.portfolio_weights(views.market_sparse(spark, sf), method=method), "weight")


@query(_weights_sql("equal_weighted"))
def weights_equal(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf, "equal_weighted")


@query(_weights_sql("market_weighted"))
def weights_market(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf, "market_weighted")


@query(_weights_sql("price_weighted"))
def weights_price(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf, "price_weighted")


@query(_weights_sql("case portfolio_short_name when 'view' then market_weighted when 'click' then price_weighted else equal_weighted end", "market"))
def weights_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights.portfolio_weights(views.market(spark, sf), method="equal_weighted", overrides={"view": ["market_weighted", "price_weighted"], "click": "price_weighted"}), "weight")


def _portfolio_returns(spark: SparkSession, sf: str, base: float = 0.0) -> DataFrame:
    m = written(views.market(spark, sf).withColumn("close", F.col("close") + base), "market")  # read by weights and by returns
    return returns.portfolio_returns(weights.portfolio_weights(m), returns.constituent_returns(m))


PORTFOLIO_RETURN = """, portfolio_return as (select as_of_date, portfolio_short_name, coalesce(sum(equal_weighted * simple_return), 0) as portfolio_return
  from methods full join returns using (as_of_date, portfolio_short_name, security_id) group by 1, 2)"""


@query(ctes("portfolio", "market", "returns", "grid") + PORTFOLIO_RETURN + "select as_of_date, portfolio_short_name, round(portfolio_return, 6) as portfolio_return from portfolio_return")
def portfolio_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_portfolio_returns(spark, sf), "portfolio_return")


#: Averages of event values jump by their own size from day to day; on this base their returns are those of prices.
BASE = 1000.0


@query(
    ctes("portfolio", "market", "returns", "grid").replace("avg(value) as close", f"avg(value) + {BASE} as close")
    + PORTFOLIO_RETURN
    + """, grown as (select *, exp(sum(portfolio_return) over (partition by portfolio_short_name order by as_of_date)) - 1 as g from portfolio_return)
select as_of_date, portfolio_short_name, round((g - first_value(g) over (partition by portfolio_short_name order by as_of_date)) * 100, 6) as cumulative_pct from grown"""
)
def cumulative_return(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(returns.cumulative_returns(_portfolio_returns(spark, sf, BASE)), "cumulative_pct")


@query(ctes("portfolio", "market", "returns", "grid") + PORTFOLIO_RETURN + "select as_of_date, portfolio_short_name, round(portfolio_return, 6) as portfolio_return, round(portfolio_return * 100, 6) as percent from portfolio_return")
def percent_returns(spark: SparkSession, sf: str) -> DataFrame:
    """The series that a chart of returns takes."""
    return rounded(returns.percent_returns(_portfolio_returns(spark, sf)), "portfolio_return", "percent")


CELLS = [(p, s) for p in ("click", "error", "purchase", "signup", "view") for s in range(10)]


@query(
    ctes("portfolio", "market", "returns")
    + "select as_of_date, "
    + ", ".join(f"""round(avg(simple_return) filter (where portfolio_short_name = '{p}' and security_id = {s}), 6) as "{p}|{s}\"""" for p, s in CELLS)
    + " from returns group by as_of_date"
)
def wide_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Returns as a table with a column for each portfolio and security, in their order."""
    found = returns.wide(returns.constituent_returns(views.market(spark, sf)), "simple_return")
    return rounded(found, *found.columns[1:])


RISK = """, dates as (select distinct as_of_date from returns order by 1 desc limit 24),
recent as (select * from returns where as_of_date in (select as_of_date from dates)),
latest as (select portfolio_short_name, security_id, price_weighted as weight from methods where as_of_date = (select max(as_of_date) from methods)),
daily as (select portfolio_short_name, as_of_date, sum(weight * log_return) as pnl from recent join latest using (portfolio_short_name, security_id) group by 1, 2),
historical as (select p.portfolio_short_name, quantile_cont(coalesce(pnl, 0.0::double), 0.05) as value from (select distinct portfolio_short_name from latest) p cross join dates left join daily using (portfolio_short_name, as_of_date) group by 1),
means as (select portfolio_short_name, security_id, avg(log_return) as mean from recent group by 1, 2),
covs as (select a.portfolio_short_name, a.security_id as i, b.security_id as j, covar_samp(a.log_return, b.log_return) as cov from recent a join recent b on a.portfolio_short_name = b.portfolio_short_name and a.as_of_date = b.as_of_date group by 1, 2, 3),
sigmas as (select c.portfolio_short_name, sqrt(sum(x.weight * y.weight * cov)) as sigma from covs c join latest x on x.portfolio_short_name = c.portfolio_short_name and x.security_id = i join latest y on y.portfolio_short_name = c.portfolio_short_name and y.security_id = j group by 1),
mus as (select portfolio_short_name, sum(weight * mean) as mu from means join latest using (portfolio_short_name, security_id) group by 1),
""" + f"parametric as (select portfolio_short_name, mu + ({Z!r}) * sigma as value from mus join sigmas using (portfolio_short_name))\n"
RISK_CTES = ctes("portfolio", "market", "returns", "grid") + RISK


def _risk_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = written(views.market(spark, sf), "market")  # read by returns and by weights
    return returns.constituent_returns(m), risk.latest_weights(weights.portfolio_weights(m, method="price_weighted"))


@query(RISK_CTES + "select portfolio_short_name, round(value, 6) as value from historical")
def var_historical(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(risk.historical_var(*_risk_inputs(spark, sf), VAR), "value")


@query(RISK_CTES + "select portfolio_short_name, round(value, 6) as value from parametric")
def var_parametric(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(risk.parametric_var(*_risk_inputs(spark, sf), VAR), "value")


@query(
    RISK_CTES
    + """select (select max(as_of_date) from returns) as "AsOfDate", portfolio_short_name as "PortfolioShortName", name as "MetricName", 'Risk' as "MetricType", 'Portfolio' as "MetricLevel", round(value, 6) as "MetricValue"
from (select *, '1-Day 95% Historical VaR' as name from historical union all select *, '1-Day 95% Parametric VaR' from parametric)"""
)
def var_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(risk.var_report(*_risk_inputs(spark, sf), VAR, check=True), "MetricValue")


@query(ctes("portfolio", "market", "returns") + "select portfolio_short_name, security_id, case when w is null then 'weights' else 'returns' end as missing_in from (select distinct portfolio_short_name, security_id, 1 as r from returns) full join (select portfolio_short_name, security_id, 1 as w from market where portfolio_type = 'Portfolio' group by all) using (portfolio_short_name, security_id) where r is null or w is null")
def weights_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Securities that only one side of a value at risk names; here the weights lack the benchmark."""
    m = views.market(spark, sf)
    return risk.unaligned(returns.constituent_returns(m), m.where("portfolio_type = 'Portfolio'"))


@query(
    """select p.event_id, p.user_id, p.ts, p.value, c.value as last_click, c.ts as clicked_at
from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts"""
)
def asof_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), "value", "event_id")
    return temporal.asof_join(bought, clicks, ["user_id"], "ts", "at", {"value": "last_click", "at": "clicked_at"}, ["event_id"])


@query(
    ctes("portfolio", "market", "security_master", "market_data", "holdings", "fundamentals")
    + """select h.as_of_date, h.port_id, h.security_id, h.held_shares, p.portfolio_short_name, p.portfolio_name, p.portfolio_type, s.symbol, s.name, s.sector, s.security_type, s.is_active,
  s.source_vendor as security_source_vendor, round(m.close, 6) as close, m.volume, f.effective_date, f.shares_outstanding, f.free_float, f.source_vendor as fundamental_source_vendor
from holdings h join portfolio p using (port_id) join security_master s using (security_id) join market_data m using (security_id, as_of_date)
asof left join fundamentals f on f.security_id = h.security_id and h.as_of_date >= f.effective_date"""
)
def portfolio_market_data_(spark: SparkSession, sf: str) -> DataFrame:
    joined = portfolio_market_data(views.portfolio(spark, sf), views.holdings(spark, sf), views.security_master(spark, sf), views.market_data(spark, sf), views.fundamentals(spark, sf))
    return rounded(joined, "close")

SPINE = "with recursive days(dt) as (select date '2024-01-01' union all select cast(dt + 1 as date) from days where dt {} date '2024-01-30')"


@query("with recursive days(dt) as (select min(cast(ts as date)) from events union all select cast(dt + 1 as date) from days where dt <= (select max(cast(ts as date)) from events)) select dt from days where dayofweek(dt) between 1 and 5")
def business_days(spark: SparkSession, sf: str) -> DataFrame:
    """From the first event to the last, with the day of overrun that a recursion testing before it adds has."""
    first, last = table(spark, sf, "events").agg(F.min(F.col("ts").cast("date")), F.max(F.col("ts").cast("date"))).first()
    return temporal.business_days(spark, first, last, inclusive_overrun=True)


@query(
    SPINE.format("<")
    + """, picked as (select p_partkey as security_id, 'S' || p_partkey as symbol from part)
select dt as as_of_date, security_id, case symbol when 'S1' then 100.0::double when 'S2' then 250.0::double else 10.0::double end as held_shares, 1 as port_id from days cross join picked where dayofweek(dt) between 1 and 5"""
)
def holdings_generator(spark: SparkSession, sf: str) -> DataFrame:
    days = temporal.business_days(spark, FIRST, LAST).withColumnRenamed("dt", "as_of_date")
    picked = views.security_master(spark, sf).select("security_id", "symbol")
    quantity = F.when(F.col("symbol") == "S1", 100.0).when(F.col("symbol") == "S2", 250.0).otherwise(10.0)
    return temporal.holdings_on(days, picked, quantity).select("as_of_date", "security_id", "held_shares", F.lit(1).alias("port_id"))


INTERVALS = """with ev as (select event_id as seq, cast(user_id as varchar) as ric, ts, event_type from events where event_type in ('signup', 'error')),
intervals as (select ric, cast(ts as date) as start_date, cast(left_at as date) as end_date from (select *, min(case when event_type = 'error' then ts end) over (partition by ric order by ts, seq rows between 1 following and unbounded following) as left_at from ev) where event_type = 'signup'),
days as (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as dt)
"""


@query(INTERVALS + "select ric, start_date, end_date, dt from intervals join days on dt >= start_date and dt <= coalesce(end_date, date '2024-01-30') where dayofweek(dt) between 1 and 5")
def membership_expand(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.expand_intervals(views.intervals(spark, sf), FIRST, LAST)


@query(
    """with recursive ev as (select cast(user_id as varchar) as ric, ts, event_type, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('signup', 'error')),
rics as (select distinct cast(user_id as varchar) as ric, user_id % 2 = 0 as seeded from events),
fold as (
  select ric, 0 as n, case when seeded then [{'ticker': 'S' || ric, 'low': timestamp '2024-01-01', 'high': cast(null as timestamp)}] else [] end as st from rics
  union all
  select ric, n, case when event_type = 'signup' and place > 0 then list_transform(st, lambda x, i: case when i = place then {'ticker': 'S' || ric, 'low': ts, 'high': x.high} else x end)
    when event_type = 'signup' then list_append(st, {'ticker': 'S' || ric, 'low': ts, 'high': cast(null as timestamp)})
    when place > 0 then list_transform(st, lambda x, i: case when i = place then {'ticker': x.ticker, 'low': x.low, 'high': ts} else x end)
    else list_append(st, {'ticker': 'S' || ric, 'low': timestamp '2024-01-01', 'high': ts}) end as st
  from (select f.ric, e.n, e.ts, e.event_type, f.st,
      case when e.event_type = 'signup' then coalesce(list_position(list_transform(st, lambda x: x.low = timestamp '2024-01-01' and x.high is null), true), 0)
      when list_max(list_transform(st, lambda x: case when x.high is null and x.low <= e.ts then x.low end)) is null then 0 else len(st) + 1 - list_position(list_reverse(list_transform(st, lambda x: case when x.high is null and x.low <= e.ts then x.low end)), list_max(list_transform(st, lambda x: case when x.high is null and x.low <= e.ts then x.low end))) end as place
    from fold f join ev e on e.ric = f.ric and e.n = f.n + 1)),
last as (select ric, unnest(st) as x from fold f where n = (select max(n) from fold g where g.ric = f.ric))
select ric, x.ticker as exchange_ticker, x.low as start_date, x.high as end_date from last"""
)
def membership_fold(spark: SparkSession, sf: str) -> DataFrame:
    return membership.membership_intervals(views.membership_seeds(spark, sf), views.membership_events(spark, sf), dt.datetime(2024, 1, 1))


@query(
    ctes("portfolio", "market", "market_data", "fundamentals")
    + """select m.security_id, 'Shares Outstanding' as metric_type, case when free_float is not null then round(1000 * (1 + m.security_id) * least(greatest(free_float, 0), 100) / 100, 6) end as metric_value, 'refinitive' as source_vendor, m.as_of_date as effective_date, cast(null as date) as end_date
from market_data m asof left join fundamentals f on f.security_id = m.security_id and m.as_of_date >= f.effective_date"""
)
def float_adjusted_shares(spark: SparkSession, sf: str) -> DataFrame:
    named = F.concat(F.lit("S"), F.col("security_id").cast("string"))
    days = views.market_data(spark, sf)
    shares = days.select(named.alias("instrument"), F.col("as_of_date").alias("date"), (1000 * (1 + F.col("security_id"))).cast("double").alias("outstanding_shares"))
    free = views.fundamentals(spark, sf).select(named.alias("instrument"), F.col("effective_date").alias("date"), F.lit(1).alias("seq"), F.col("free_float").alias("free_float_pct"))
    members = days.select(named.alias("ric"), named.alias("exchange_ticker"), "security_id").distinct()
    return rounded(membership.float_adjusted_shares(members, shares, free), "metric_value")


HALVES = """, existing as (select as_of_date, security_id, round(close, 6) as close, volume from market_data where as_of_date <= date '2024-01-20'), batch as (select as_of_date, security_id, round(close + 1, 6) as close, volume from market_data where as_of_date >= date '2024-01-15')
"""


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """What is stored, and a load that begins before its end; every row is in one or both."""
    data = written(views.market_data(spark, sf), "market_data")
    batch = data.where("as_of_date >= date'2024-01-15'").withColumn("close", F.col("close") + 1)
    return rounded(data.where("as_of_date <= date'2024-01-20'"), "close"), rounded(batch, "close")


@query(ctes("portfolio", "market", "market_data") + HALVES + "select * from existing anti join batch using (as_of_date, security_id) union all select * from batch")
def upsert_market_data(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.upsert_market_data(*_halves(spark, sf))


@query(ctes("portfolio", "market", "market_data") + HALVES + "select * from existing where as_of_date not in (select as_of_date from batch) union all select * from batch")
def upsert_market_data_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.upsert_market_data(*_halves(spark, sf), strict=True)


@query(
    ctes("portfolio", "market", "holdings")
    + """, existing as (select *, timestamp '2024-01-01 00:00:00' as upsert_date, 'seed' as upsert_by from holdings where as_of_date <= date '2024-01-20'),
batch as (select as_of_date, port_id, security_id, held_shares * 2 as held_shares, timestamp '2024-02-01 12:00:00' as upsert_date, 'load' as upsert_by from holdings where as_of_date >= date '2024-01-10')
select as_of_date, port_id, security_id, held_shares, strftime(upsert_date, '%Y-%m-%d %H:%M:%S') as upsert_date, upsert_by from (select * from existing anti join batch using (as_of_date, port_id) union all select * from batch)"""
)
def upsert_holdings(spark: SparkSession, sf: str) -> DataFrame:
    existing, batch = _holdings(spark, sf)
    return upsert.upsert_holdings(existing, batch, NOW, "load").withColumn("upsert_date", F.date_format("upsert_date", "yyyy-MM-dd HH:mm:ss"))


def _holdings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    data = written(views.holdings(spark, sf), "holdings")
    existing = data.where("as_of_date <= date'2024-01-20'").withColumns({"upsert_date": F.lit(dt.datetime(2024, 1, 1)), "upsert_by": F.lit("seed")})
    return existing, data.where("as_of_date >= date'2024-01-10'").withColumn("held_shares", F.col("held_shares") * 2)


@query(
    ctes("portfolio", "market", "holdings")
    + """select as_of_date, port_id, security_id, held_shares, 'seed' as upsert_by from holdings where as_of_date <= date '2024-01-20' and as_of_date <> date '2024-01-10'
union all select as_of_date, port_id, security_id, held_shares * 2, 'load' from holdings where as_of_date >= date '2024-01-10'"""
)
def upsert_holdings_first_date(spark: SparkSession, sf: str) -> DataFrame:
    """The strict form: only the load's earliest date is cleared, so later dates are there twice."""
    return upsert.upsert_holdings(*_holdings(spark, sf), NOW, "load", strict=True).drop("upsert_date")


FACTS = """, existing as (select security_id, 'sharesOutstanding' as metric_type, shares_outstanding as metric_value, source_vendor, effective_date, cast(null as date) as end_date from fundamentals)
"""


def _facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All fundamentals, open; and a load of one day with new values."""
    rows = written(views.fundamentals(spark, sf), "fundamentals").select("security_id", F.lit("sharesOutstanding").alias("metric_type"), F.col("shares_outstanding").alias("metric_value"), "source_vendor", "effective_date", F.lit(None).cast("date").alias("end_date"))
    return rows, rows.where("effective_date = date'2024-01-11'").withColumn("metric_value", F.col("metric_value") + 1)


@query(ctes("fundamentals") + FACTS + "select security_id, metric_type, metric_value + (effective_date = date '2024-01-11')::int as metric_value, source_vendor, effective_date, end_date from existing")
def upsert_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """A load as large as what is active replaces it."""
    return upsert.upsert_fundamentals(*_facts(spark, sf), DAY)


@query(
    ctes("fundamentals")
    + FACTS
    + """select security_id, metric_type, metric_value, source_vendor, effective_date, case when effective_date = date '2024-01-11' then date '2024-02-01' end as end_date from existing
union all select security_id, metric, metric_value + 1, source_vendor, effective_date, null from existing, (values ('sharesOutstanding'), ('freeFloat')) m(metric) where effective_date = date '2024-01-11'"""
)
def upsert_fundamentals_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A load of another size closes what is active and opens its own rows."""
    rows, batch = _facts(spark, sf)
    return upsert.upsert_fundamentals(rows, batch.unionByName(batch.withColumn("metric_type", F.lit("freeFloat"))), DAY)


@query("select distinct 'S' || l_partkey as symbol from lineitem where l_partkey not in (select p_partkey from part where p_size > 25)")
def anti_missing_securities(spark: SparkSession, sf: str) -> DataFrame:
    traded = table(spark, sf, "lineitem").select(F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("symbol")).distinct()
    return upsert.missing_securities(traded, views.security_master(spark, sf).where("is_active = 1"))


MAPPED = """with positions as (select distinct 'S' || l_partkey as symbol, case l_returnflag when 'A' then 'STK' when 'N' then 'OPT' else 'XXX' end as ib_security_type, case l_linestatus when 'O' then 'NYSE' else 'NOWHERE' end as ib_exchange, 'USD' as ib_currency from lineitem),
missing as (select * from positions where symbol not in (select 'S' || p_partkey from part where p_size > 25))
"""


@query(
    MAPPED
    + """select symbol, symbol as name, ib_currency as currency, case ib_security_type when 'OPT' then 'Option' else 'Common Stock' end as security_type, case ib_security_type when 'STK' then 'Equity' when 'OPT' then 'Derivatives' else 'Other' end as asset_class,
case ib_exchange when 'NYSE' then 'XNYS' else 'XNAS' end as exchange, 1 as is_active, 'IB' as source_vendor, 'ib_portfolio_loader' as upsert_by, (select max(p_partkey) from part) + row_number() over (order by symbol, security_type, exchange, ib_currency, asset_class) as security_id from missing"""
)
def map_securities(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.when(F.col("l_returnflag") == "A", "STK").when(F.col("l_returnflag") == "N", "OPT").otherwise("XXX").alias("ib_security_type"),
        F.when(F.col("l_linestatus") == "O", "NYSE").otherwise("NOWHERE").alias("ib_exchange"),
        F.lit("USD").alias("ib_currency"),
    )
    master = views.security_master(spark, sf)
    new = upsert.new_securities(upsert.missing_securities(rows, master.where("is_active = 1")), NOW).drop("upsert_date")
    return upsert.with_new_ids(master, new, "security_id", ["symbol", "security_type", "exchange", "currency", "asset_class"])


@query(
    ctes("portfolio", "market", "market_data")
    + """select count(*) as n_rows, count(distinct security_id) as n_securities, count(distinct as_of_date) as n_dates, count(*) - count(close) as n_null_close, count(*) - count(volume) as n_null_volume,
count(*) filter (where volume = 0) as n_zero_volume, count(*) filter (where close <= 0) as n_bad_close, round(min(close), 6) as min_close, round(max(close), 6) as max_close, round(avg(close), 6) as avg_close from market_data"""
)
def quality_market(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.market_report(views.market_data(spark, sf)), "min_close", "max_close", "avg_close")


POSITIONS = "with positions as (select case when c_custkey % 17 = 0 then null else upper(trim('  ' || lower(c_name) || ' ')) end as symbol, try_cast(case when c_custkey % 11 = 0 then 'n/a' when c_custkey % 13 = 0 then '0' else cast(c_custkey as varchar) end as double) as held_shares from customer) "


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = table(spark, sf, "customer").select(F.when(key % 17 != 0, F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))).alias("symbol"), F.when(key % 11 == 0, "n/a").when(key % 13 == 0, "0").otherwise(key.cast("string")).alias("held_shares"))
    return quality.clean_positions(raw)


@query(POSITIONS + "select unnest(['rows', 'null_symbol', 'null_held_shares', 'zero_held_shares']) as \"check\", unnest([count(*), count(*) filter (where symbol is null), count(*) filter (where held_shares is null), count(*) filter (where held_shares = 0)]) as n from positions")
def quality_positions(spark: SparkSession, sf: str) -> DataFrame:
    return quality.position_report(_positions(spark, sf))


@query(POSITIONS + "select symbol, held_shares from positions")
def clean_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _positions(spark, sf)


@query("select count(distinct p_partkey) as wanted, count(distinct l_partkey) as found, round(100.0 * count(distinct l_partkey) / count(distinct p_partkey), 6) as percent from part left join (select l_partkey from lineitem where l_quantity > 49) on l_partkey = p_partkey")
def completion_rate(spark: SparkSession, sf: str) -> DataFrame:
    traded = table(spark, sf, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return rounded(quality.completion_rate(table(spark, sf, "part"), traded, "p_partkey"), "percent")


@query("select substr(p_name, 1, 1) as prefix, count(*) as n from part group by 1 order by n desc, prefix limit 5")
def ticker_prefix_top5(spark: SparkSession, sf: str) -> DataFrame:
    return quality.prefix_histogram(views.security_master(spark, sf), "name")


@query(
    """select security_id, metric_type, metric_value, 'Yahoo Finance' as source_vendor, date '2024-02-01' as effective_date, cast(null as date) as end_date
from (unpivot (select p_partkey as security_id, p_retailprice as "marketCap", case when p_size % 3 <> 0 then cast(p_size as double) end as "sharesOutstanding" from part) on "marketCap", "sharesOutstanding" into name metric_type value metric_value)"""
)
def unpivot_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "part").select(F.col("p_partkey").alias("security_id"), F.col("p_retailprice").alias("marketCap"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double")).alias("sharesOutstanding"))
    return vendor.fundamentals_from_wide(wide, ["marketCap", "sharesOutstanding"], DAY)


KNN = """with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 50 = 0),
away as (select query_id, vec_id, label, list_sum(list_transform(list_zip(embedding, e), lambda p: (p[1]::double - p[2]::double) ** 2)) as exact from embeddings, q),
near as (select query_id, vec_id, label, round(exact, 6) as distance from away qualify row_number() over (partition by query_id order by exact, vec_id) <= 15)
"""


def _knn(spark: SparkSession, sf: str) -> DataFrame:
    """For each vector whose id is divisible by 50, the 15 nearest of all vectors."""
    vectors = table(spark, sf, "embeddings")
    found = search.exact_neighbours(vectors, vectors.where("vec_id % 50 = 0"), 15)
    named = found.withColumnRenamed("id", "vec_id").join(vectors.select("vec_id", "label"), "vec_id")
    return rounded(named.select("query_id", "vec_id", "label", "distance"), "distance")


@query(KNN + "select * from near")
def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf)


@query("select count(*) filter (where vec_id % 50 = 0) as queries, least(15, count(*)) * count(*) filter (where vec_id % 50 = 0) as answers, true as enough from embeddings")
def knn_index(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted file against the exact search: queries, answers, and whether 0.9 of the exact ones are found."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    index = search.Index.fit(vectors, nlist=max(2, int(vectors.count() ** 0.5)), nprobe=2)
    found, true = written(index.neighbours(vectors, asked), "found"), search.exact_neighbours(vectors, asked)
    hits = true.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left").agg(F.coalesce(F.sum("hit") >= 0.9 * F.count("*"), F.lit(True)).alias("enough"))
    return found.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("answers")).join(hits)


@query(KNN + "select query_id, vec_id, round(1 / (1 + distance) + case when label % 2 = 0 then 0.1 else 0 end, 6) as score from near qualify row_number() over (partition by query_id order by 1 / (1 + distance) + case when label % 2 = 0 then 0.1 else 0 end desc, vec_id) <= 5")
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    found = _knn(spark, sf).select("query_id", "vec_id", "distance", F.col("vec_id").alias("rank"), F.when(F.col("label") % 2 == 0, "code_semantic").otherwise("code_text").alias("type"))
    return rounded(retrieval.rerank_simple(found, "which function does it", 5, ["query_id"]).select("query_id", "vec_id", "score"), "score")


@query(
    KNN
    + """, scored as (select query_id, vec_id, 1 / (1 + distance) + 0.15 * case when label % 2 = 0 then case when label % 4 = 0 then 0.2 else 0 end else 0 end + 0.05 * case when vec_id % 3 = 0 then 0.1 else 0 end + 0.1 * case when label % 2 = 0 then 0.1 else 0 end + 0.05 * case when vec_id % 5 = 0 then -0.05 else 0 end as s from near)
select query_id, vec_id, round(s, 6) as score from scored qualify row_number() over (partition by query_id order by s desc, vec_id) <= 8"""
)
def rerank_advanced(spark: SparkSession, sf: str) -> DataFrame:
    entity, when = F.when(F.col("label") % 4 == 0, "function").otherwise("class"), F.when(F.col("vec_id") % 3 == 0, "2024-01-30T00:00:00").otherwise("2023-01-01T00:00:00")
    found = _knn(spark, sf).select("query_id", "vec_id", "distance", F.col("vec_id").alias("rank"), F.when(F.col("label") % 2 == 0, "code_semantic").otherwise("code_text").alias("type"), F.repeat(F.lit("x"), F.when(F.col("vec_id") % 5 == 0, 100).otherwise(1000)).alias("content"), F.create_map(F.lit("entity_type"), entity, F.lit("last_modified"), when).alias("metadata"))
    return rounded(retrieval.rerank(found, "which function does it", NOW, 8, ["query_id"]).select("query_id", "vec_id", "score"), "score")


@query(
    """with e as (select conv_id, turn, coalesce(text, '') as query, coalesce(lead(text) over (partition by conv_id order by turn), '') as response, role from conversations),
r as (select *, row_number() over (partition by conv_id order by turn desc) as n from e where role = 'user')
select conv_id, string_agg('Previous Q: ' || query || chr(10) || 'Previous A: ' || substr(response, 1, 200) || '...', chr(10) order by turn) as context from r where n <= 3 group by conv_id"""
)
def conversation_context(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf, "conversations").withColumn("response", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return retrieval.conversation_context(turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), "response"), "conv_id", "turn")


CHUNKS = r"""with recursive docs as (select doc_id, text, string_split(text, chr(10)) as ls from documents where text is not null),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as k, len(ls) as n from docs where length(text) > 1000),
marked as (select *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as t from lines),
sums as (select doc_id, k, line, n, sum(length(line) + 1) over w as q, sum(length(line) + 1) over w - length(line) - 1 as p, {close} as close from marked window w as (partition by doc_id order by k)),
cuts as (
  select doc_id, 0 as no, cast(0 as bigint) as first, min(k) filter (where k > 0 and q > 1000 and close) as k from sums group by doc_id
  union all
  select g.doc_id, g.no + 1, g.start, min(s.k) filter (where s.k > g.k and s.k > g.start and s.q - g.base > 1000 and s.close)
  from (select c.doc_id, c.no, c.k, min(b.k) as start, min(b.p) as base from cuts c join sums a on a.doc_id = c.doc_id and a.k = c.k join sums b on b.doc_id = c.doc_id and b.k >= c.first and b.k <= c.k and b.p >= a.p - 200 group by all) g
  join sums s on s.doc_id = g.doc_id group by g.doc_id, g.no, g.start, g.k),
texts as (select c.doc_id, c.no, string_agg(s.line, chr(10) order by s.k) as content from cuts c join sums s on s.doc_id = c.doc_id and s.k >= c.first and s.k < coalesce(c.k, s.n) group by c.doc_id, c.no)
select doc_id, cast(row_number() over (partition by doc_id order by no) - 1 as int) as chunk_no, content from texts where length(content) > 100
union all select doc_id, 0, text from docs where length(text) <= 1000"""
CLOSE = r"bool_or(regexp_matches(t, '^(def |class |# ===|\x22{3}|\x27{3}|#.{10})|(\x22{3}|\x27{3})$')) over (partition by doc_id order by k rows between 3 preceding and 3 following)"


@query(CHUNKS.replace("{close}", "true"))
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_texts(table(spark, sf, "documents"), "doc_id", boundary_aware=False)


@query(CHUNKS.replace("{close}", CLOSE))
def chunk_documents_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.chunk_texts(table(spark, sf, "documents"), "doc_id", boundary_aware=True)


@query(
    """with recursive docs as (select doc_id // 8 as pack, row_number() over (partition by doc_id // 8 order by doc_id) as n, source, lang, coalesce(text, '') as body, len(string_split(text, chr(10))) as n_lines from documents),
heads as (select pack, n, '[Source ' || n || ': ' || source || ' (' || lang || ') | Lines: ' || n_lines || ']' as head, body from docs),
packing as (
  select distinct pack, cast(0 as bigint) as n, cast(0 as bigint) as used, '' as parts, false as done from docs
  union all
  select p.pack, h.n, case when fits then used + length(part) else used end, case when fits then parts || case when parts = '' then '' else chr(10) end || part else parts end, not fits
  from packing p join heads h on h.pack = p.pack and h.n = p.n + 1,
    lateral (select used + length(head) + length(body) + 50 > 8000 as over_, 8000 - used - length(head) - 100 as room) a,
    lateral (select not over_ or room > 100 as fits, head || chr(10) || case when over_ then substr(body, 1, greatest(room, 0)) || chr(10) || '... [truncated]' else body end || chr(10) as part) b
  where not done)
select pack, chr(10) || repeat('=', 60) || chr(10) || parts as context from packing p where n = (select max(n) from packing q where q.pack = p.pack)"""
)
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 8).alias("pack"), "doc_id", F.col("source"), F.col("lang").alias("type"), F.col("text").alias("content"), F.create_map(F.lit("line_count"), F.size(F.split("text", "\n")).cast("string")).alias("metadata"))
    return retrieval.packed_context(docs, ["pack"], "doc_id")


@query("select o_orderkey, case dayofweek(cast(o_orderdate as date)) when 0 then cast(o_orderdate as date) - 2 when 6 then cast(o_orderdate as date) - 1 else cast(o_orderdate as date) end as weekday from orders")
def last_weekday_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", last_weekday(F.col("o_orderdate").cast("date")).alias("weekday"))


@query("select as_of_date, max(close) as top_close, count(*) as n from (select cast(ts as date) as as_of_date, round(value, 1) as close from events where ts >= timestamp '2024-01-28' and ts < timestamp '2024-01-31') group by 1")
def recent_range(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the range that a load of the last days asks for, both ends included."""
    start, end = date_range("recent", LAST, 2)
    days = table(spark, sf, "events").select(F.col("ts").cast("date").alias("as_of_date"), F.round("value", 1).alias("close"))
    return days.where(F.col("as_of_date").between(start, end)).groupBy("as_of_date").agg(F.max("close").alias("top_close"), F.count("*").alias("n"))


@query("select distinct ltrim(lower(regexp_replace(replace(p_type, ' ', ''), '([A-Z])', '_\\1', 'g')), '_') as metric from part")
def metric_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(snake_case_column(F.replace(F.col("p_type"), F.lit(" "), F.lit(""))).alias("metric")).distinct()


@query("select p_partkey, round_even(p_retailprice / 7, 4) as price from part")
def rounded_prices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", half_even(F.col("p_retailprice") / 7, 4).alias("price"))


@query("with s as (select n_nationkey, n_name, n_regionkey from nation) select a.n_nationkey as nation, a.n_name as n_name_x, b.n_name as n_name_y, a.n_regionkey as region from s a join s b using (n_nationkey, n_regionkey)")
def join_with_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    side = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region"))
    return vendor.prefixed_join(side, side, ["nation", "region"])


@query("select o_custkey, c_name, count(*) as n, cast(max(o_orderdate) as date) as last_day from orders join customer on c_custkey = o_custkey group by all order by n desc, o_custkey limit 10")
def top_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Names are joined to the counts, not to every order; the order and the limit are one top-k over both."""
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").alias("last_day"))
    named = counts.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return named.orderBy(F.desc("n"), "o_custkey").limit(10)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("select cast(ts as date) as as_of_date, " + ", ".join(f"""count(*) filter (where event_type = '{e}') as "{e}\"""" for e in EVENT_TYPES) + " from events group by 1")
def pivot_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("as_of_date")).pivot("event_type", EVENT_TYPES).agg(F.count("ts"))
    return events.fillna(0)


@query(
    """with days as (select user_id, cast(ts as date) as day, max(value) as value from events where event_type = 'purchase' group by 1, 2),
spans as (select user_id, min(day) as lo, max(day) as hi from days group by 1),
grid as (select user_id, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from spans)
select g.user_id, g.day, last_value(d.value ignore nulls) over (partition by g.user_id order by g.day) as value from grid g left join days d using (user_id, day)"""
)
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.max("value").alias("value"))
    return temporal.daily_forward_fill(days, "user_id", "day", "value")
