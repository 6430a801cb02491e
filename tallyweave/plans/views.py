"""Analytics tables derived from the driver's tables, in Spark and as CTEs of the same content in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _market(spark: SparkSession, sf_dir: str, security) -> DataFrame:
    cells = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("as_of_date"), F.col("event_type").alias("portfolio_short_name"), security.alias("security_id")).agg(F.avg("value").alias("close"), F.count("*").alias("volume"))
    cells = cells.where("close > 0")
    return cells.join(F.broadcast(portfolio(spark, sf_dir)), "portfolio_short_name").select(
        "as_of_date",
        "port_id",
        "portfolio_short_name",
        "portfolio_type",
        "security_id",
        "close",
        "volume",
        (1 + F.col("security_id") % 5).cast("double").alias("held_shares"),
        (1000 * (1 + F.col("security_id"))).cast("double").alias("shares_outstanding"),
    )


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each event type, of which there are a handful."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("portfolio_short_name")).distinct()
    kind = F.when(F.col("portfolio_short_name") == "view", "Benchmark").otherwise("Portfolio")
    return names.select(F.row_number().over(Window.orderBy("portfolio_short_name")).cast("long").alias("port_id"), "portfolio_short_name", F.upper("portfolio_short_name").alias("portfolio_name"), kind.alias("portfolio_type"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _market(spark, sf_dir, F.col("user_id") % 10)


def market_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _market(spark, sf_dir, F.col("user_id"))


def security_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("security_id"),
        F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("sector"),
        F.col("p_type").alias("security_type"),
        (F.col("p_size") > 25).cast("int").alias("is_active"),
        F.lit("parts").alias("source_vendor"),
    )


def market_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir).groupBy("as_of_date", "security_id").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume"))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market(spark, sf_dir).select("as_of_date", "port_id", "security_id", "held_shares")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size"))
    rows = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 10).alias("security_id"), day.alias("effective_date")).agg(F.max("p_retailprice").alias("shares_outstanding"), F.max(F.col("p_size") * 2).cast("double").alias("free_float"))
    return rows.select("security_id", "effective_date", "shares_outstanding", "free_float", F.lit("parts-fundamentals").alias("source_vendor"))


def membership_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("event_type") == "signup", "Joiner").otherwise("Leaver")
    return table(spark, sf_dir, "events").where("event_type in ('signup', 'error')").select(F.col("user_id").cast("string").alias("ric"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("exchange_ticker"), F.col("ts").alias("date"), F.col("event_id").alias("seq"), change.alias("change"))


def membership_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 2 = 0")
    return users.select(F.col("user_id").cast("string").alias("ric"), F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("exchange_ticker"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("ric").orderBy("date", "seq").rowsBetween(1, Window.unboundedFollowing)
    events = membership_events(spark, sf_dir).withColumn("left_at", F.min(F.when(F.col("change") == "Leaver", F.col("date"))).over(order))
    return events.where("change = 'Joiner'").select("ric", F.col("date").cast("date").alias("start_date"), F.col("left_at").cast("date").alias("end_date"))


#: The same tables as CTEs.
SQL = {
    "portfolio": """portfolio as (select row_number() over (order by event_type) as port_id, event_type as portfolio_short_name, upper(event_type) as portfolio_name,
      case when event_type = 'view' then 'Benchmark' else 'Portfolio' end as portfolio_type from (select distinct event_type from events))""",
    "market": """market as (select as_of_date, port_id, m.portfolio_short_name, portfolio_type, security_id, close, volume, cast(1 + security_id % 5 as double) as held_shares, cast(1000 * (1 + security_id) as double) as shares_outstanding
      from (select cast(ts as date) as as_of_date, event_type as portfolio_short_name, user_id % 10 as security_id, avg(value) as close, count(*) as volume from events group by all) m join portfolio using (portfolio_short_name) where close > 0)""",
    "market_sparse": """market as (select as_of_date, port_id, m.portfolio_short_name, portfolio_type, security_id, close, volume, cast(1 + security_id % 5 as double) as held_shares, cast(1000 * (1 + security_id) as double) as shares_outstanding
      from (select cast(ts as date) as as_of_date, event_type as portfolio_short_name, user_id as security_id, avg(value) as close, count(*) as volume from events group by all) m join portfolio using (portfolio_short_name) where close > 0)""",
    "security_master": """security_master as (select p_partkey as security_id, 'S' || p_partkey as symbol, p_name as name, p_brand as sector, p_type as security_type, cast(p_size > 25 as int) as is_active, 'parts' as source_vendor from part)""",
    "market_data": """market_data as (select as_of_date, security_id, avg(close) as close, cast(sum(volume) as bigint) as volume from market group by all)""",
    "holdings": """holdings as (select as_of_date, port_id, security_id, held_shares from market)""",
    "fundamentals": """fundamentals as (select p_partkey % 10 as security_id, cast(date '2024-01-01' + p_size as date) as effective_date, max(p_retailprice) as shares_outstanding, cast(max(p_size * 2) as double) as free_float, 'parts-fundamentals' as source_vendor from part group by 1, 2)""",
    "returns": """returns as (select as_of_date, portfolio_short_name, security_id, close / px - 1 as simple_return, ln(close / px) as log_return
      from (select *, lag(close) over (partition by port_id, security_id order by as_of_date) as px from market) where px is not null)""",
    "grid": """shared as (select *, case when portfolio_type = 'Benchmark' then coalesce(shares_outstanding * close / nullif(sum(shares_outstanding * close) over (partition by as_of_date, portfolio_short_name), 0), 0) else held_shares end as held from market),
      grid as (select d.as_of_date, p.portfolio_short_name, p.security_id, coalesce(s.close, 0) as px, coalesce(s.held, 0) as held
        from (select distinct as_of_date from market) d cross join (select distinct portfolio_short_name, security_id from market) p left join shared s on s.as_of_date = d.as_of_date and s.portfolio_short_name = p.portfolio_short_name and s.security_id = p.security_id),
      lagged as (select *, coalesce(lag(px) over (partition by portfolio_short_name, security_id order by as_of_date), 0) as px_before from grid),
      methods as (select as_of_date, portfolio_short_name, security_id,
        case when held <> 0 then 1.0 / sum(case when held <> 0 then 1.0::double else 0 end) over day else 0 end as equal_weighted,
        coalesce(held * px_before / nullif(sum(held * px_before) over day, 0), 0) as market_weighted, coalesce(px / nullif(sum(px) over day, 0), 0) as price_weighted
        from lagged window day as (partition by as_of_date, portfolio_short_name))""",
}


def ctes(*names: str) -> str:
    return "with recursive " + ", ".join(SQL[n] for n in names)
