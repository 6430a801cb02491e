"""Queries through the store, vendor formats, files and the retrieval layer: what is written is read back and compared."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.scalar import content_hash
from tallyweave.operators import chunking, membership, quality, temporal, upsert
from tallyweave.plans import views
from tallyweave.plans.queries import DAY, FIRST, INTERVALS, NOW
from tallyweave.plans.registry import ORACLES, query, rounded
from tallyweave.plans.views import ctes, table
from tallyweave.sources import files, vendor
from tallyweave.sources.buckets import Bucketed
from tallyweave.sources.tables import Store
from tallyweave.staging import fresh_path, written


def _store(spark: SparkSession, **tables: DataFrame) -> Store:
    """A store in the shared folder with these tables."""
    store = Store(spark, fresh_path(spark, "store"))
    for name, rows in tables.items():
        store.append(name, rows)
    return store


MASTER = "select security_id, symbol, name, sector, security_type, is_active, source_vendor from security_master"
MASTER_COLUMNS = ["security_id", "symbol", "name", "sector", "security_type", "is_active", "source_vendor"]


@query(ctes("security_master") + MASTER)
def scan_security_master(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, security_master=views.security_master(spark, sf)).security_master().select(*MASTER_COLUMNS)


@query(ctes("security_master") + MASTER + " union all select security_id + (select max(security_id) from security_master), symbol || '.N', name, sector, security_type, is_active, source_vendor from security_master")
def append_security_master(spark: SparkSession, sf: str) -> DataFrame:
    """A second load is appended to the first."""
    rows = views.security_master(spark, sf)
    store = _store(spark, security_master=rows)
    top = rows.agg(F.max("security_id")).first()[0]
    store.append("security_master", rows.withColumns({"security_id": F.col("security_id") + F.lit(top), "symbol": F.concat("symbol", F.lit(".N"))}))
    return store.security_master().select(*MASTER_COLUMNS)


@query(ctes("portfolio") + "select port_id, portfolio_short_name, portfolio_name, portfolio_type from portfolio where portfolio_short_name in ('view', 'click', 'none')")
def scan_portfolio(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, portfolio=views.portfolio(spark, sf)).portfolio(["view", "click", "none"])


@query(ctes("portfolio", "market", "holdings") + "select as_of_date, port_id, security_id, held_shares from holdings where as_of_date between date '2024-01-05' and date '2024-01-20'")
def scan_holdings(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, portfolio_holdings=views.holdings(spark, sf)).portfolio_holdings("2024-01-05", "2024-01-20")


@query(ctes("portfolio", "market", "market_data") + "select as_of_date, security_id, round(close, 6) as close, volume from market_data where as_of_date between date '2024-01-05' and date '2024-01-20'")
def scan_market_data(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_store(spark, market_data=views.market_data(spark, sf)).market_data("2024-01-05", "2024-01-20").select("as_of_date", "security_id", "close", "volume"), "close")


@query(ctes("fundamentals") + "select security_id, effective_date, shares_outstanding from fundamentals")
def scan_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """With a metric, the value column is named after it; rows of the other metric are not read."""
    rows = views.fundamentals(spark, sf)
    both = rows.select("security_id", "source_vendor", "effective_date", F.inline(F.array(*[F.struct(F.lit(m).alias("metric_type"), F.col(c).alias("metric_value")) for m, c in (("sharesOutstanding", "shares_outstanding"), ("freeFloat", "free_float"))])))
    return _store(spark, security_fundamentals=both).security_fundamentals("sharesOutstanding").select("security_id", "effective_date", "shares_outstanding")


CONSTITUENTS = INTERVALS + "select user_id // 10 as index_id, user_id as security_id, 'S' || ric as exchange_ticker, start_date, end_date from (select *, cast(ric as bigint) as user_id from intervals)"


def _constituents(spark: SparkSession, sf: str) -> DataFrame:
    user = F.col("ric").cast("long")
    return views.intervals(spark, sf).select(F.floor(user / 10).alias("index_id"), user.alias("security_id"), F.concat(F.lit("S"), "ric").alias("exchange_ticker"), "start_date", "end_date")


CONSTITUENT_COLUMNS = ["index_id", "security_id", "exchange_ticker", "start_date", "end_date"]


@query(CONSTITUENTS)
def scan_index_constituents(spark: SparkSession, sf: str) -> DataFrame:
    """The dates restrict nothing."""
    return _store(spark, index_constituents=_constituents(spark, sf)).index_constituents("2024-01-05", "2024-01-06").select(*CONSTITUENT_COLUMNS)


@query(CONSTITUENTS + " where user_id // 10 % 2 = 1 union all select user_id // 10, user_id, 'S' || ric || '.N', start_date, null from (select *, cast(ric as bigint) as user_id from intervals) where user_id // 10 % 2 = 0")
def upsert_index_constituents(spark: SparkSession, sf: str) -> DataFrame:
    """A load of the even indexes replaces all rows of these; the odd ones stay."""
    rows = written(_constituents(spark, sf), "constituents")
    batch = rows.where("index_id % 2 = 0").withColumns({"exchange_ticker": F.concat("exchange_ticker", F.lit(".N")), "end_date": F.lit(None).cast("date")})
    return upsert.upsert_index_constituents(rows, batch).select(*CONSTITUENT_COLUMNS)


@query(ctes("security_master") + "select security_id, symbol, case when security_id in (select l_partkey from lineitem where l_quantity > 45) then 1 else is_active end as is_active from security_master")
def activate_securities(spark: SparkSession, sf: str) -> DataFrame:
    traded = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("symbol"))
    return upsert.activated(views.security_master(spark, sf), traded).select("security_id", "symbol", "is_active")


@query("with old as (select row_number() over (order by event_type) as port_id, event_type as portfolio_short_name from (select distinct event_type from events)) select (select max(port_id) from old) + row_number() over (order by portfolio_short_name) as port_id, portfolio_short_name, 'load' as upsert_by, '2024-02-01 12:00:00' as upsert_date from (select distinct n_name as portfolio_short_name from nation)")
def insert_select(spark: SparkSession, sf: str) -> DataFrame:
    """Selected rows get stamps and identities, and come back."""
    selected = table(spark, sf, "nation").select(F.col("n_name").alias("portfolio_short_name")).distinct()
    _, new = upsert.inserted_from(views.portfolio(spark, sf), selected, "port_id", ["portfolio_short_name"], NOW, "load")
    return new.select("port_id", "portfolio_short_name", "upsert_by", F.date_format("upsert_date", "yyyy-MM-dd HH:mm:ss").alias("upsert_date"))


PORTFOLIO_MARKET = (
    ctes("portfolio", "market", "security_master", "market_data", "holdings", "fundamentals")
    + """select h.as_of_date, h.security_id, h.held_shares, p.portfolio_short_name, s.symbol, round(m.close, 6) as close, f.shares_outstanding
from holdings h join portfolio p using (port_id) join security_master s using (security_id) join market_data m using (security_id, as_of_date)
asof left join fundamentals f on f.security_id = h.security_id and h.as_of_date >= f.effective_date
where portfolio_short_name in ('view', 'click') and h.as_of_date between date '2024-01-05' and date '2024-01-25'"""
)
PORTFOLIO_MARKET_COLUMNS = ["as_of_date", "security_id", "held_shares", "portfolio_short_name", "symbol", "close", "shares_outstanding"]


@query(PORTFOLIO_MARKET)
def bucketed_portfolio_market_data(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads into tables bucketed alike; the read has no exchange between them."""
    store, prices = Bucketed(spark, fresh_path(spark, "buckets"), buckets=8), views.market_data(spark, sf)
    for part in ("as_of_date < date '2024-01-13'", "as_of_date >= date '2024-01-13'"):
        store.load(views.holdings(spark, sf).where(part), prices.where(part), views.security_master(spark, sf), views.fundamentals(spark, sf))
    picked = views.portfolio(spark, sf).where("portfolio_short_name in ('view', 'click')")
    return rounded(store.portfolio_market_data(picked, "2024-01-05", "2024-01-25").select(*PORTFOLIO_MARKET_COLUMNS), "close")


@query(PORTFOLIO_MARKET)
def store_portfolio_market_data(spark: SparkSession, sf: str) -> DataFrame:
    facts = views.fundamentals(spark, sf).select("security_id", F.lit("sharesOutstanding").alias("metric_type"), F.col("shares_outstanding").alias("metric_value"), "source_vendor", "effective_date")
    store = _store(spark, portfolio=views.portfolio(spark, sf), portfolio_holdings=views.holdings(spark, sf), security_master=views.security_master(spark, sf), market_data=views.market_data(spark, sf), security_fundamentals=facts)
    found = store.portfolio_market_data("2024-01-05", "2024-01-25", ["view", "click"])
    return rounded(found.select(*PORTFOLIO_MARKET_COLUMNS), "close")


@query("select p_partkey as security_id, m.metric_type, case m.metric_type when 'price' then p_retailprice else p_size::double end as metric_value, 'SimFin' as source_vendor, cast(date '2024-01-01' + p_size as date) as effective_date, cast(null as date) as end_date from part, (values ('price'), ('size')) m(metric_type) where p_partkey % 7 <> 0")
def json_fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that are no JSON give no rows."""
    day = F.date_format(F.date_add(F.lit(FIRST), F.col("p_size")), "yyyy-MM-dd").alias("endDate")
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"), day) for m, c in (("price", "p_retailprice"), ("size", "p_size"))])
    answers = table(spark, sf, "part").select(F.col("p_partkey").alias("security_id"), F.when(F.col("p_partkey") % 7 != 0, F.to_json(entries)).otherwise("not found").alias("body"))
    return vendor.fundamentals_from_json(answers)


@query("select p_partkey as security_id, case when p_partkey % 5 = 0 then null when p_partkey % 3 = 0 then 'BRK' else 'S' || p_partkey || '.O' end as ric from part")
def resolve_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Symbols the lookup lacks keep their row; an override takes those whose name holds its key."""
    symbols = views.security_master(spark, sf).select("symbol", "security_id")
    code = F.concat("symbol", F.when(F.col("security_id") % 3 == 0, ".old").otherwise(".O"))
    lookup = symbols.where("security_id % 5 <> 0").select("symbol", code.alias("ric"))
    return vendor.resolved(symbols, lookup, {".old": "BRK"}).select("security_id", "ric")


#: Prices with a fifth digit, which both formats round away.
PRICES = ctes("portfolio", "market", "market_data") + ", quotes as (select as_of_date, security_id, volume, volume + security_id / 8.0::double as px from market_data) select as_of_date, security_id, round(px, 4) as close, round(px * 2 + 0.0001, 4) as adj_close, round(px - 1, 4) as open, volume, '1d' as interval from quotes"


def _quotes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    quotes = views.market_data(spark, sf).withColumns({"symbol": F.concat(F.lit("S"), F.col("security_id").cast("string")), "close": F.col("volume") + F.col("security_id") / 8 + 0.00003})
    return quotes, quotes.select("symbol", "security_id", F.col("symbol").alias("ric")).distinct()


@query(PRICES)
def yahoo_prices(spark: SparkSession, sf: str) -> DataFrame:
    quotes, symbols = _quotes(spark, sf)
    raw = quotes.select("symbol", F.col("as_of_date").cast("timestamp").alias("Date"), F.col("close").alias("Close"), (F.col("close") * 2).alias("Adj Close"), (F.col("close") - 1).alias("Open"), F.col("volume").alias("Volume"))
    return vendor.yahoo_prices(raw, symbols, NOW).select("as_of_date", "security_id", "close", "adj_close", "open", "volume", "interval")


@query(PRICES)
def refinitive_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of one name are told apart by their place."""
    quotes, symbols = _quotes(spark, sf)
    raw = quotes.select("symbol", F.col("as_of_date").cast("timestamp"), F.col("close") - 1, "close", F.col("close") * 2, "volume").toDF("Instrument", "Date", "Open Price", "Close Price", "Close Price", "Accumulated Volume")
    return vendor.refinitive_prices(raw, symbols, NOW).select("as_of_date", "security_id", "close", "adj_close", "open", "volume", "interval")


def two_days(symbol: str, start: str, end: str) -> Iterator[tuple]:
    """Made-up prices of a symbol on two days; every seventh symbol is not known."""
    number = int(symbol[1:])
    if number % 7 == 0:
        raise ValueError("unknown symbol")
    for k in range(2):
        yield dt.date.fromisoformat(start) + dt.timedelta(days=k), number + 0.5, number + 1.0, number + 0.25, number + k / 8, number + k / 8, number * 10, 0.0, 0.0


def _loaded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    spark.dataSource.register(vendor.eod_source("two_days", two_days))
    symbols = views.security_master(spark, sf).select("symbol", "security_id")
    return vendor.load_prices("two_days", symbols, FIRST, DAY, batch=max(50, symbols.count() // 16))


@query("select cast(date '2024-01-01' + k as date) as as_of_date, p_partkey as security_id, p_partkey + 0.5::double as open, p_partkey + 0.25::double as low, round(p_partkey + k / 8.0::double, 4) as close, p_partkey * 10 as volume from part, (values (0), (1)) d(k) where p_partkey % 7 <> 0")
def load_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Requests of a vendor's source, several symbols a task."""
    return _loaded(spark, sf)[0].select("as_of_date", "security_id", "open", "low", "close", "volume")


@query("select 'S' || p_partkey as symbol from part where p_partkey % 7 = 0")
def failed_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _loaded(spark, sf)[1].select("symbol")


@query("select distinct l_partkey as security_id from lineitem where l_partkey not in (select p_partkey from part where p_size < 40)")
def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("security_id"))
    return quality.missing_report(wanted, table(spark, sf, "part").where("p_size < 40").select(F.col("p_partkey").alias("security_id")), "security_id")


@query(
    ORACLES["membership_fold"].replace("select ric, x.ticker as exchange_ticker, x.low as start_date, x.high as end_date from last", "")
    + "select cast(3 as bigint) as index_id, p_partkey as security_id, x.ticker as exchange_ticker, x.low as start_date, x.high as end_date, 'refinitive' as source_vendor, ric from last left join part on x.ticker = 'S' || p_partkey"
)
def build_index_constituents(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot, changes and security master, composed."""
    events = views.membership_events(spark, sf)
    members = views.membership_seeds(spark, sf)
    tickers = events.select("ric", "exchange_ticker").distinct()
    built = membership.index_constituents(members, events.select("ric", "date", "seq", "change"), tickers, views.security_master(spark, sf), FIRST, NOW, 3)
    return built.drop("upsert_date", "upsert_by")


POSITIONS_SQL = """with positions as (select case when c_custkey % 3 = 0 then 'view' else 'none' end as portfolio_short_name, case when c_custkey % 17 = 0 then null else 'S' || c_custkey end as symbol, case when c_custkey % 13 = 0 then 0 else c_custkey end::double as held_shares from customer)
"""


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    account = table(spark, sf, "customer").select(
        F.when(key % 3 == 0, "view").otherwise("none").alias("portfolio_short_name"), F.when(key % 17 != 0, F.concat(F.lit("S"), key.cast("string"))).alias("symbol"), F.lit("STK").alias("ib_security_type"),
        F.lit("NYSE").alias("ib_exchange"), F.lit("USD").alias("ib_currency"), F.when(key % 13 == 0, 0).otherwise(key).cast("double").alias("held_shares"), F.lit(1.0).alias("avg_cost"),
    )

    def fetch(name: str) -> DataFrame:
        if name == "closed":
            raise ValueError("no such account")
        return account

    return vendor.positions_by_account(fetch, ["open", "closed"], dt.date(2024, 1, 28))[0]


@query(POSITIONS_SQL + "select 'Found ' || n || ' null values in critical column ''symbol''' as issue from (select count(*) as n from positions where symbol is null) union all select 'Found ' || n || ' positions with zero shares' from (select count(*) as n from positions where held_shares = 0)")
def position_issues(spark: SparkSession, sf: str) -> DataFrame:
    return quality.issue_rows(_positions(spark, sf))


@query(POSITIONS_SQL + ", portfolio as (select row_number() over (order by event_type) as port_id, event_type as portfolio_short_name from (select distinct event_type from events)) select date '2024-01-26' as as_of_date, port_id, p_partkey as security_id, held_shares from positions join portfolio using (portfolio_short_name) join part on symbol = 'S' || p_partkey")
def holdings_from_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of known portfolios and securities as holdings; the last weekday dates them."""
    held = views.portfolio(spark, sf).select("port_id", "portfolio_short_name").join(_positions(spark, sf), "portfolio_short_name")
    return held.join(views.security_master(spark, sf).select("symbol", "security_id"), "symbol").select("as_of_date", "port_id", "security_id", "held_shares")


@query("select p_partkey, p_name, p_size, p_retailprice from part")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.csv(path, header=True)
    return files.csv(spark, path, "p_partkey long, p_name string, p_size int, p_retailprice double")


@query("select n_nationkey, n_name from nation")
def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    """A file that is one list of objects."""
    path = fresh_path(spark, "json")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return files.json_rows(spark, path, "n_nationkey long, n_name string, n_regionkey long", ["n_nationkey", "n_name"])


KEYS = ["Ticker", "SimFinId", "Currency", "FiscalYear", "FiscalPeriod", "ReportDate"]
KEY_SQL = ", ".join(f'"{k}"' for k in KEYS)


@query(f"""with part_ as (select 'S' || p_partkey as "Ticker", p_partkey as "SimFinId", 'USD' as "Currency", 2020 + p_size % 3 as "FiscalYear", 'FY' as "FiscalPeriod", cast(date '2020-12-31' + p_size as date) as "ReportDate", p_retailprice as price, p_size as size from part)
select {KEY_SQL}, price as "Shares_x", size * 2 as "Shares_y", size as "Debt" from part_ where size > 10""")
def bulk_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Three bulk files joined on six keys."""
    rows = table(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("Ticker"), F.col("p_partkey").alias("SimFinId"), F.lit("USD").alias("Currency"), (2020 + F.col("p_size") % 3).alias("FiscalYear"), F.lit("FY").alias("FiscalPeriod"), F.date_add(F.lit(dt.date(2020, 12, 31)), F.col("p_size")).alias("ReportDate"), "p_retailprice", "p_size")
    kept = {"income": (F.col("p_retailprice").alias("Shares"), "double"), "cash": ((F.col("p_size") * 2).alias("Shares"), "int"), "balance": (F.col("p_size").alias("Debt"), "int")}
    paths, schemas = [], []
    for name, (column, kind) in kept.items():
        paths.append(fresh_path(spark, name))
        rows.where("p_size > 10" if name == "balance" else "true").select(*KEYS, column).write.csv(paths[-1], header=True, sep=";")
        schemas.append(f"Ticker string, SimFinId long, Currency string, FiscalYear int, FiscalPeriod string, ReportDate date, {'Debt' if name == 'balance' else 'Shares'} {kind}")
    return vendor.bulk_statements(spark, paths, schemas, KEYS)


@query("select p_partkey, p_name from part")
def drop_null_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.lit(None).cast("string").alias("isin"), F.when(F.col("p_size") < 0, F.col("p_size")).alias("sedol"))
    return quality.without_null_columns(rows)


@query("select doc_id, sha256(coalesce(source, '') || chr(31) || coalesce(text, '')) as sha256, md5(coalesce(source, '') || chr(31) || coalesce(text, '')) as md5 from documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", content_hash(F.col("source"), F.col("text")).alias("sha256"), content_hash(F.col("source"), F.col("text"), kind="md5").alias("md5"))


@query("select 'region' as source, 'sql_sample' as type, 'r_regionkey | r_name' || chr(10) || string_agg(r_regionkey || ' | ' || r_name, chr(10) order by r_regionkey) as content from (select * from region order by r_regionkey limit 5)")
def sample_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return files.sample_chunk(table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "region")


#: A source text for each part: an import, a decorated function and a class with two methods.
CODE = ["import os\n", "@cached\ndef part_", "(x):\n", "    total = x + 1  # adds one to what is given\n", "class Part_", ":\n    def first(self):\n", "    def second(self):\n"]


def _code(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    body = F.repeat(F.lit(CODE[3]), 3)
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit(CODE[0] + CODE[1]), key, F.lit(CODE[2]), body, F.lit(CODE[4]), key, F.lit(CODE[5]), body, F.lit(CODE[6]), body).alias("text"))


def _text(value: str) -> str:
    return "'" + value.replace("\n", "' || chr(10) || '") + "'"


@query(
    f"""with b as (select p_partkey as k, rtrim(repeat({_text(CODE[3])}, 3), chr(10)) as body from part)
select k as p_partkey, 0 as entity_no, 'function' as entity_type, 'part_' || k as entity_name, true as has_decorators, cast(null as int) as method_count, 5 as line_count, {_text(CODE[0] + chr(10) + CODE[1])} || k || {_text(CODE[2])} || body as content from b
union all select k, 1, 'function', 'first', false, null, 8, {_text(CODE[0] + chr(10) + CODE[5].split(chr(10))[1].strip() + chr(10))} || body || chr(10) || {_text(CODE[6])} || body from b
union all select k, 2, 'class', 'Part_' || k, false, 2, 9, {_text(CODE[0] + chr(10) + CODE[4])} || k || {_text(CODE[5])} || body || chr(10) || {_text(CODE[6])} || body from b"""
)
def code_entities(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.code_entities(_code(spark, sf), "p_partkey")


@query(f"with b as (select p_partkey as k, rtrim(repeat({_text(CODE[3])}, 3), chr(10)) as body from part) select k as p_partkey, 'def part_' || k || {_text(CODE[2])} || body as content from b union all select k, {_text(CODE[5].split(chr(10))[1].strip() + chr(10))} || body || chr(10) || {_text(CODE[6])} || body from b union all select k, 'class Part_' || k || {_text(CODE[5])} || body || chr(10) || {_text(CODE[6])} || body from b")
def code_entities_plain(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.code_entities(_code(spark, sf), "p_partkey", with_imports=False).select("p_partkey", "content")


@query("select 'code_text' as type, string_agg(n_nationkey || ' ' || n_name, chr(10) order by n_nationkey) || chr(10) as content, '.txt' as file_type from nation")
def file_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A text file below a folder, found and cut."""
    path = fresh_path(spark, "tree")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(x["n_nationkey"].cast("string"), F.lit(" "), x["n_name"]))
    table(spark, sf, "nation").agg(F.array_join(lines, "\n").alias("value")).write.text(path)
    return chunking.file_chunks(files.code_files(spark, path)).select("type", "content", F.col("metadata")["file_type"].alias("file_type"))


def lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query("with t as (select doc_id, case when length(text) > 8000 then substr(text, 1, 8000) || chr(10) || '... [truncated]' else coalesce(text, '') end as t from documents) select doc_id, length(t)::double as a, (length(t) - length(replace(t, ' ', '')))::double as b from t")
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Texts to vectors in batches, by a stand-in for a model; longer texts are cut as the model's input is."""
    made = files.embedded(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), lengths, "array<double>")
    return made.select("doc_id", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


@query("select count(*) as n, sum(vec_id)::bigint as ids from embeddings")
def save_artefact(spark: SparkSession, sf: str) -> DataFrame:
    """An artefact is replaced whole, and read back."""
    path = fresh_path(spark, "artefact")
    vectors = table(spark, sf, "embeddings").select("vec_id")
    for rows in (vectors.limit(0), vectors):
        files.save(rows, path)
    return files.load_or_empty(spark, path, vectors.schema).agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@query(ORACLES["asof_fundamentals"])
def asof_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """The as-of join for keys of very many rows: windows by key and day."""
    events = table(spark, sf, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), "value", "event_id")
    return temporal.asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value"), clicks, ["user_id"], "ts", "at", {"value": "last_click", "at": "clicked_at"}, ["event_id"], "day")


@query("select user_id, ts, (select max(c.ts) from events c where c.event_type = 'click' and c.user_id = e.user_id and c.ts <= e.ts) as clicked_at from (select case when event_id % 3 = 0 then null else user_id end as user_id, ts from events where event_type = 'purchase') e")
def asof_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    left = events.where("event_type = 'purchase'").select(F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id"), "ts")
    return temporal.asof_join(left, events.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), "event_id"), ["user_id"], "ts", "at", {"at": "clicked_at"}, ["event_id"])

