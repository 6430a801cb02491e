"""Queries over the tables' own shape: keys, inclusions, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import checks, discovery, selection
from tallyweave.plans.registry import query, rounded
from tallyweave.plans import views
from tallyweave.plans.views import ctes, table
from tallyweave.sources import files, manifest
from tallyweave.sources.tables import Store
from tallyweave.staging import fresh_path

NAMES = ["region", "nation", "supplier", "customer", "part", "orders"]
#: Their whole-number columns, for the SQL alone.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "supplier": ["s_suppkey", "s_nationkey"], "customer": ["c_custkey", "c_nationkey"], "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}


def _tables(spark: SparkSession, sf: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: table(spark, sf, n) for n in names}


@query(
    "with v as ("
    + " union all ".join(f"select distinct '{t}.{c}' as name, {c}::bigint as value from {t} where {c} is not null" for t, cs in KEYS.items() for c in cs)
    + """), sizes as (select name, count(*) as n from v group by name),
both_ as (select a.name as "column", b.name as held_by, count(*) as shared from v a join v b using (value) where a.name <> b.name group by all)
select "column", held_by, n as "values" from both_ join sizes on name = "column" where shared = n"""
)
def inclusion_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of whole numbers all of whose values another column has."""
    return discovery.inclusions(discovery.column_sets({t: df.select(*KEYS[t]) for t, df in _tables(spark, sf, list(KEYS)).items()}))


@query(
    "select * from ("
    + " union all ".join(
        f"select '{t}' as table_name, {k}::bigint as ordinal, '{c}' as column_name, '{kind}' as data_type, count(*) as \"rows\", count(*) - count({c}) as nulls, count(distinct {c}) as distinct_values from {t}"
        for t, cs in {"nation": [("n_nationkey", "bigint"), ("n_name", "string"), ("n_regionkey", "bigint")], "region": [("r_regionkey", "bigint"), ("r_name", "string")]}.items()
        for k, (c, kind) in enumerate(cs)
    )
    + ")"
)
def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of two tables, with what their rows say of them."""
    tables = {"nation": table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long")), "region": table(spark, sf, "region").select(F.col("r_regionkey").cast("long"), "r_name")}
    return discovery.profiles(tables).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(
    """with keyed as (select (select count(distinct n_nationkey) = count(*) from nation) as pk, (select count(*) = 0 from nation where n_regionkey not in (select r_regionkey from region)) as fk, (select count(distinct r_regionkey) = count(*) from region) as rk)
select 'nation' as source, 'sql_schema' as type, 'Table: nation' || chr(10) || '  - n_nationkey: bigint' || case when pk then ' [PK]' else '' end || chr(10) || '  - n_name: string' || chr(10) || '  - n_regionkey: bigint' || case when fk and rk then ' [FK]' else '' end as content from keyed
union all select 'region', 'sql_schema', 'Table: region' || chr(10) || '  - r_regionkey: bigint' || case when rk then ' [PK]' else '' end || chr(10) || '  - r_name: string' from keyed"""
)
def schema_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of two tables, whose keys are found from the rows."""
    tables = {"nation": table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long")), "region": table(spark, sf, "region").select(F.col("r_regionkey").cast("long"), "r_name")}
    profile, primary, foreign = discovery.keys_of(tables)
    return files.schema_chunks(profile.withColumn("nullable", F.lit(True)), primary, foreign)


@query(
    "with v as ("
    + " union all ".join(f"select '{t}' as table_name, '{c[0]}' as primary_key, (select count(*) = count(distinct {c[0]}) from {t}) as ok" for t, c in KEYS.items() if t != "lineitem")
    + ") select table_name, primary_key from v where ok"
)
def discovered_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The first unique column of each table, over all of its columns."""
    _, primary, _ = discovery.keys_of(_tables(spark, sf, NAMES))
    return spark.createDataFrame([(t, ",".join(c)) for t, c in primary.items()], "table_name string, primary_key string")


@query("select l_returnflag, q, count(*) as n, round(case q when 0.0 then min(l_extendedprice) when 0.05 then quantile_cont(l_extendedprice, 0.05) when 0.5 then quantile_cont(l_extendedprice, 0.5) else quantile_cont(l_extendedprice, 0.999) end, 4) as value from lineitem, (values (0.0::double), (0.05::double), (0.5::double), (0.999::double)) x(q) group by l_returnflag, q")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Interpolated quantiles of prices by flag, by rounds of histograms of 64 cells."""
    found = selection.exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.05, 0.5, 0.999], cells=64, few=100)
    return rounded(found, "value", digits=4)


@query(
    """with before_ as (select source || '/' || doc_id as path, sha256(coalesce(text, '')) as hash from documents where doc_id % 10 <> 0),
after_ as (select case when doc_id % 10 = 3 then 'moved/' else '' end || source || '/' || doc_id as path, sha256(coalesce(text, '') || case when doc_id % 10 = 2 then '.' else '' end) as hash from documents where doc_id % 10 <> 1),
gone as (select *, row_number() over (partition by hash order by path) as nth from before_ b anti join after_ a using (path)),
come as (select *, row_number() over (partition by hash order by path) as nth from after_ a anti join before_ b using (path))
select b.path, 'changed' as change, cast(null as varchar) as old_path from before_ b join after_ a on a.path = b.path and a.hash <> b.hash
union all select coalesce(c.path, g.path), case when g.path is null then 'added' when c.path is null then 'removed' else 'renamed' end, case when g.path is not null and c.path is not null then g.path end
from gone g full join come c on g.hash = c.hash and g.nth = c.nth"""
)
def manifest_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What two manifests of the documents differ in, with renames."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    before = docs.where("doc_id % 10 <> 0").select("path", F.sha2("text", 256).alias("hash"))
    path = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    text = F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return manifest.changes(before, docs.where("doc_id % 10 <> 1").select(path.alias("path"), F.sha2(text, 256).alias("hash")))


@query(
    ctes("portfolio", "market", "market_data")
    + "select count(*) as stored, count(*) as \"rows\", count(*) filter (where close is null) as null_close, count(*) filter (where close <= 0) as not_positive, count(*) filter (where volume = 0) as zero_volume, min(as_of_date) as first_date, max(as_of_date) as last_date from market_data"
)
def checks_in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """Market data measured while it is written, and loaded into a store as its rules hold."""
    store, rows = Store(spark, fresh_path(spark, "store")), views.market_data(spark, sf)
    rules = {"some rows": lambda m: m["rows"] > 0, "prices": lambda m: m["null_close"] + m["not_positive"] == 0}
    found = checks.checked(rows, checks.market_metrics(), rules, lambda made: store.append("market_data", made))
    return store.table("market_data").agg(F.count("*").alias("stored")).select("stored", *[F.lit(v).alias(k) for k, v in found.items()])
