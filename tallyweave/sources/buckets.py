"""A store whose tables are bucketed alike, so that they are joined where they lie: loads shuffle once, reads never.

All tables have the same buckets, by security and month. A security that holds a large share of the rows is thus as many
buckets as it has months. Rows that belong to a security alone are stored once for each month in which it is held: its
master row, and the fundamentals known when the month began, beside those that came within it, each with the date of its
successor. So an as-of join needs no row of another bucket and no window: it is a merge join by security and month that
tests at most 32 rows, as of fundamentals of one date the last alone is kept.

Defined results: rows without a security or a date join nothing and are left out; a batch that is loaded twice is there
twice, as in any table; no holdings give an empty result; columns other than the keys are carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions.scalar import parsed_date
from tallyweave.operators.portfolio import fundamental_names, portfolio_market_data
from tallyweave.operators.temporal import asof_join
from tallyweave.staging import written

KEYS = ["security_id", "period"]


def month(date: Column) -> Column:
    return F.trunc(date.cast("date"), "month")


class Bucketed:
    """Holdings, prices, securities and fundamentals in `buckets` buckets of the session's catalog, as tables
    <name>_<holdings, …> below the folder `root`; without a name a new one.

    Reads go through a session of their own (newSession), as they need one setting: that rows bucketed by security and
    month also count as dealt by security, month and date."""

    def __init__(self, spark: SparkSession, root: str, name: str | None = None, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.name = name or f"bucketed_{uuid.uuid4().hex}"
        self.reader = spark.newSession()
        self.reader.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        for c in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            self.reader.conf.set(c, spark.conf.get(c))

    def _add(self, what: str, rows: DataFrame, order: list[str]) -> None:
        """One file for each bucket that the rows fill."""
        known = rows.where(F.col("security_id").isNotNull() & F.col("period").isNotNull())
        dealt = known.repartition(self.buckets, *KEYS).write.mode("append").format("parquet")
        dealt.bucketBy(self.buckets, *KEYS).sortBy("period", "security_id", *order).option("path", f"{self.root}/{what}").saveAsTable(f"{self.name}_{what}")

    def table(self, what: str) -> DataFrame:
        return self.reader.table(f"{self.name}_{what}")

    def load(self, holdings: DataFrame, market_data: DataFrame, securities: DataFrame, fundamentals: DataFrame) -> None:
        """Adds holdings and prices. securities and fundamentals are whole tables; of these, what the months of the new
        holdings need and the store does not have yet goes in. Fundamentals that are revised for months already loaded
        need a new store, and so does a load that failed halfway."""
        held = written(holdings.withColumn("period", month(F.col("as_of_date"))), "held")
        months = held.select(*KEYS).distinct()
        if self.spark.catalog.tableExists(f"{self.name}_holdings"):
            months = months.join(self.spark.table(f"{self.name}_securities").select(*KEYS), KEYS, "left_anti")
        months = written(months.where(F.col("security_id").isNotNull() & F.col("period").isNotNull()), "months")
        facts = fundamentals.where(F.col("effective_date").isNotNull())
        columns = [c for c in facts.columns if c != "security_id"]
        before = asof_join(months.withColumn("_before", F.date_sub("period", 1)), facts, ["security_id"], "_before", "effective_date", {c: c for c in columns}, [c for c in ("end_date",) if c in columns])
        within = facts.withColumn("period", month(F.col("effective_date"))).join(months, KEYS, "left_semi")
        self._add("holdings", held, ["as_of_date"])
        self._add("market_data", market_data.withColumn("period", month(F.col("as_of_date"))), ["as_of_date"])
        self._add("securities", months.join(securities, "security_id"), [])
        known = before.where("effective_date is not null").select(*KEYS, *columns).unionByName(within.select(*KEYS, *columns))
        ties = [c for c in ("end_date", *columns) if c in columns and c != "effective_date"]
        after = F.lead("effective_date").over(Window.partitionBy(*KEYS).orderBy("effective_date", *dict.fromkeys(ties)))
        self._add("fundamentals", known.withColumn("known_until", after).where("known_until is null or known_until > effective_date"), ["effective_date"])

    def portfolio_market_data(self, portfolio: DataFrame, start: str, end: str) -> DataFrame:
        """As the operator of this name, of both dates (YYYY-MM-DD) and those between. The tables of the store meet by merge
        joins of their buckets; only portfolio, where its size is known to be small, is sent anywhere."""
        first, last = F.lit(parsed_date(start)), F.lit(parsed_date(end))
        months = F.col("period").between(F.trunc(first, "month"), F.trunc(last, "month"))
        days = months & F.col("as_of_date").between(first, last)
        quoted = portfolio_market_data(portfolio, self.table("holdings").where(days), self.table("securities").where(months).hint("merge"), self.table("market_data").where(days).hint("merge"), by=KEYS)
        facts = self.table("fundamentals").where(months)
        added = fundamental_names(facts.drop("known_until"), quoted, KEYS)
        facts = facts.select(*KEYS, F.col("effective_date").alias("_from"), F.col("known_until").alias("_until"), *[F.col(c).alias(f"_{c}") for c in added])
        same = [quoted[c] == facts[c] for c in KEYS]
        open_ = (quoted["as_of_date"] >= facts["_from"]) & (facts["_until"].isNull() | (quoted["as_of_date"] < facts["_until"]))
        found = quoted.join(facts.hint("merge"), [*same, open_], "left")
        return found.select(*[quoted[c] for c in quoted.columns if c != "period"], *[facts[f"_{c}"].alias(n) for c, n in added.items()])

    def drop(self) -> None:
        """Takes the tables out of the catalog; their files stay."""
        for what in ("holdings", "market_data", "securities", "fundamentals"):
            self.spark.sql(f"drop table if exists {self.name}_{what}")
