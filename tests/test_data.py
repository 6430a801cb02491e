"""Membership, upserts, quality, sources and retrieval on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import scalar
from tallyweave.operators import chunking, membership, quality, retrieval, search, temporal, upsert
from tallyweave.sources import files, vendor
from tallyweave.sources.tables import Store, with_retries
from tallyweave.streaming import upserts

T = [dt.datetime(2024, 1, k) for k in range(1, 10)]
D = [t.date() for t in T]


def fold(spark, seeds, events):
    s = spark.createDataFrame([(r, "seed") for r in seeds], "ric string, exchange_ticker string")
    e = spark.createDataFrame([(r, f"t{k}", day, k, c) for k, (r, day, c) in enumerate(events)], "ric string, exchange_ticker string, date timestamp, seq long, change string")
    return sorted(((r["ric"], r["exchange_ticker"], r["start_date"], r["end_date"]) for r in membership.membership_intervals(s, e, T[0]).collect()), key=repr)


def test_fold_moves_an_untouched_seed_and_adds_orphans(spark):
    assert fold(spark, ["A"], [("A", T[2], "Joiner")]) == [("A", "t0", T[2], None)]
    assert fold(spark, [], [("B", T[3], "Leaver")]) == [("B", "t0", T[0], T[3])]
    assert fold(spark, ["A"], []) == [("A", "seed", T[0], None)]


def plain_fold(seeds, events, start):
    state = [[r, "seed", start, None] for r in seeds]
    for k, (ric, day, change) in sorted(enumerate(events), key=lambda x: (x[1][1], x[0])):
        mine = [x for x in state if x[0] == ric and x[3] is None]
        if change == "Joiner":
            hit = [x for x in mine if x[2] == start]
            if hit:
                hit[0][1:3] = [f"t{k}", day]
            else:
                state.append([ric, f"t{k}", day, None])
        else:
            hit = [x for x in mine if x[2] <= day]
            if hit:
                max(enumerate(hit), key=lambda x: (x[1][2], x[0]))[1][3] = day
            else:
                state.append([ric, f"t{k}", start, day])
    return sorted(map(tuple, state), key=repr)


def test_fold_against_plain_python(spark):
    import random

    rng = random.Random(5)
    for _ in range(4):
        seeds = [r for r in "ABCD" if rng.random() < 0.5]
        events = [(rng.choice("ABCDE"), rng.choice(T), rng.choice(["Joiner", "Leaver"])) for _ in range(25)]
        assert fold(spark, seeds, events) == plain_fold(seeds, events, T[0])


def test_float_adjusted_shares(spark):
    members = spark.createDataFrame([("X", "x", 1)], "ric string, exchange_ticker string, security_id long")
    shares = spark.createDataFrame([("X", D[0], 100.0), ("X", D[2], 200.0), ("X", D[3], 250.0), ("X", D[5], 300.0)], "instrument string, date date, outstanding_shares double")
    free = spark.createDataFrame([("X", D[1], 1, 40.0), ("X", D[1], 2, 50.5), ("X", D[3], 1, 120.0)], "instrument string, date date, seq int, free_float_pct double")
    out = {r["effective_date"]: r["metric_value"] for r in membership.float_adjusted_shares(members, shares, free).collect()}
    assert out == {D[0]: None, D[2]: 100.0, D[3]: 250.0, D[5]: 300.0}
    assert membership.enriched(spark.createDataFrame([("X", "x", T[0], None)], "ric string, exchange_ticker string, start_date timestamp, end_date timestamp"), spark.createDataFrame([(5, "x")], "security_id long, symbol string"), T[1]).first()["security_id"] == 5


def test_forward_fill_stays_in_its_key(spark):
    df = spark.createDataFrame([("a", D[0], 1.0), ("a", D[3], None), ("a", D[4], 2.0), ("b", D[1], None)], "k string, d date, v double")
    out = {(r["k"], r["d"]): r["v"] for r in temporal.daily_forward_fill(df, "k", "d", "v").collect()}
    assert out == {("a", D[0]): 1.0, ("a", D[1]): 1.0, ("a", D[2]): 1.0, ("a", D[3]): 1.0, ("a", D[4]): 2.0, ("b", D[1]): None}


FACTS = "security_id long, metric_type string, metric_value double, source_vendor string, effective_date date, end_date date"


def test_versioned_upsert_has_three_branches(spark):
    old = spark.createDataFrame([(1, "m", 1.0, "v", D[0], None), (2, "m", 2.0, "v", D[0], None)], FACTS)
    batch = lambda *rows: spark.createDataFrame(rows, FACTS)
    rows = lambda df: sorted(((r["security_id"], r["metric_value"], r["effective_date"], r["end_date"]) for r in df.collect()), key=repr)
    new = upsert.upsert_fundamentals(old, batch((1, "m", 9.0, "v", D[1], D[2])), D[5])
    assert rows(new) == [(1, 1.0, D[0], None), (1, 9.0, D[1], None), (2, 2.0, D[0], None)]
    same = upsert.upsert_fundamentals(old, batch((1, "m", 9.0, "v", D[0], D[2])), D[5])
    assert rows(same) == [(1, 9.0, D[0], D[2]), (2, 2.0, D[0], None)]
    other = upsert.upsert_fundamentals(old, batch((1, "m", 9.0, "v", D[0], D[2]), (1, "n", 8.0, "v", D[0], None)), D[5])
    assert rows(other) == [(1, 1.0, D[0], D[5]), (1, 8.0, D[0], None), (1, 9.0, D[0], None), (2, 2.0, D[0], None)]
    assert upsert.upsert_fundamentals(old, old.limit(0), D[5]).count() == 2


def test_replacing_upserts(spark):
    old = spark.createDataFrame([(D[0], 1, 1.0), (D[0], 2, 2.0)], "as_of_date date, security_id long, close double")
    new = spark.createDataFrame([(D[0], 1, 9.0)], "as_of_date date, security_id long, close double")
    assert sorted(r["close"] for r in upsert.upsert_market_data(old, new).collect()) == [2.0, 9.0]
    assert [r["close"] for r in upsert.upsert_market_data(old, new, strict=True).collect()] == [9.0]
    held = spark.createDataFrame([(D[0], 1, 5.0, None, None), (D[1], 1, 6.0, None, None)], "as_of_date date, port_id long, held_shares double, upsert_date timestamp, upsert_by string")
    two = spark.createDataFrame([(D[0], 1, 7.0), (D[1], 1, 8.0)], "as_of_date date, port_id long, held_shares double").coalesce(1)
    assert sorted(r["held_shares"] for r in upsert.upsert_holdings(held, two, T[0], "x").collect()) == [7.0, 8.0]
    assert sorted(r["held_shares"] for r in upsert.upsert_holdings(held, two, T[0], "x", strict=True).collect()) == [6.0, 7.0, 8.0]
    assert upsert.upsert_holdings(held, two.limit(0), T[0], "x", strict=True).count() == 2
    index = spark.createDataFrame([(1, "a"), (2, "b")], "index_id long, t string")
    assert sorted(r["t"] for r in upsert.upsert_index_constituents(index, spark.createDataFrame([(1, "c")], "index_id long, t string")).collect()) == ["b", "c"]


def test_missing_securities_get_ids_and_defaults(spark):
    master = spark.createDataFrame([(4, "A", 0)], "security_id long, symbol string, is_active int")
    rows = [("A", "STK", "NYSE", "USD"), ("B", "STK", "NYSE", "USD"), ("B", "STK", "NYSE", "USD"), ("C", None, "X", None)]
    p = spark.createDataFrame(rows, "symbol string, ib_security_type string, ib_exchange string, ib_currency string")
    out = {r["symbol"]: r for r in upsert.insert_missing(master, p, T[0]).collect()}
    assert [out[k]["security_id"] for k in "ABC"] == [4, 5, 6]
    assert (out["B"]["security_type"], out["B"]["asset_class"], out["B"]["exchange"]) == ("Common Stock", "Equity", "XNYS")
    assert (out["C"]["security_type"], out["C"]["asset_class"], out["C"]["exchange"]) == ("Common Stock", "Other", "XNAS")
    assert upsert.activated(master, spark.createDataFrame([("A",)], "symbol string")).first()["is_active"] == 1
    assert upsert.with_new_ids(master, master.limit(0), "security_id", ["symbol"]).count() == 0


def test_new_ids_have_no_gap_over_many_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.minPartitionSize", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        master = spark.createDataFrame([(41, "A")], "security_id long, symbol string")
        batch = spark.range(0, 200_000, 1, 24).select(F.format_string("S%07d", (F.col("id") * 7919) % 200_000).alias("symbol"))
        out = upsert.with_new_ids(master, batch, "security_id", ["symbol"])
        n, low, high, different, nulls = out.agg(F.count("*"), F.min("security_id"), F.max("security_id"), F.count_distinct("security_id"), F.count_if(F.col("security_id").isNull())).first()
        assert (n, low, high, different, nulls) == (200_000, 42, 200_041, 200_000, 0)
        assert out.where(F.col("security_id") != F.substring("symbol", 2, 7).cast("long") + 42).isEmpty()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    both, new = upsert.inserted_from(master, spark.createDataFrame([("B",)], "symbol string"), "security_id", ["symbol"], T[0], "x")
    assert new.first()["security_id"] == 42 and both.count() == 2 and {"upsert_by", "upsert_date"} <= set(both.columns)
    assert upsert.stamped(master).first()["upsert_by"]


def test_null_keys_are_replaced(spark):
    old = spark.createDataFrame([(D[0], 1, None, 1.0), (D[0], 1, "1d", 2.0)], "as_of_date date, security_id long, interval string, close double")
    new = spark.createDataFrame([(D[0], 1, None, 9.0)], old.schema)
    assert sorted(r["close"] for r in upsert.upsert_market_data(old, new).collect()) == [2.0, 9.0]


def test_position_quality(spark):
    good = spark.createDataFrame([(D[0], "P", " ab ", "STK", "NYSE", "USD", "1.5", "x")], "as_of_date date, portfolio_short_name string, symbol string, ib_security_type string, ib_exchange string, ib_currency string, held_shares string, avg_cost string")
    ok, issues = quality.position_issues(good)
    assert not ok and issues == ["'held_shares' column is not numeric", "'avg_cost' column is not numeric"]
    clean = quality.clean_positions(good)
    r = clean.first()
    assert (r["symbol"], r["held_shares"], r["avg_cost"]) == ("AB", 1.5, None)
    assert quality.position_issues(clean) == (True, [])
    zero = clean.withColumn("held_shares", F.lit(0.0)).withColumn("symbol", F.lit(None).cast("string"))
    assert quality.position_issues(zero) == (False, ["Found 1 null values in critical column 'symbol'", "Found 1 positions with zero shares"])
    assert quality.position_issues(clean.limit(0)) == (False, ["DataFrame is empty"])
    with pytest.raises(KeyError):
        quality.position_issues(clean.drop("held_shares"))


def test_reports(spark):
    a = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    b = spark.createDataFrame([("x",)], "k string")
    assert [r["k"] for r in quality.missing_report(a, b, "k").collect()] == ["y"]
    assert quality.completion_rate(a.dropna(), b, "k").first()["percent"] == 50.0
    assert quality.completion_rate(a.limit(0), b, "k").first()["percent"] == 0.0


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.half_even(F.lit(0.5)).alias("a"), scalar.half_even(F.lit(1.5)).alias("b"), scalar.half_even(F.lit(2.5)).alias("c"), scalar.last_weekday(F.lit(dt.date(2024, 1, 7))).alias("d"), scalar.last_weekday(F.lit(dt.date(2024, 1, 8))).alias("e"),
        scalar.truncated(F.lit("abcdef"), 3).alias("f"), scalar.snake_case_column(F.lit("marketCap")).alias("g"), scalar.clipped(F.lit(None).cast("double"), 0, 1).alias("i"),
    ).first()
    assert tuple(row) == (0, 2, 2, dt.date(2024, 1, 5), dt.date(2024, 1, 8), "abc...", "market_cap", None)
    assert [scalar.snake_case(x) for x in ("sharesOutstanding", "marketCap", "Shares Outstanding")] == ["shares_outstanding", "market_cap", "shares _outstanding"]
    assert scalar.date_range("latest_eod", dt.date(2024, 1, 7)) == (dt.date(2024, 1, 5), dt.date(2024, 1, 6))
    assert scalar.date_range("ytd", dt.date(2024, 1, 7))[0] == dt.date(2024, 1, 1)
    assert scalar.date_range("historical", dt.date(2024, 1, 9)) == (dt.date(2024, 1, 9),) * 2
    with pytest.raises(ValueError):
        scalar.parsed_date("01/02/2024")


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    facts = spark.createDataFrame([(1, "marketCap", 5.0, "v", D[0], None), (1, "other", 6.0, "v", D[0], None)], FACTS)
    store.append("security_fundamentals", facts)
    assert store.security_fundamentals("marketCap").select("market_cap").first()[0] == 5.0
    assert store.security_fundamentals().count() == 2
    prices = spark.createDataFrame([(D[k], 1, float(k)) for k in range(4)], "as_of_date date, security_id long, close double")
    store.append("market_data", prices)
    assert store.market_data("2024-01-02", "2024-01-03").count() == 2
    plan = store.market_data("2024-01-02", "2024-01-03").select("close")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(as_of_date), GreaterThanOrEqual(as_of_date" in plan and "ReadSchema: struct<as_of_date:date,close:double>" in plan
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 2:
            raise ConnectionError
        return 7

    assert with_retries(flaky, wait_minutes=0) == 7
    with pytest.raises(ConnectionError):
        with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), wait_minutes=0)


def test_vendor_formats(spark):
    raw = spark.createDataFrame([("R", T[0], 1.00005, 2.0, 0.5, 1.5, 1.4, 10)], "a string, b timestamp, c double, d double, e double, f double, g double, h long").toDF("Instrument", "Date", "Open Price", "High Price", "Low Price", "Close Price", "Close Price", "Accumulated Volume")
    symbols = spark.createDataFrame([("S", 3)], "symbol string, security_id long")
    rics = vendor.resolved(symbols, spark.createDataFrame([("S", "R.old")], "symbol string, ric string"), {".old": "R"})
    r = vendor.refinitive_prices(raw, rics, T[1]).first()
    assert (r["security_id"], r["close"], r["adj_close"], r["volume"], r["open"]) == (3, 1.5, 1.4, 10, 1.0)
    assert vendor.frequency("5d") == "D" and vendor.frequency("1wk") == "W" and vendor.frequency("?") == "D"
    yahoo = spark.createDataFrame([("S", T[0], 1.23456, 5)], "symbol string, Date timestamp, Close double, Volume long")
    assert vendor.yahoo_prices(yahoo, symbols, T[1]).first()["close"] == 1.2346
    with pytest.raises(ValueError):
        vendor.check_request(symbols, D[1], D[1])
    body = '[{"metric": "m", "value": 2.5, "endDate": "2024-01-05"}]'
    facts = vendor.fundamentals_from_json(spark.createDataFrame([(1, body), (2, "no json")], "security_id long, body string")).collect()
    assert [(f["security_id"], f["metric_value"], f["effective_date"]) for f in facts] == [(1, 2.5, D[4])]
    account = spark.createDataFrame([("P", "A", "STK", "NYSE", "USD", 1.0, 2.0)], "portfolio_short_name string, symbol string, ib_security_type string, ib_exchange string, ib_currency string, held_shares double, avg_cost double")
    assert vendor.positions([account, account], D[0]).count() == 2
    changes = vendor.constituent_changes(spark.createDataFrame([("r", T[0], "Joiner")], "ric string, date timestamp, change string"), spark.createDataFrame([("r", "t")], "ric string, exchange_ticker string"))
    assert changes.first()["exchange_ticker"] == "t"
    assert vendor.constituents_as_of(spark.createDataFrame([("r", "t")], "ric string, exchange_ticker string"), D[0]).first()["end_date"] is None


def test_price_source(spark):
    def fetch(symbol, start, end):
        if symbol == "BAD":
            raise OSError
        yield D[0], 1.0, 2.0, 0.5, 1.5, 1.4, 10, 0.0, 0.0

    spark.dataSource.register(vendor.eod_source("test_eod", fetch))
    rows = spark.read.format("test_eod").options(symbols="A:1,BAD:2,C:3", start="2024-01-01", end="2024-01-02").load().collect()
    assert sorted((r["security_id"], r["close"], r["error"]) for r in rows) == [(1, 1.5, None), (2, None, "OSError()"), (3, 1.5, None)]
    symbols = spark.createDataFrame([("A", 1), ("BAD", 2), ("C", 3), (None, 4)], "symbol string, security_id long")
    prices, failed = vendor.load_prices("test_eod", symbols, D[0], D[1], batch=2)
    assert prices.columns == vendor.EOD.names and prices.count() == 2 and [tuple(r) for r in failed.collect()] == [("BAD", "OSError()")]


def test_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("import os\n\n" + "def f(x):\n" + "    y = x + 1\n" * 20 + "\nclass A:\n    def g(self):\n" + "        return 1\n" * 20)
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "b.py").write_text("x = 1\n" * 100)
    (tmp_path / "short.py").write_text("x = 1")
    code = files.code_files(spark, str(tmp_path))
    assert code.count() == 1
    chunks = chunking.file_chunks(code).collect()
    assert {c["type"] for c in chunks} == {"code_semantic", "code_text"}
    assert {c["metadata"].get("entity_name") for c in chunks} == {"f", "g", "A", None}
    assert all(c["content"].startswith("import os\n\n") for c in chunks if c["type"] == "code_semantic")
    (tmp_path / "x.csv").write_text("a,b\n1,q\n")
    assert files.csv(spark, str(tmp_path / "x.csv"), "a int, b string").first()["a"] == 1
    (tmp_path / "x.json").write_text('[{"a": 1, "b": 2}, {"a": 3}]')
    assert sorted(r["a"] for r in files.json_rows(spark, str(tmp_path / "x.json"), "a int, b int", ["a"]).collect()) == [1, 3]
    spark.range(3).createOrReplaceTempView("three")
    columns = files.columns_of(spark)
    text = files.schema_chunks(columns.where("table_name = 'three'"), {"three": ["id"]}).first()["content"]
    assert text == "Table: three\n  - id: bigint NOT NULL [PK]" or text == "Table: three\n  - id: bigint [PK]"
    assert files.sample_chunk(spark.createDataFrame([("x" * 60,)], "a string"), "t").first()["content"] == "a\n" + "x" * 50 + "..."
    assert files.load_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0

    def encode(texts):
        return [[float(len(t))] for t in texts]

    assert files.embedded(spark.createDataFrame([("abc",), (None,)], "content string"), encode).select("embedding").collect()[0][0] == [3.0]


def test_chunks():
    assert chunking.chunk("short") == ["short"]
    text = "\n".join(f"line {k:03d} " + "x" * 40 for k in range(100))
    out = chunking.chunk(text)
    assert all(len(c) <= 1000 for c in out) and out[0].split("\n")[0] == text.split("\n")[0]
    for a, b in zip(out, out[1:]):
        shared = b.split("\n")[: len(b.split("\n"))]
        assert a.split("\n")[-1] in shared and sum(len(x) + 1 for x in shared[: shared.index(a.split("\n")[-1]) + 1]) <= 200
    assert len(chunking.chunk(text, boundary_aware=True)) == 1
    marked = text.split("\n")
    marked[30] = "def f():"
    assert len(chunking.chunk("\n".join(marked), boundary_aware=True)) == 2
    assert chunking.chunk("y" * 2000) == ["y" * 2000]


def test_context_takes_what_is_reachable(spark):
    import random

    rng = random.Random(4)

    def plain(rows):
        parts, used = [], 0
        for n, size in enumerate(rows, 1):
            head, body = f"[Source {n}: s (t)]", "x" * size
            room = 8000 - used - len(head) - 100
            if used + len(head) + size + 50 > 8000:
                if room <= 100:
                    break
                body = body[:room] + "\n... [truncated]"
            parts.append(f"{head}\n{body}\n")
            used += len(parts[-1])
        return "\n" + "=" * 60 + "\n" + "\n".join(parts)

    groups = {g: [rng.choice([0, 1, 3, 40, 200, 7800, 7900, 20_000]) if g % 2 else rng.randint(0, 30) for _ in range(rng.choice([1, 3, 30, 600]))] for g in range(60)}
    rows = [(g, k, "s", "t", "x" * size, {}) for g, sizes in groups.items() for k, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, "g int, k int, source string, type string, content string, metadata map<string,string>")
    assert {r["g"]: r["context"] for r in retrieval.packed_context(df, ["g"], "k").collect()} == {g: plain(sizes) for g, sizes in groups.items()}


def test_retrieval(spark):
    chunks = [("g", k, "s", "t", "x" * n, {"entity_type": "function"} if k == 1 else {}) for k, n in ((1, 3000), (2, 4000), (3, 3000), (4, 5))]
    df = spark.createDataFrame(chunks, "g string, k int, source string, type string, content string, metadata map<string,string>")
    context = retrieval.packed_context(df, ["g"], "k").first()["context"]
    assert context.startswith("\n" + "=" * 60 + "\n[Source 1: s (t) | Entity: function]\nxxx") and "... [truncated]" in context and "Source 4" in context and len(context) < 8100
    talk = spark.createDataFrame([("c", k, f"q{k}", "a" * 300) for k in range(5)], "g string, k int, query string, response string")
    lines = retrieval.conversation_context(talk, "g", "k").first()["context"].split("\n")
    assert lines[0] == "Previous Q: q2" and lines[1] == "Previous A: " + "a" * 200 + "..." and len(lines) == 6


def test_search(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    points = np.concatenate([rng.normal(size=(40, 8))[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 8)) / 4, np.ones((300, 8))])
    v = spark.createDataFrame([(k, [float(x) for x in p]) for k, p in enumerate(points)] + [(9000, None), (9001, [1.0])], "vec_id long, embedding array<double>").repartition(5)
    asked = v.where("vec_id % 50 = 0")

    def plain(k):
        out = {}
        for q in range(0, len(points), 50):
            d = ((points - points[q]) ** 2).sum(1)
            out[q] = np.lexsort((np.arange(len(d)), d))[:k].tolist()
        return out

    def answers(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["nth"])):
            out.setdefault(r["query_id"], []).append(r["id"])
        return out

    for group in (10_000, 100):
        assert answers(search.exact_neighbours(v, asked, 7, group=group)) == plain(7)
    index = search.Index.fit(v.where("vec_id < 9000"), 40, 2)
    for group in (10_000, 64):
        found, true = answers(index.neighbours(v, asked, 7, group=group)), plain(7)
        assert found.keys() == true.keys() and np.mean([len(set(found[q]) & set(true[q])) / 7 for q in true]) >= 0.9
    assert search.exact_neighbours(v.limit(0), asked.limit(0)).count() == 0 and search.exact_neighbours(v, asked.limit(0)).count() == 0
    assert search.neighbours(v, asked, 3).count() == 3 * len(true)
    assert search.index_kind(500)["kind"] == "flat" and search.index_kind(5000)["nlist"] == 70 and search.index_kind(40_000)["nprobe"] == 50


def test_artefacts(spark, tmp_path):
    path = str(tmp_path / "artefact")
    for n in (3, 5):
        files.save(spark.range(n), path)
        assert files.load_or_empty(spark, path, "id long").count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["artefact"]
    assert files.read_entries('[{"a": 1}, 2]') == [{"a": 1}] == files.read_entries('{"chunks": [{"a": 1}], "at": 3}') and files.read_entries("{") == [] == files.read_entries("{}")

    def failing(texts):
        raise RuntimeError("down")

    bad = files.embedded(spark.createDataFrame([("abc",), (None,)], "content string"), failing).collect()
    assert [(r["embedding"], r["embedding_error"]) for r in bad] == [(None, "RuntimeError('down')")] * 2


def test_excel(spark, tmp_path, monkeypatch):
    import xml.etree.ElementTree as xml
    import zipfile

    df = spark.createDataFrame([("a <b> & é", 1, 2.5, D[0], None), (None, -3, float("nan"), None, True)], "a string, b long, c double, d date, e boolean")
    path = str(tmp_path / "x.xlsx")
    assert files.to_excel(df, path) == 2
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            xml.fromstring(z.read(name))
        rows = [["".join(c.itertext()) for c in row] for row in xml.fromstring(z.read("xl/sheet1.xml"))[0]]
    assert rows == [["a", "b", "c", "d", "e"], ["a <b> & é", "1", "2.5", "2024-01-01", ""], ["", "-3", "nan", "", "True"]]
    monkeypatch.setattr(files, "SHEET_ROWS", 1)
    with pytest.raises(ValueError):
        files.to_excel(df, path)


def test_tables_over_jdbc(spark):
    """An embedded database stands in for the server; retries are for errors of the connection only."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    url = "jdbc:derby:memory:tallyweave;create=true"
    rows = spark.createDataFrame([(1, "P", "Port", "Portfolio")], "port_id long, portfolio_short_name string, portfolio_name string, portfolio_type string")
    options = {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows.write.format("jdbc").options(**options).option("dbtable", "dbo.portfolio").option("createTableColumnTypes", "portfolio_short_name varchar(40), portfolio_name varchar(40), portfolio_type varchar(40)").save()
    store = Store(spark, jdbc=options)
    assert store.portfolio(["P", "Q"]).first()["portfolio_name"] == "Port"


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tallyweave import staging

    class Conf(dict):
        pass

    fake = lambda master: SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(getConf=Conf, master=master))
    assert staging.shared_folder(fake("local[4]")).startswith("file:///")
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://h:7077"):
        with pytest.raises(ValueError):
            staging.shared_folder(fake(master))


def test_stream_upserts(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "security_id long, close double, as_of_date date"
    spark.createDataFrame([(1, 1.0, D[0]), (2, 2.0, D[0])], schema).write.parquet(source)

    def run():
        upserts.stream_upserts(spark.readStream.schema(schema).parquet(source), out, ["as_of_date", "security_id"], "as_of_date", str(tmp_path / "check")).awaitTermination()

    run()
    spark.createDataFrame([(1, 9.0, D[0]), (3, 3.0, D[1])], schema).write.mode("append").parquet(source)
    run()
    assert sorted((r["security_id"], r["close"]) for r in spark.read.schema(schema).parquet(out).collect()) == [(1, 9.0), (2, 2.0), (3, 3.0)]


def test_a_repeated_batch_writes_the_same(spark, tmp_path):
    schema, out = "security_id long, close double, as_of_date date", str(tmp_path / "out")
    batch = spark.createDataFrame([(1, 5.0, D[0]), (1, 7.0, D[0]), (4, 1.0, None), (1, 6.0, D[0])], schema).repartition(3)
    for _ in range(2):
        upserts.upsert_partitions(batch, out, ["as_of_date", "security_id"], "as_of_date")
        assert sorted((r["security_id"], r["close"], r["as_of_date"]) for r in spark.read.schema(schema).parquet(out).collect()) == [(1, 7.0, D[0]), (4, 1.0, None)]
    upserts.upsert_partitions(spark.createDataFrame([(5, 2.0, None)], schema), out, ["as_of_date", "security_id"], "as_of_date")
    assert spark.read.schema(schema).parquet(out).count() == 3
