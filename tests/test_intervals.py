"""Covariance tiles, merged versions, overlapping intervals and folds of any length, against plain Python."""

import datetime as dt
import random
import resource

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import covariance, fold, membership, overlap, risk, versions
from tallyweave.streaming.membership import stream_membership

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(400)]
T = [dt.datetime(2024, 1, 1) + dt.timedelta(days=k) for k in range(400)]


def test_covariance_equals_numpy(spark):
    rng = random.Random(1)
    rows = [(g, s, D[d], rng.gauss(5, 1) * (s + 1) if rng.random() < 0.97 else None) for g, n in (("p", 23), (None, 3), ("one", 1)) for s in range(n) for d in range(90) if rng.random() < (0.5 if s % 3 else 1.0)]
    rows += [("p", 99, D[300], 1.0), ("p", 98, D[300], 2.0), ("p", 97, D[301], float("nan"))]
    df = spark.createDataFrame(rows, "portfolio_short_name string, security_id long, as_of_date date, log_return double")
    found = {(r[0], r["i"], r["j"]): (r["n"], r["cov"]) for r in covariance.covariance_matrix(df, tile=5, span=17).collect()}
    series = {}
    for g, s, d, x in rows:
        if x is not None and x == x:
            series.setdefault((g, s), {})[d] = x
    want = {}
    for g, a in series:
        for h, b in series:
            days = sorted(set(series[g, a]) & set(series[h, b])) if g == h else []
            if days:
                x, y = ([series[g, s][d] for d in days] for s in (a, b))
                want[g, a, b] = (len(days), float(np.cov(x, y)[0, 1]) if len(days) > 1 else None)
    assert set(found) == set(want)
    for k, (n, cov) in want.items():
        assert found[k][0] == n and (found[k][1] is None if cov is None else found[k][1] == pytest.approx(cov, rel=1e-9, abs=1e-9))
    plain = {(r[0], r["i"], r["j"]): r["cov"] for r in risk.covariances(df.where("portfolio_short_name = 'p' and not isnan(log_return)")).collect()}
    assert all(found[k][1] is None or plain[k] == pytest.approx(found[k][1]) for k in plain)


def test_covariance_ships_rows_by_blocks(spark):
    df = spark.createDataFrame([("p", s, D[d], float(s * d)) for s in range(40) for d in range(20)], "portfolio_short_name string, security_id long, as_of_date date, log_return double")
    plan = covariance.covariance_matrix(df, tile=10)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert covariance.covariance_matrix(df.limit(0)).count() == 0


def plain_versions(rows):
    """The version that holds on each day of a key, then runs of days; rows (low, high, load, value)."""
    def holds(day):
        found = [r for r in rows if r[0] is not None and r[0] <= day and (r[1] is None or day < r[1])]
        return max(found, key=lambda r: (r[0], r[2], r[3])) if found else None

    out, before = [], None
    for day in [*D, dt.date(2030, 1, 1)]:
        now = holds(day)
        if now != before:
            if out and out[-1][2] is None and before is not None:
                out[-1][2] = day
            if now is not None:
                out.append([now[3], day, None])
        before = now
    return sorted((v, a, b) for v, a, b in out)


@pytest.mark.parametrize("seed", range(3))
def test_merged_versions_equal_days(spark, seed):
    rng, value = random.Random(seed), 0
    schema = "security_id long, source_vendor string, metric_value double, effective_date date, end_date date"
    keys = [(1, "a"), (1, "b"), (None, "a"), (2, None)]
    tables, by_key = ([], []), {k: [] for k in keys}
    for load in (0, 1):
        for _ in range(60):
            key, low = rng.choice(keys), rng.randrange(300)
            high = rng.choice([None, D[rng.randrange(300)], D[min(399, low + rng.randrange(1, 40))]])
            value += 1
            tables[load].append((*key, float(value), D[low], high))
            by_key[key].append((D[low], high, load, float(value)))
    tables[1].append((1, "a", -1.0, None, None))
    existing, load = (spark.createDataFrame(t, schema) for t in tables)
    found = {k: [] for k in keys}
    for r in versions.merged_versions(existing, load, ["security_id", "source_vendor"]).collect():
        found[r["security_id"], r["source_vendor"]].append((r["metric_value"], r["effective_date"], r["end_date"]))
    for k in keys:
        assert sorted(found[k], key=repr) == sorted(plain_versions(by_key[k]), key=repr)
        ordered = sorted(found[k], key=lambda x: x[1])
        assert all(a[2] is not None and a[2] <= b[1] for a, b in zip(ordered, ordered[1:]))
    again = versions.merged_versions(versions.merged_versions(existing, load, ["security_id", "source_vendor"]), load.limit(0), ["security_id", "source_vendor"])
    assert again.count() == sum(map(len, found.values()))


def test_late_closed_and_equal_starts(spark):
    schema = "k long, v string, effective_date date, end_date date"
    merged = lambda a, b: sorted((r["v"], r["effective_date"], r["end_date"]) for r in versions.merged_versions(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k"]).collect())
    assert merged([(1, "a", D[10], None)], [(1, "late", D[5], None)]) == [("a", D[10], None), ("late", D[5], D[10])]
    assert merged([(1, "a", D[10], None)], [(1, "b", D[20], D[30])]) == [("a", D[10], D[20]), ("a", D[30], None), ("b", D[20], D[30])]
    assert merged([(1, "a", D[10], None)], [(1, "b", D[10], None)]) == [("b", D[10], None)]
    assert merged([(1, "a", D[10], D[12])], [(1, "b", D[12], D[14])]) == [("a", D[10], D[12]), ("b", D[12], D[14])]


@pytest.mark.parametrize("seed, by, closed, hot, width", [(1, ["k"], True, 4096, None), (2, ["k"], False, 3, None), (3, [], True, 5, 7), (4, [], False, 4096, 1)])
def test_overlap_equals_all_pairs(spark, seed, by, closed, hot, width):
    rng = random.Random(seed)
    make = lambda n: [(rng.choice([1, 2, None, 3]) if by else 1, i, rng.choice([None, D[rng.randrange(200)], D[50]]), rng.choice([None, D[rng.randrange(200)], D[60]])) for i in range(n)]
    left, right = make(70), make(60)
    a, b = spark.createDataFrame(left, "k long, i long, low date, high date"), spark.createDataFrame(right, "k long, j long, begin date, done date")
    if not by:
        b = b.withColumnRenamed("k", "k2")
    out = overlap.overlap_join(a, b, by, ("low", "high"), ("begin", "done"), closed, hot, width)
    top = dt.date(3000, 1, 1)

    def fits(x, y):
        known = x[2] and y[2] and (not by or (x[0] is not None and x[0] == y[0]))
        if not known:
            return False
        xh, yh = x[3] or top, y[3] or top
        if closed:
            return x[2] <= xh and y[2] <= yh and x[2] <= yh and y[2] <= xh
        return x[2] < xh and y[2] < yh and x[2] < yh and y[2] < xh

    assert sorted((r["i"], r["j"]) for r in out.collect()) == sorted((x[1], y[1]) for x in left for y in right if fits(x, y))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert overlap.overlap_join(a.limit(0), b, by, ("low", "high"), ("begin", "done")).count() == 0
    with pytest.raises(ValueError):
        overlap.overlap_join(a, a, by, ("low", "high"), ("low", "high"))


EVENTS = "ric string, exchange_ticker string, date timestamp, seq long, change string"


def test_streamed_fold_equals_the_fold(spark):
    rng = random.Random(5)
    seeds = [(f"r{k}", f"S{k}") for k in range(12)] + [("r3", "S3b")]
    events = [(f"r{rng.randrange(16)}", f"T{i}", T[rng.randrange(60)], i, rng.choice(["Joiner", "Leaver", "Leaver", "Other"])) for i in range(400)]
    a, b = spark.createDataFrame(seeds, "ric string, exchange_ticker string"), spark.createDataFrame(events, EVENTS)
    fields = ["ric", "start_date", "end_date"]
    rows = lambda df: sorted(map(tuple, df.select(*fields).collect()), key=repr)
    assert rows(membership.membership_intervals_streamed(a, b, T[0])) == rows(membership.membership_intervals(a, b, T[0]))


def test_a_ric_of_very_many_events(spark):
    n = 300_000
    at = F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)")
    events = spark.range(1, n + 1).select(F.lit("r").alias("ric"), F.lit("T").alias("exchange_ticker"), at.alias("date"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 1, "Joiner").otherwise("Leaver").alias("change"))
    out = membership.membership_intervals_streamed(spark.createDataFrame([], "ric string, exchange_ticker string"), events, T[0] - dt.timedelta(days=9))
    assert out.where("end_date is not null").count() == n // 2 and out.where("end_date is null").count() == 0


def test_fold_holds_a_batch_at_most(spark):
    """What a task of one key of many long rows takes does not grow with their number."""
    def begin(key):
        return [0, 0]

    def step(state, row):
        state[0] += len(row["text"])
        state[1] = max(state[1], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
        return iter(())

    def finish(state):
        yield state[0], state[1]

    from pyspark.sql.types import StructType

    most = []
    for n in (20_000, 160_000):
        rows = spark.range(n).select(F.lit(1).alias("k"), "id", F.repeat(F.lit("x"), 1000).alias("text"))
        size, memory = fold.folded(rows, ["k"], [F.col("id")], begin, step, finish, StructType.fromDDL("size long, memory long")).first()
        assert size == n * 1000
        most.append(memory)
    assert most[1] < most[0] + 60_000  # kB, where the rows are 140 MB more


def test_membership_of_a_stream(spark, tmp_path):
    rng = random.Random(6)
    schema = "ric string, side int, date timestamp, seq long, change string, exchange_ticker string"
    seeds = [(f"r{k}", f"S{k}") for k in range(6)]
    events = sorted((T[1 + i // 8], i, f"r{rng.randrange(8)}", rng.choice(["Joiner", "Leaver"])) for i in range(160))
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        closed = []
        for part, (low, high) in enumerate(((0, 80), (80, 160))):
            rows = [(r, 1, d, i, c, f"T{i}") for d, i, r, c in events[low:high]] + ([(r, 0, None, None, None, t) for r, t in seeds] if part == 0 else [])
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = stream_membership(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), T[0])
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
            closed.append(spark.read.parquet(str(tmp_path / "out")).count())
        assert 0 < closed[0] < closed[1]
        got = sorted((r["ric"], r["start_date"], r["end_date"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    batch = membership.membership_intervals_streamed(spark.createDataFrame(seeds, "ric string, exchange_ticker string"), spark.createDataFrame([(r, f"T{i}", d, i, c) for d, i, r, c in events], EVENTS), T[0])
    assert got == sorted((r["ric"], r["start_date"], r["end_date"]) for r in batch.where("end_date is not null").collect())


def test_strict_fill_passes_from_one_instrument_to_the_next(spark):
    members = spark.createDataFrame([("A", "a", 1), ("C", "c", 3)], "ric string, exchange_ticker string, security_id long")
    shares = spark.createDataFrame([("A", D[0], 100.0), ("A", D[1], None), ("B", D[0], None), ("C", D[0], 50.0), ("C", D[1], 60.0)], "instrument string, date date, outstanding_shares double")
    float_ = spark.createDataFrame([("A", D[0], 1, 50.0), ("C", D[1], 1, 20.0)], "instrument string, date date, seq long, free_float_pct double")
    rows = lambda strict: sorted((r["effective_date"], r["security_id"] or 0, r["metric_value"]) for r in membership.float_adjusted_shares(members, shares, float_, strict=strict).collect())
    assert rows(True) == [(D[0], 1, 50.0), (D[0], 1, 50.0), (D[0], 3, 25.0), (D[1], 1, 50.0), (D[1], 3, 12.0)]
    assert rows(False) == [(D[0], 0, None), (D[0], 1, 50.0), (D[0], 3, None), (D[1], 1, 50.0), (D[1], 3, 12.0)]
