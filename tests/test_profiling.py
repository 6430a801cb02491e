"""Quantiles by selection, and keys from rows."""

import random

import numpy as np
import pytest

from tallyweave.operators import discovery, selection


@pytest.mark.parametrize("cells, few", [(4, 1), (16, 10), (4096, 4096)])
def test_quantiles_equal_numpy(spark, cells, few):
    rng = random.Random(3)
    groups = {"even": [rng.random() for _ in range(500)], "skewed": [rng.expovariate(1) ** 9 for _ in range(400)] + [5.0] * 300, "same": [2.5] * 200, "one": [7.0], None: [float(k) for k in range(11)], "": [1e308, -1e308, 0.0], "wide": [10.0**k for k in range(-300, 300, 7)]}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("even", None), ("none", None), ("same", float("nan"))]
    rng.shuffle(rows)
    at = [0.0, 0.01, 0.5, 0.777, 1.0]
    found = selection.exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", at, cells, few).collect()
    assert len(found) == len(groups) * len(at)
    for r in found:
        xs = sorted(groups[r["g"]])
        k = r["q"] * (len(xs) - 1)
        low, high = xs[int(np.floor(k))], xs[int(np.ceil(k))]
        assert r["n"] == len(xs) and r["value"] == pytest.approx(low + (high - low) * (k - np.floor(k)), rel=1e-12)
    assert selection.exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", at).count() == 0


def test_quantiles_of_all_rows_and_two_keys(spark):
    df = spark.createDataFrame([(1, "a", float(k)) for k in range(100)] + [(1, "b", 5.0), (None, "a", 1.0), (None, None, 2.0)], "h long, g string, x double")
    assert [(r["n"], r["value"]) for r in selection.exact_quantiles(df.where("h = 1 and g = 'a'"), [], "x", [0.25], 4, 2).collect()] == [(100, 24.75)]
    assert sorted((r["h"] or 0, r["g"] or "", r["n"], r["value"]) for r in selection.exact_quantiles(df, ["h", "g"], "x", [0.5], 4, 2).collect()) == [(0, "", 1, 2.0), (0, "a", 1, 1.0), (1, "a", 100, 49.5), (1, "b", 1, 5.0)]


def test_keys_from_rows(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 10), (3, "z", None)], "a_key long, a_name string, a_other long")
    b = spark.createDataFrame([(1, 1, "1"), (1, 2, "2"), (2, 1, "3"), (2, 2, None)], "b_key long, b_line long, b_text string")
    c = spark.createDataFrame([], "c_key long")
    tables = {"a": a, "b": b, "c": c}
    sets = discovery.column_sets(tables)
    assert sorted(map(tuple, discovery.inclusions(sets).collect())) == [("b.b_key", "a.a_key", 2), ("b.b_key", "b.b_line", 2), ("b.b_line", "a.a_key", 2), ("b.b_line", "b.b_key", 2)]
    profile, primary, foreign = discovery.keys_of(tables)
    assert primary == {"a": ["a_key"], "b": ["b_key", "b_line"]} and foreign == {"b": ["b_key"]}
    assert {(r["table_name"], r["column_name"]): (r["rows"], r["nulls"], r["distinct_values"]) for r in profile.collect()} == {
        ("a", "a_key"): (3, 0, 3), ("a", "a_name"): (3, 0, 3), ("a", "a_other"): (3, 1, 1), ("b", "b_key"): (4, 0, 2), ("b", "b_line"): (4, 0, 2), ("b", "b_text"): (4, 1, 3), ("c", "c_key"): (0, 0, 0)}
