"""Buckets of overlap joins: only the time in which pairs can begin, and parts for crowds of either side."""

from tallyweave.operators import overlap


def joined(spark, monkeypatch, left, right, hot):
    """The pairs, and the crowded buckets."""
    crowds, own = [], overlap.written

    def kept(df, what):
        out = own(df, what)
        crowds.extend(out.collect() if what == "crowded" else [])
        return out

    monkeypatch.setattr(overlap, "written", kept)
    a, b = spark.createDataFrame(left, "k long, a long, b long"), spark.createDataFrame(right, "m long, c long, d long")
    found = overlap.overlap_join(a, b, [], ("a", "b"), ("c", "d"), hot=hot)
    return sorted((r["k"], r["m"]) for r in found.collect()), crowds


def plain(left, right):
    return sorted((k, m) for k, a, b in left for m, c, d in right if a <= (d if d is not None else 1 << 60) and c <= b)


def test_open_rows_far_away_do_not_widen_the_buckets(spark, monkeypatch):
    left = [(k, k // 2, k // 2 + 1) for k in range(2000)]
    right = [(m, m * 7, m * 7 + 20 if m % 10 else None) for m in range(100)] + [(m, m * 7000, None) for m in range(100, 300)]
    found, crowds = joined(spark, monkeypatch, left, right, 100)
    assert found == plain(left, right) and not crowds


def test_crowds_of_the_right_side_are_parts_too(spark, monkeypatch):
    left, right = [(k, 5, 6) for k in range(30)], [(m, 6, 9) for m in range(400)] + [(900, 7, 8)]
    found, crowds = joined(spark, monkeypatch, left, right, 50)
    assert found == plain(left, right) and max(r["_parts2"] for r in crowds) >= 8
