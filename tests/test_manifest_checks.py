"""Change feed of a source tree, checks in flight, artefacts that come back."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import checks
from tallyweave.sources import files, manifest

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(9)]


def test_only_what_changed_is_read(spark, tmp_path):
    root = tmp_path / "tree"
    for name, text in {"a.py": "aaaa", "b.py": "bbbb", "sub/c.sql": "cccc", "sub/d.md": "dddd", "e.md": "same", "f.md": "same", ".git/x.py": "no", "g.bin": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    first = manifest.manifest(spark, str(root)).cache()
    assert first.count() == 6
    stat = os.stat(root / "a.py")
    (root / "a.py").write_text("AAAA")  # of the same size and time: not opened, so its hash stays
    os.utime(root / "a.py", ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (root / "b.py").write_text("longer")
    os.rename(root / "sub/c.sql", root / "moved.sql")
    os.rename(root / "e.md", root / "h.md")
    os.remove(root / "sub/d.md")
    (root / "new.txt").write_text("new one")
    second = manifest.manifest(spark, str(root), first)
    short = lambda p: p and p.split("/tree/")[1]
    found = manifest.changes(first, second).collect()
    assert sorted((short(r["path"]), r["change"], short(r["old_path"])) for r in found) == [("b.py", "changed", None), ("h.md", "renamed", "e.md"), ("moved.sql", "renamed", "sub/c.sql"), ("new.txt", "added", None), ("sub/d.md", "removed", None)]
    assert sorted(short(r["path"]) for r in manifest.due(manifest.changes(first, second)).collect()) == ["b.py", "new.txt"]
    got = manifest.contents(spark, str(root), manifest.due(manifest.changes(first, second))).collect()
    assert sorted(bytes(r["content"]).decode() for r in got) == ["longer", "new one"]
    assert manifest.changes(second, second).count() == 0 and manifest.changes(first.limit(0), second).where("change <> 'added'").count() == 0


def test_many_files_are_read_as_one_tree(spark, tmp_path, monkeypatch):
    for k in range(5):
        (tmp_path / f"{k}.py").write_text(f"text {k}")
    monkeypatch.setattr(manifest, "BY_NAME", 2)
    assert manifest.manifest(spark, str(tmp_path)).select("hash").distinct().count() == 5


def test_a_failed_check_loads_nothing(spark):
    loaded = []
    rows = spark.createDataFrame([(D[0], 1.0, 5), (D[1], None, 0), (D[2], -1.0, 5)], "as_of_date date, close double, volume long")
    with pytest.raises(checks.CheckFailed) as e:
        checks.checked(rows, checks.market_metrics(), {"rows": lambda m: m["rows"] > 0, "prices": lambda m: m["not_positive"] == 0, "gaps": lambda m: m["null_close"] == 0}, loaded.append)
    assert e.value.failed == ["prices", "gaps"] and e.value.metrics["zero_volume"] == 1 and not loaded
    found = checks.checked(rows.where("close > 0"), checks.market_metrics(), {"prices": lambda m: m["not_positive"] == 0}, loaded.append)
    assert found == {"rows": 1, "null_close": 0, "not_positive": 0, "zero_volume": 0, "first_date": D[0], "last_date": D[0]} and loaded[0].count() == 1
    assert checks.checked(rows.limit(0), checks.market_metrics(), {}, loaded.append)["rows"] == 0


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(100).mapInArrow(count, "id long")
    loaded = []
    assert checks.checked(rows, {"n": F.count(F.lit(1)), "top": F.max("id")}, {"n": lambda m: m["n"] == 100}, lambda x: loaded.append(x.count())) == {"n": 100, "top": 99}
    assert made.value == 100 and loaded == [100]


def test_what_was_there_comes_back(spark, tmp_path):
    path = str(tmp_path / "artefact")
    files.save(spark.range(3), path)
    with pytest.raises(Exception):
        files.save(spark.range(3).select(F.raise_error(F.lit("no"))), path)
    assert files.load_or_empty(spark, path, "id long").count() == 3
    files.save(spark.range(5), path)
    assert files.load_or_empty(spark, path, "id long").count() == 5 and [x for x in os.listdir(tmp_path) if x.startswith("artefact.old")] == []
