import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyweave.llm import langid, secrets
from tallyweave.llm import queries as llm
from tallyweave.staging import written
from tests.compare import same
from tests.llm.test_ops import WORD, corpus, plain_near

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, extra int"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf, name):
    same(llm.queries()[name](spark, sf), duck.sql(llm.oracle_sql()[name]))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries() if n.startswith("op")) == list(range(1, 14))


def test_pipeline(spark, tmp_path):
    words = [f"{a}{b}" for a in ("the", "ing", "and", "when", "over") for b in ("re", "st", "on", "al", "th", "ly")]
    text = lambda k, n: " ".join(words[(k * 7 + j * j) % 30] + str(k) for j in range(n))
    base = text(1, 80)
    passage = " ".join(f"shared{j}" for j in range(60))
    rows = [
        (1, base, "en"),
        (2, base, "en"),
        (3, base + " more", "en"),
        (4, text(4, 90) + " " + passage, "en"),
        (5, text(5, 70) + " " + passage, "en"),
        (6, "123 456 !", "en"),
        (7, None, "en"),
        (8, "clean words with token = 0123456789abcdef here", None),
        (8, "clean words with token = 0123456789abcdef here", None),
        (None, text(9, 40), "en"),
    ]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1) for i, t, lang in rows], DOCUMENTS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in DOCUMENTS.split(", ")], name
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(sorted(r["doc_id"] or 0 for r in docs.collect()))
    assert kept == [[0, 1, 2, 3, 4, 5, 8, 8], [0, 1, 4, 5, 8], [0, 1, 4, 5, 8], [0, 1, 4, 5, 8]]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert texts[5] == rows[4][1].replace(" " + passage, "") and texts[4] == rows[3][1] and texts[8] == "clean words with <assign> here"
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] or 0 for r in out}) == [0, 1, 4, 5, 8]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]


def plain_packing(texts, capacity=1024):
    """Lengths of all pieces, and the sequences that best-fit decreasing needs."""
    tok = Tokenizer.from_file(llm.BPE_50K)
    lengths = []
    for t in texts:
        n = len(tok.encode(t or "", add_special_tokens=False).ids) + 1
        lengths += [capacity] * ((n - 1) // capacity) + [n - (n - 1) // capacity * capacity]
    rooms = []
    for x in sorted(lengths, reverse=True):
        room = min((r for r in rooms if r >= x), default=None)
        if room is not None:
            rooms.remove(room)
        rooms.append((capacity if room is None else room) - x)
    return sorted(lengths), len(rooms)


def plain_stages(docs, recognised):
    """The stages again in plain Python on {doc_id: text}, each on what the one before left."""
    kept = {i: t for i, t in docs.items() if i in recognised}
    yield kept
    near = plain_near(list(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if near[i][2]}
    yield kept
    first, out = {}, {}
    words = {i: WORD.findall(t or "") for i, t in kept.items()}
    for i, w in words.items():
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(i, first.get(key, i))
    for i, w in words.items():
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        if not gone or len(gone) < len(w):
            out[i] = " ".join(x for j, x in enumerate(w) if j not in gone) if gone else kept[i]
    kept = out
    yield kept
    seen = Counter()
    for t in kept.values():
        at, raw = 0, (t or "").encode()
        for s, e in [*secrets.values(t or "", raw), (len(t or ""), len(t or ""))]:
            seen.update(re.findall(r"(?<![a-z])[a-z]{3,24}(?![a-z])", (t or "")[at:s].lower()))
            at = e
    common = sorted((w for w, n in seen.items() if n >= 2), key=lambda w: (-seen[w], w))
    ranks = {w: k + 1 for k, w in enumerate(common)} | {w: k + 1 for k, w in enumerate(secrets.WORDS)}
    out = {}
    for i, t in kept.items():
        inside = [None] * len(t)
        for s, kind, e in secrets.scan(t, t.encode(), 8.0, ranks):
            run = {inside[k] for k in range(s, e) if inside[k]}
            name = min(run) if run else (s, kind)
            inside[s:e] = [name] * (e - s)
        out[i] = "".join(f"<{m[1]}>" if m and (k == 0 or inside[k - 1] != m) else "" if m else t[k] for k, m in enumerate(inside))
    yield out


def test_pipeline_equals_plain_python(spark, tmp_path):
    rng = random.Random(33)
    rows = [(i + 1, t) for i, t in enumerate(t for _, t in corpus(11, 130))]
    for k, (i, t) in enumerate(rows):
        if t and k % 9 == 0:
            rows[k] = (i, f"{t} db_password: {rng.choice(['x9$Kq!v2Lm', 'Tr0ub4dor&3x!9Zq', 'one'])} and token = {'ab12' * 9} end")
    docs = spark.createDataFrame([(i, t, "aa" if i % 3 else None, f"s{i % 4}", len(t or ""), 7) for i, t in rows], DOCUMENTS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    recognised = {r["doc_id"] for r in langid.predict(docs, langid.fit(langid.training_sample(docs))).where("recognised").select("row.doc_id").collect()}
    assert len(recognised) > 100 and not recognised & {i for i, t in rows if not t or not t.strip()}
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], plain_stages(dict(rows), recognised), strict=True):
        table = written(stage(spark, table, str(tmp_path)), name)
        assert {r["doc_id"]: r["text"] for r in table.collect()} == want, name
        assert all(r["extra"] == 7 and r["source"] == f"s{r['doc_id'] % 4}" for r in table.collect())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths, sequences = plain_packing(want.values())
    assert sorted(r["length"] for r in out) == lengths and len({r["sequence_id"] for r in out}) <= sequences


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean, spans int, node long, nth int, new_text string, tag int, recognised int, score double"


def test_stages_on_empty_tables_and_clashing_names(spark, tmp_path):
    fill = ("s", 0, "r", False, 1, 2, 3, "n", 4, 5, 0.5)
    rows = [(3, "some words here to learn", "en", *fill), (3, "some words here to learn", "en", *fill), (3, "other words of the same document", "en", *fill), (None, "some words here to learn", "en", *fill), (5, None, "en", *fill), (6, "", None, *fill), (7, "long words " * 40_000, "en", *fill)]
    docs = spark.createDataFrame(rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name
        out = stage(spark, docs, "")
        if name != "best_fit_packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert all(tuple(r)[5:] == fill[2:] for r in out.collect()), name
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_dedup(spark, docs.where("text is not null"), "").collect())
    assert [k for k, _ in kept] == [0, 3, 3, 6, 7]
    assert corpus_pipeline.language_id(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").count() == 0


def test_held_out_rule_equals_zlib(spark):
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in spark.range(500).select("id", langid.held_out(F.col("id")).alias("h")).collect())
