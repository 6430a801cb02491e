"""Operators 11 to 13 against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import divergence, lexical, toxicity
from tallyweave.llm import queries as llm

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CLASHING = "doc_id long, text string, lang string, source string, term string, score long, ids int, row string, kept boolean, item string, value int"


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÉéßÄ9ſK") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    out = [None, "", " .. \n", "one", "one", "One two, two;TWO", "\x00a\x7fb", "Ünï ünï 𝔘 𝔘𝔫"]
    while len(out) < n:
        out.append(rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.choice([1, 3, 30, 200]))))
    return out


# 11


def plain_search(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(A_TO_Z))) for i, t in docs]
    terms = [(i, x) for i, x in terms if x]
    n, total = len(terms), sum(len(x) for _, x in terms)
    df = Counter(t for _, x in terms for t in set(x))
    asked = defaultdict(set)
    for item, t in items:
        asked[item] |= set(TERM.findall((t or "").translate(A_TO_Z)))
    out = []
    for item, want in asked.items():
        scores = []
        for i, x in terms:
            tf, m = Counter(x), 100 - 90 + (90 * len(x) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in want if tf[t])
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, block_terms, shard", [(3, 1 << 20, 4 << 20), (10, 40, 600)])
def test_search_equals_plain_python(spark, monkeypatch, k, block_terms, shard):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    docs = [(i if i != 30 else None, t) for i, t in enumerate(texts(5, 90))] + [(7, "one two"), (7, "one two"), (8, "one two"), (9, "long " * 50_000)]
    items = [(i, t) for i, t in enumerate(texts(5, 25))] + [(3, "two absent"), (None, "one two one")]
    found = lexical.search(lexical.index(spark.createDataFrame([(i, t, "en", "s", "t", 1, 2, "r", True, "i", 3) for i, t in docs], CLASHING)), spark.createDataFrame(items, "item_id long, text string"), k, block_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_search(docs, items, k)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([("x", "a"), ("y", None), ("z", "?")], "item_id string, text string")
    assert [tuple(r)[:3] for r in lexical.search(lexical.index(docs), items).collect()] == [("x", 1, 1)]
    assert lexical.search(lexical.index(docs.limit(0)), items).count() == 0
    assert lexical.search(lexical.index(docs), items.limit(0)).count() == 0


def test_impacts_beyond_64_bits():
    length = np.array([10**9, 5])
    got = lexical.impacts(np.array([3, 1]), length, np.array([0, 1]), 10**12, 10**15)
    assert got.tolist() == [(3 * 10**9) // (3000 + 8 * (10 + 90 * n * 10**12 // 10**15)) if n > 5 else 10**9 // (1000 + 8 * (10 + 90 * n * 10**12 // 10**15)) for n in length.tolist()]


def test_best_keeps_all_ties():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n, k = int(rng.integers(0, 40)), int(rng.integers(1, 12))
        score, ids = rng.integers(0, 5, n), rng.permutation(n)
        assert lexical.best(score, ids, k).tolist() == sorted(range(n), key=lambda i: (-score[i], ids[i]))[:k]


# 12


def plain_audit(docs, top):
    docs = [tuple(x or "" for x in d) for d in docs]
    counts, df = defaultdict(Counter), Counter()
    for lang, source, text in docs:
        found = WORD.findall(text.translate(A_TO_Z))
        counts[lang, source].update(found)
        df.update((lang, t) for t in set(found))
    out = []
    for lang in {x[0] for x in docs}:
        kept = [t for g, t in df if g == lang and df[g, t] >= 3]
        groups = sorted(s for g, s in counts if g == lang)
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in groups}
        q = share(sum((counts[lang, s] for s in groups), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            term = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, _, item) in enumerate(rows)]
    return sorted(out)


@pytest.mark.parametrize("top, block", [(200, 256), (4, 2)])
def test_audit_equals_plain_python(spark, monkeypatch, top, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(8)
    docs = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", "é", "z", None]), t) for t in texts(9, 150)]
    docs += [("xx", "a", "lone words"), ("xx", "b", None), ("yy", "only", "same same same"), ("yy", "only", "same"), ("yy", "only", "same")] + [("en", "a", "long " * 50_000)] * 3
    rows = [(i % 50, t, lang, source, "t", 1, 2, "r", True, "i", 3) for i, (lang, source, t) in enumerate(docs)]
    found = divergence.audit(spark.createDataFrame(rows, CLASHING), top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, top)
    assert divergence.audit(spark.createDataFrame(rows, CLASHING).limit(0)).count() == 0


def test_radix_selection_with_ties(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice(["a", "b", "é", "𝔘", "￿"]) for _ in range(rng.choice([1, 2, 9, 40]))) for _ in range(400)})
    rows = [(g, n, rng.choice([0, 1, 65535, 65536, 1 << 40, (1 << 62) + 5]) if g != "tied" else 77) for g in ("few", "many", "tied", None) for n in (names[:7] if g == "few" else names)]
    found = divergence.highest(spark.createDataFrame([r for r in rows if r[0]], "g string, item string, value long"), ["g"], 50)
    want = []
    for g in ("few", "many", "tied"):
        own = sorted(((-v, n.encode(), n) for h, n, v in rows if h == g))[:50]
        want += [(g, n, -v, r + 1) for r, (v, _, n) in enumerate(own)]
    assert sorted(map(tuple, found.select("g", "item", "value", "rank").collect())) == sorted(want)


# 13


def plain_score(model, text):
    """Scores of the sentences of a text that have a word, with their places."""
    out, at = [], 0
    lower = lambda c: c.lower() if len(c.lower()) == 1 and ord(c) < 1 << 16 else c
    for part in re.split(f"([{re.escape(toxicity.ENDS)}])", text or ""):
        symbols = ["", *(lower(c) if ord(c) >= 128 or c.isalnum() else "" for c in part), ""]
        if len(part) != 1 or part not in toxicity.ENDS:
            if any(symbols):
                z = model.bias
                for order in toxicity.ORDERS:
                    for k in range(len(symbols) - order + 1):
                        gram = symbols[k : k + order]
                        if all(gram[1:-1]):
                            value = 0
                            for s in gram:
                                value = value * 0x110001 + (ord(s) if s else 0)
                            bucket = int(toxicity.mix(np.array([(value + (order << 60)) % (1 << 64)], np.uint64))[0] >> np.uint64(44))
                            z += float(model.weights[bucket])
                out.append((at, at + len(part), 1 / (1 + math.exp(-z))))
        at += len(part)
    return out


@pytest.fixture(scope="module")
def marked(spark):
    """Documents of many neutral sentences; toxic ones have one sentence of a word that the others lack."""
    rng = random.Random(12)
    neutral, bad = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(300)], ["zorglub", "Quaxíx"]
    rows, labels, places = [], [], {}
    for i in range(700):
        sentences = [" ".join(rng.choice(neutral) for _ in range(rng.randint(3, 9))) for _ in range(rng.choice([1, 3, 20]))]
        toxic = i % 4 == 0
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] = f"{rng.choice(neutral)} {rng.choice(bad)} {rng.choice(neutral)}"
            places[i] = (sum(len(s) + 2 for s in sentences[:at]), sentences[at])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([(i, t, "en", "s", "t", 1, 2, "r", True, "i", 3) for i, t in rows], CLASHING)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int"), dict(rows), places


@pytest.fixture(scope="module")
def found(marked):
    docs, labels, _, _ = marked
    return toxicity.toxicity(docs, labels).collect()


def test_toxicity_learns_words_and_places(marked, found):
    _, _, rows, places = marked
    assert len(found) == len(rows)
    for r in found:
        i = r["row"]["doc_id"]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert r["predicted"] == int(i in places) == int(r["score"] >= toxicity.TOXIC)
        if i in places:
            start, sentence = places[i]
            assert [rows[i][x["start"] : x["end"]].strip() for x in r["offending"]] == [sentence]


def test_toxicity_scores_equal_plain_python(spark, marked):
    docs, labels, rows, _ = marked
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    odd = [None, "", "  ", "...", "!", "a", "zorglub", "ZORGLUB! quaxíx\n\nzorglub。ok", "İstanbul ZORGLUB 𝔘 ſ.", "x" * 70_000, "zorglub " * 3000]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(odd + list(rows.values())[:30])], "row long, text string")
    got = toxicity.scores(made, model).collect()
    assert len(got) == len(odd) + 30
    for r in got:
        want = plain_score(model, r["row"]["text"])
        assert r["score"] == pytest.approx(1 - math.prod(1 - min(s, 1 - 1e-12) for *_, s in want), abs=1e-6)
        assert [(x["start"], x["end"]) for x in r["offending"]] == [(s, e) for s, e, p in want if p >= toxicity.OFFENDING]


def test_toxicity_without_labels_or_rows(spark, marked):
    docs, labels, _, _ = marked
    for given in (labels.limit(0), labels.where("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(docs, given).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    twice = toxicity.learn(docs.select("doc_id", "text"), labels.unionByName(labels.withColumn("toxic", F.lit(0))))
    assert toxicity.scores(docs.where("doc_id in (0, 4, 8)"), twice).where("score < 0.7").count() == 0


def test_held_out_labels_are_not_learned(spark, marked):
    docs, labels, _, _ = marked
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.learn(docs.select("doc_id", "text"), x) for x in (labels, other))
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_toxicity_query_on_held_out_rows(spark, sf):
    big = sf.replace("0.001", "0.01")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = [r for r in llm.queries()["op13_toxicity"](spark, big).collect() if r["held_out"] and r["doc_id"] in labels]
    bad = [r["predicted"] for r in rows if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in rows if not labels[r["doc_id"]]]
    assert sum(bad) >= 0.6 * len(bad) > 0 and sum(clean) <= 0.03 * len(clean)
