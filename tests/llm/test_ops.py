"""The ten operators against plain Python, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyweave.llm import bpe, chat, fingerprint, langid, minhash, packing, quality, secrets, substring, warc
from tallyweave.llm.columns import run_hashes, words_of
from tallyweave.llm.components import components
from tallyweave.llm.queries import BPE_50K
from tallyweave.staging import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"
ODD = "doc_id long, text string, lang string, tag int, row string, key int, spans int, kept string, words int, node long"


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def odd(spark, rows):
    """Documents with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", 1, "r", 2, 3, "k", 4, 5) for i, t in rows], ODD)


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, blanks of all kinds, nulls and empties."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéßñ") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [make(70) for _ in range(3)]
    rows, base = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "one"), (5, "two three")], make(150)
    for i in range(6, n):
        kind = rng.random()
        if kind < 0.25:
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        elif kind < 0.6:
            words = make(rng.randint(0, 90)) + rng.choice(passages)[rng.randint(0, 15) : 70 - rng.randint(0, 15)] + make(rng.randint(0, 90))
        elif kind < 0.7 and len(rows) > 10:
            rows.append((i, rows[rng.randrange(6, len(rows))][1]))
            continue
        else:
            words = make(rng.randint(1, 300))
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t", "  ", "\x0b"]) for w in words)))
    return rows


# 1


def plain_base(text):
    found = []
    for order, (pattern, ok) in enumerate(
        [
            (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
            (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
            (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
        ]
    ):
        found += [(m.start(), order, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return [(s, secrets.KINDS[k], e) for s, k, e in sorted(found)]


def test_secrets_keep_the_base_spans():
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "tOken", "api_key", "APIKEY", "ſecret", "toKen", " ", "  ", ":", "=", '"', "'", "abc", "abcdefgh1", "AKIA", "AKIAABCDEFGH", "IJKL1234", "0123456789abcdef", "é", "\n", "pwd", "pin is ", "x9$Kq!v2Lm", "token=", "-"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        spans = secrets.scan(text, text.encode(), 8.0)
        assert [x for x in spans if x[1] != "guess"] == plain_base(text), text


def test_guess_cost():
    cost = lambda v: secrets.guess_cost(v)[0]
    kinds = lambda v: [k for _, _, k in secrets.guess_cost(v)[1]]
    assert kinds("password") == ["word"] and kinds("P@ssw0rd") == ["word"] and kinds("20240131") == ["date"]
    assert kinds("aaaaaaaa") == ["repeat"] and kinds("zxcvbnm") == ["walk"] and kinds("x9$Kq!v2Lm") == ["brute"]
    assert cost("password") < cost("password1") < cost("x9$Kq!v2Lm") and cost("abcabcabc") < cost("abcqzkmwp")
    assert cost("correcthorsebatterystaple") > cost("correcthorse")

    assert cost("ssssecret") == pytest.approx(cost("sss") + cost("secret")) == pytest.approx(4.15, abs=0.01)
    unit = "k8Vq2LmZr5TyWp0Xd"
    assert cost(unit * 3) == pytest.approx(cost(unit) + np.log10(3) + np.log10(2))
    wide = "".join(random.Random(2).choices("abcdefghijkmXYZ0123456789", k=150))
    assert cost(wide * 4) == pytest.approx(cost(wide) + np.log10(4) + np.log10(2))


def plain_cost(value, ranks, choice=np.log10(2)):
    """The cheapest segmentation, over every part of the value and every rule again."""
    rows = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
    place = {c: (r, k) for r, row in enumerate(rows) for k, c in enumerate(row)}
    many = lambda c: 10 if c.isdigit() else 26 if c.isalpha() else 33
    date = re.compile(r"(19|20)\d\d([-/.]?(0[1-9]|1[0-2])[-/.]?(0[1-9]|[12]\d|3[01]))?|(0[1-9]|[12]\d|3[01])[-/.]?(0[1-9]|1[0-2])[-/.]?(19|20)\d\d")

    def part(x):
        low, n, out = x.lower(), len(x), [sum(np.log10(many(c)) for c in x)]
        looks = low.translate(str.maketrans("4@8361!|05$7+2", "aabegiilossttz"))
        rank, swaps = (ranks[low], 0) if low in ranks else (ranks.get(looks), sum(a != b for a, b in zip(low, looks)))
        if rank and n >= 3:
            upper = sum(c.isupper() for c in x)
            shapes = 1 if not upper else 2 if upper in (1, n) and x[0].isupper() else len(list(combinations(range(n), min(upper, n // 2)))) + 1
            out.append(np.log10(max(rank, 2) * shapes * 2**swaps))
        if date.fullmatch(x):
            out.append(np.log10(365 * 120 if n > 4 else 120))
        steps = {ord(b) - ord(a) for a, b in zip(low, low[1:])}
        if n >= 3 and (len(set(x)) == 1 or steps in ({1}, {-1})):
            out.append(np.log10(many(x[0]) * n))
        if n >= 4 and all(c in place for c in low):
            moves = [(place[b][0] - place[a][0], place[b][1] - place[a][1]) for a, b in zip(low, low[1:])]
            if all(max(map(abs, m)) <= 1 for m in moves):
                out.append(np.log10(47 * n) + 0.5 * (1 + sum(a != b for a, b in zip(moves, moves[1:]))))
        out += [plain_cost(x[:w], ranks) + np.log10(n // w) for w in range(2, n // 2 + 1) if x == x[:w] * (n // w)]
        return min(out)

    best = [0.0]
    for e in range(1, len(value) + 1):
        best.append(min(best[s] + part(value[s:e]) + choice for s in range(e)))
    return best[-1]


def test_guess_cost_is_least():
    rng = random.Random(21)
    bits = ["secret", "love", "Love", "p4ss", "ss", "s", "2024", "1", "12", "31", "a", "abc", "cba", "qwe", "rty", "asdf", "zx", "X9", "$", "20240131", "k8V", "dragon"]
    ranks = secrets._ranks()
    for k in range(700):
        unit = "".join(rng.choice(bits) for _ in range(rng.randint(1, 4)))[: rng.randint(1, 14)]
        value = unit * rng.choice([1, 1, 1, 2, 3]) + rng.choice(["", rng.choice(bits)])
        assert secrets.guess_cost(value)[0] == pytest.approx(plain_cost(value, ranks)), value
        cuts = secrets.guess_cost(value)[1]
        assert [s for s, _, _ in cuts] == [0, *(e for _, e, _ in cuts[:-1])] and cuts[-1][1] == len(value)


def spans_of(text, *words):
    return secrets.scan(text, text.encode(), 8.0, *words)


def test_values_that_base_spans_cut_are_redacted_whole():
    for text, left in (
        ("password: Tr0ub4dor&3x!9Zq end", "<assign> end"),
        ('{"token":"abcdefgh$1x9Kq","name":"some-body"}', '{"<assign>","name":"some-body"}'),
        ('{"token":"abcdefgh1x9Kq","name":"some-body"}', '{"<assign>","name":"some-body"}'),
        ("secret=abcdefgh1 end", "<assign> end"),
        ("pwd='x9$Kq\\'v2Lm' end", "pwd='<guess>' end"),
        ('pwd="x9"Kq!v2Lm" end', 'pwd="<guess>" end'),
    ):
        assert secrets.redacted(text, spans_of(text)) == left
    assert spans_of("password: Tr0ub4dor&3x!9Zq") == [(0, "assign", 19), (10, "guess", 26)]
    assert spans_of("secret=abcdefgh1") == [(0, "assign", 16)]


def test_long_values_are_redacted_whole():
    rng = random.Random(8)
    token = "".join(rng.choice("abcdefghijkmXYZ0123456789.-_$") for _ in range(300)) + "x"
    for context in ("api-key: ", "auth=", "pwd="):
        assert secrets.redacted(f"{context}{token} end", spans_of(f"{context}{token} end")) == f"{context}<guess> end"
    assert not spans_of("pwd=" + "z" * 20_000) and not spans_of("pwd=" + "zx" * 10_000)
    assert spans_of("pwd=" + "z" * 20_000 + "x9$Kq!v2Lm") == [(4, "guess", 20_014)]
    for _ in range(300):
        value = "".join(rng.choice(["z" * rng.randint(1, 400), "qwertyuiop", "password", "xy" * rng.randint(1, 200), rng.choice("kQ$7") * 2]) for _ in range(rng.randint(1, 4)))
        assert secrets.costly(value, 8.0) == (secrets.guess_cost(value)[0] >= 8.0)


def test_names_around_a_keyword_are_credential_contexts():
    for name in ("DB_PASSWORD=", "user_secret: ", "db_password_prod: ", "aws_secret_access_key = ", "dbPassword=", "mypassword=", "authToken: ", "app.auth.key=", "userPin=", "DB_PASS=", "oauth: ", "my-pin-2 is ", "pwd" + " " * 40 + "=" + " " * 40, "password   is   ", '"login" : "', "x?token=", "credentials="):
        text = f"{name}x9$Kq!v2Lm"
        assert (len(name), "guess", len(text)) in spans_of(text), name
    for name in ("author: ", "compass = ", "opinion is ", "passage: ", "shipping=", "Pinned: ", "AUTHOR: "):
        assert not spans_of(f"{name}x9$Kq!v2Lm"), name
    assert not spans_of("token" * 50_000) and not spans_of("pwd" + " " * 200_000)


def test_plain_words_in_credential_contexts_stay(spark):
    rows = [(0, "A simple door is required, the optional one is simple."), (1, "Bring the required and optional keys."), (2, "the secret is simple, login: required; auth: optional."), (3, "the secret is qzkmwpvx and pwd: x9$Kq!v2Lm"), (4, "the secret is qzkmwpvx"), (5, "password: simplerequired optional")]
    docs = spark.createDataFrame(rows, DOCS)
    ranks = secrets.word_ranks(docs)
    assert {"simple", "required", "optional"} <= ranks.keys() and "qzkmwpvx" not in ranks and ranks["password"] == 1
    out = {r["row"]["doc_id"]: r["redacted"] for r in secrets.find_secrets(docs).collect()}
    assert out[2] == rows[2][1] and out[3] == "the secret is <guess> and pwd: <guess>" and out[4] == "the secret is <guess>"
    assert {r["doc_id"]: r["spans"] for r in secrets.scan_digests(docs).collect()}[2] == ""


def test_secret_queries(spark):
    rows = [(0, None), (1, ""), (2, 'é pwd: x9$Kq!v2Lm, password = "abcdefgh1"'), (2, "token=short pin: 123456"), (3, "x" * 200_000 + " AKIAABCDEFGHIJKL")]
    out = {(r["doc_id"], r["n_assign"], r["n_access"], r["spans"]): r["base_sha256"] for r in secrets.scan_digests(odd(spark, rows)).collect()}
    assert out == {(0, 0, 0, ""): sha(""), (1, 0, 0, ""): sha(""), (2, 1, 0, "guess:7:17,assign:19:40"): sha("assign:19:40"), (2, 0, 0, ""): sha(""), (3, 0, 1, "access:200001:200017"): sha("access:200001:200017")}
    cut = secrets.find_secrets(odd(spark, rows)).select("row.*", "redacted").where("doc_id = 2").collect()
    assert 'é pwd: <guess>, <assign>"' in {r["redacted"] for r in cut} and cut[0]["key"] == 2
    assert secrets.scan_digests(spark.createDataFrame([], DOCS)).count() == 0


# 2

TURNS = "conv_id long, turn long, role string, text string, start int, block string, head string, loss string, nth int"


def test_chat_round_trip(spark):
    rng = random.Random(4)
    parts = ["\\", "\\\\", "#", "### ", "</turn>", "<", ":", ": ", "\n", "l", "h", "c", "é😀", "user", "### Assistant:", "</turn>\n"]
    rows = [(None, 0, "user", "a", 0, "", "", "", 0), (5, 1, None, None, 0, "", "", "", 0), (5, 1, "assistant", "", 0, "", "", "", 0)]
    for conv in range(40):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv + 10, turn, rng.choice(["user", "assistant", "sys:tem"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))), 0, "", "", "", 0))
    df = spark.createDataFrame(rows, TURNS)
    want = {}
    for conv, turn, role, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    back = chat.read_back(chat.format_turns(df)).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in back} == want
    assert {r["conv_id"]: [t for t in r["loss_texts"] if t] for r in back} == {k: [t for role, t in v if role == "assistant" and t] for k, v in want.items()}
    assert all("</turn>" not in x for r in back for x in r["formatted"].split("</turn>\n"))
    digests = {r["conv_id"]: r for r in chat.digests(df).collect()}
    for k, v in want.items():
        said = "".join(f"{a}\n{b}\n" for a, b in v)
        learnt = "".join(b for a, b in v if a == "assistant")
        r = digests[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(v), sha(said), len(learnt), sha(learnt))
    assert chat.digests(df.limit(0)).count() == 0
    long = "a\\b <c> # é" * 200_000
    r = chat.digests(spark.createDataFrame([(1, 0, "user", long, 0, "", "", "", 0), (1, 1, "assistant", long, 0, "", "", "", 0)], TURNS)).first()
    assert (r["turns_sha256"], r["loss_sha256"], r["loss_chars"]) == (sha(f"user\n{long}\nassistant\n{long}\n"), sha(long), len(long))


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see #1 ", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", None), ("odd<", None, "c", 3), (None, "end", None, None)]), (1, 1, "assistant", None)]
    out = chat.format_parts(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")).first()
    assert out["formatted"] == "### user: see \\h1 <|image:0|><|audio:1|><|odd\\l:2|>end</turn>\n### assistant: </turn>\n"
    assert [(a["turn"], a["ordinal"], a["type"], a["ref"], a["tokens"]) for a in out["attachments"]] == [(1, 0, "image", "a.png", 512), (1, 1, "audio", "b.wav", 25), (1, 2, "odd<", "c", 3)]
    assert out["n_attached_tokens"] == 540


# 3


def plain_repeats(rows, window):
    first, out = {}, {}
    cut = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in cut:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(i, first.get(key, i))
    for i, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize(("shard", "n_words"), [(256, 1 << 17), (3, 1 << 17), (256, 300), (256, 0)])
def test_substring_dedup(spark, monkeypatch, shard, n_words):
    monkeypatch.setattr(substring, "SHARD", shard)
    monkeypatch.setattr(substring, "SHARD_WORDS", n_words)
    for seed in (1, 2):
        rows = corpus(seed, 90)
        out = substring.digests(substring.remove_repeats(odd(spark, rows))).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out} == plain_repeats(rows, 50)


def test_substring_dedup_edges(spark):
    words = [f"w{k % 61}" for k in range(4000)]
    text = " ".join(words)
    rows = [(7, text), (7, text), (None, text), (9, text + "\nmore"), (3, None)]
    out = sorted((-1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(odd(spark, rows)).collect())
    assert out == [(-1, 4000, 0), (3, 0, 0), (7, 4000, 0), (7, 4000, 0), (9, 4001, 4000)]
    assert substring.remove_repeats(odd(spark, rows).limit(0)).count() == 0
    same = "x " * 3000  # one anchor everywhere
    out = sorted((r["row"]["doc_id"], r["n_words"], r["n_removed"]) for r in substring.remove_repeats(odd(spark, [(1, same), (2, same + "y"), (3, "y " + same)])).collect())
    assert out == [(1, 3000, 0), (2, 3001, 3000), (3, 3001, 3000)]


@pytest.mark.parametrize("most", [100_000, 60])
def test_reference_is_removed(spark, most):
    rng = random.Random(9)
    reference = [None, "", "a b", *(" ".join(f"r{rng.randint(0, 40)}" for _ in range(n)) for n in (5, 20, 30, 150))]
    source = " ".join(x for x in reference if x).split()
    rows = [(0, None), (1, "")]
    for i in range(2, 40):
        at, n = rng.randrange(len(source)), rng.randint(0, 30)
        rows.append((i, " ".join([f"d{rng.randint(0, 9)}" for _ in range(rng.randint(0, 20))] + source[at : at + n] + [f"r{rng.randint(0, 40)}" for _ in range(rng.randint(0, 20))])))
    windows = {tuple(w[k : k + 8]) for w in (x.split() for x in reference if x) for k in range(len(w) - 7)}
    want = {}
    for i, text in rows:
        w = (text or "").split()
        gone = {j for k in range(len(w) - 7) if tuple(w[k : k + 8]) in windows for j in range(k, k + 8)}
        want[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    found = substring.remove_reference(odd(spark, rows), spark.createDataFrame([(x,) for x in reference], "text string"), 8, most)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digests(found).collect()} == want
    assert any(n for _, n, _ in want.values())
    empty = spark.createDataFrame([], "text string")
    assert substring.remove_reference(odd(spark, [*rows, (None, "x")]), empty, 8).where("n_removed > 0").count() == 0


def test_suffix_automaton():
    rng = random.Random(8)
    for _ in range(150):
        texts = sorted((rng.randint(0, 4), [rng.choice("ab") for _ in range(rng.randint(0, 14))]) for _ in range(5))
        automaton = substring.SuffixAutomaton()
        for label, t in texts:
            automaton.add(t, label)
        query, k = [rng.choice("abc") for _ in range(16)], rng.randint(1, 4)
        want = []
        for s in range(len(query) - k + 1):
            holders = [label for label, t in texts if any(t[a : a + k] == query[s : s + k] for a in range(len(t) - k + 1))]
            if holders:
                want.append((s, min(holders)))
        assert list(automaton.windows(query, k)) == want


# 4


def test_completion_is_the_best_filling():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        sums = {0}
        for size, n in counts.items():
            sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= room}
        filling = packing.completion(room, counts)
        assert sum(filling) == max(sums) and all(filling.count(x) <= counts[x] for x in filling)


def test_plan_is_no_worse_than_best_fit_and_least_where_small():
    def fewest(items, capacity):
        best = len(items)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(items):
                best = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
                place(i + 1, [r - items[i] * (j == k) for k, r in enumerate(rooms)])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return best

    def best_fit(items, capacity):
        rooms = []
        for x in items:
            room = min((r for r in rooms if r >= x), default=None)
            if room is not None:
                rooms.remove(room)
            rooms.append((capacity if room is None else room) - x)
        return len(rooms)

    size = lambda plan: sum(n for _, n in plan)
    rng, better = random.Random(5), 0
    for _ in range(800):
        capacity = rng.choice([20, 30, 50])
        items = sorted((rng.randint(1, capacity) if rng.random() < 0.3 else rng.randint(capacity // 5, capacity // 2) for _ in range(rng.randint(1, 11))), reverse=True)
        counts = {x: items.count(x) for x in items}
        plan = packing.plan(counts, capacity)
        assert all(sum(k * n for k, n in bin_.items()) <= capacity and times > 0 for bin_, times in plan)
        assert {k: sum(bin_.get(k, 0) * times for bin_, times in plan) for k in counts} == counts
        assert packing.lower_bound(counts, capacity) <= size(plan) == fewest(items, capacity) <= best_fit(items, capacity) == size(packing.best_fit(counts, capacity))
        better += size(plan) < best_fit(items, capacity)
    assert better
    for n, most in ((12, 30), (10_000, 25_000)):
        counts = dict.fromkeys((492, 430, 423, 385, 370, 236), n)
        plan = packing.plan(counts, 1024)
        assert size(plan) <= most and {k: sum(bin_.get(k, 0) * times for bin_, times in plan) for k in counts} == counts


def test_packing(spark):
    rng = random.Random(6)
    texts = [None, "", "a", "<|endoftext|>"] + [" ".join(rng.choice(["the", "of", "zq", "é"]) for _ in range(rng.randint(0, 900))) for _ in range(60)] + ["word " * 5000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, "a")]
    out = packing.pack(odd(spark, rows), BPE_50K, 256, 2).collect()
    tok = Tokenizer.from_file(BPE_50K)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) - 256 * (-(-len(ids) // 256) - 1)
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(tuple(r)[:5] for r in out) == sorted(want)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and places[0][0] == 0 and sum(n for _, n in places) <= 256
    assert len(bins) <= -(-sum(r["length"] for r in out) // 256) + 1
    assert packing.pack(spark.createDataFrame([], DOCS), BPE_50K).count() == 0


# 5

PAGES = "page_id long, url string, html string, digest string, size int, last long"


def test_warc_round_trip(spark):
    big, small = "é" * 600, "x" * 999
    html = {1: big, 2: big, 3: small, 4: small, 5: None, 6: "", 10: "long " * 600_000, 7: big + "!", 8: "\r\n\r\nWARC/1.1\r\n" * 200, 9: big}
    rows = [(k, None if k == 3 else f"http://h/{k} ü\n", v, "d", 1, 1) for k, v in html.items()] + [(None, "u", "abc", "d", 1, 1)]
    out = {r["page_id"]: r for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    for k, v in html.items():
        raw = (v or "").encode()
        assert (out[k]["payload_bytes"], out[k]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (out[k]["record_type"], out[k]["refers_to"]) == (("revisit", 9) if k in (1, 2) else ("response", None))
    assert out[None]["record_type"] == "response" and out[3]["target_uri"] is None and len(out) == 11
    assert out[10]["payload_bytes"] == 3_000_000
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    pages = spark.createDataFrame(rows, PAGES)
    assert sorted(map(str, warc.records(written(warc.packages(pages, None), "rows")).collect())) == sorted(map(str, warc.round_trip(pages).collect()))


def test_package_reader_reads_ranges_and_zip64(tmp_path):
    import zipfile

    path = tmp_path / "a.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"0123456789" * 1000)
        z.writestr("packed", b"x" * 5000, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 not the end"
    raw, reads = path.read_bytes(), []
    reader = warc.PackageReader(lambda at, n: (reads.append(n), raw[at : at + n])[1], len(raw))
    assert list(reader.members) == ["big"]
    reads.clear()
    assert reader.range("big", 10, 5) == b"01234" and sum(reads) < 100
    many = tmp_path / "many.zip"
    with zipfile.ZipFile(many, "w") as z:
        for k in range(66_000):
            z.writestr(zipfile.ZipInfo(f"{k}"), b"")
        z.comment = b"c" * 65_535
    raw = many.read_bytes()
    assert len(warc.PackageReader(lambda at, n: raw[at : at + n], len(raw)).members) == 66_000
    with pytest.raises(ValueError):
        warc.PackageReader(lambda at, n: b"x" * n, 100)


def test_packages_are_zip_files_read_by_block(tmp_path):
    import zipfile

    rows = [(k, warc.record("response", k, "u", b"x" * (k * 37 % 5000), None)) for k in range(400)]
    path = str(tmp_path / "p" / "a.wacz")
    size = warc.write_package(path, rows)
    with zipfile.ZipFile(path) as z:  # another reader agrees
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX] and z.read(warc.DATA) == b"".join(r for _, r in rows)
        assert z.getinfo(warc.DATA).compress_type == zipfile.ZIP_STORED
    raw = open(path, "rb").read()
    assert len(raw) == size and warc.END64 in raw[-200:] and warc.LOCATOR64 in raw[-200:]
    ranges = warc.FileRanges("file://" + path, block=10_000)
    found = list(warc.read_package(ranges, ranges.size))
    assert [(r[0], r[1], r[3]) for r in found] == [(k, k * 37 % 5000, "response") for k in range(400)]
    at = raw.index(b"x" * 4000)
    broken = bytearray(raw)
    broken[at] = 0x79
    kinds = [r[3] for r in warc.read_package(lambda a, n: bytes(broken[a : a + n]), size)]
    assert kinds.count("damaged") == 1 and kinds.count("response") == 399
    assert list(warc.read_package(lambda a, n: b"x" * n, 500)) == [(None, None, None, "damaged", None, None)]
    with pytest.raises(ValueError):
        warc.file_system("viewfs://a/b")


# 6


def plain_near(rows, width, part=80):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    sets = {}
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= part * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "HUB_BLOCK", max(3, block // 4))
    rows = corpus(5, 120) + [(500, "A b C"), (501, "a B c"), (502, "a b")]
    out = minhash.near_duplicates(odd(spark, rows), 4, 0.8).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == plain_near(rows, 4)


def test_copies_are_linked_by_their_hub(spark, monkeypatch):
    """A tight group needs no pairs of its own; with texts that miss the hub, only pairs with those are looked at."""
    rng, base = random.Random(3), [f"b{k}" for k in range(300)]
    edited = lambda n: " ".join(rng.choice("xyz") + w if k in at else w for at in [set(rng.sample(range(300), n))] for k, w in enumerate(base))
    tight, loose = [(k, edited(1)) for k in range(90)], [(100 + k, edited(9)) for k in range(12)]
    monkeypatch.setattr(minhash, "HUB_BLOCK", 16)
    looked_at, block_pairs = [], minhash.block_pairs
    monkeypatch.setattr(minhash, "block_pairs", lambda nodes, per_block: looked_at.append(nodes.select("node").distinct().count()) or block_pairs(nodes, per_block))
    for rows in (tight, tight + loose):
        out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), 4, 0.8).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == plain_near(rows, 4)
    assert looked_at[:2] == [0, 0]


def test_near_duplicates_edges(spark):
    rows = [(4, "x y z"), (4, "x y z"), (9, "x y z"), (None, "x y z"), (5, None)]
    out = sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["component_id"] is None else r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd(spark, rows)).collect())
    assert out == [(-1, -1, True), (4, 4, True), (4, 4, True), (5, 5, True), (9, 4, False)]
    long = " ".join(f"w{k % 977}" for k in range(200_000))
    out = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(odd(spark, [(2, long), (1, long + " end"), (3, "w1 w2 w3 w4")]), 4).collect())
    assert out == [(1, 978, 1), (2, 977, 1), (3, 1, 3)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_min_and_max_estimate_similarity():
    words = [f"w{k}" for k in range(1000)]
    texts = [" ".join(words[:800]), " ".join(words[80:880])]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    values, at = minhash.shingle_sets(data, np.array([0, len(texts[0].encode()), len(data)]), 4)
    sets = [values[s:e] for s, e in zip(at, at[1:])]
    sig = [np.array([f(s * a + b) for a, b in zip(minhash._A, minhash._B) for f in (np.min, np.max)]) for s in sets]
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1100)] + [(None, 3), (5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    out = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: root(x) for x in up}


# 7


def plain_quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_versions(spark):
    """A document that quotes two insults is clean to version 2 of the policy and was dropped by version 1."""
    clean = "In the debate one speaker called the other an idiot and a moron, and the chair asked both of them to keep to the question that the meeting had been called for."
    entries = quality.ledger(spark.createDataFrame([(1, clean), (2, None)], "doc_id long, text string"))
    first, second = (p for p in quality.VERSIONS if p.name == "default")
    assert [r["kept"] for p in (first, second) for r in quality.judged(entries, p).orderBy("doc_id").collect()] == [False, False, True, False]


def test_quality(spark):
    rows = corpus(7, 40) + [(100, "a b c d e f g h " * 30), (101, "x\nx\n \nx\ny " * 9), (102, "idiot moron " + "fine words here " * 10), (103, "é#*$ |<>& %" * 3), (104, "same same " * 2000)]
    out = quality.judged(quality.ledger(odd(spark, rows))).collect()
    for r in out:
        text = dict(rows)[r["doc_id"]]
        want = plain_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in out if r["kept"]}
    assert not kept & {0, 1, 2, 3, 100, 102, 104}
    bits = [r["failed_bits"] for r in out]
    for policy in quality.VERSIONS:
        counts = {r["rule"]: (r["n_failed"], r["n_only"]) for r in quality.ablation(quality.ledger(odd(spark, rows)), policy).collect()}
        assert counts == {rule: (sum(b & quality.BIT[rule] != 0 for b in bits), sum(b & policy.mask == quality.BIT[rule] for b in bits)) for rule in policy.rules}
    base = quality.judged(quality.ledger(odd(spark, rows)), quality.POLICIES["base"])
    assert base.where("kept = base_failed").count() == 0
    latest = quality.POLICIES["default"]
    assert latest.version == 2 and {r["policy"] for r in out} == {"default-2"}
    for r in quality.compared(quality.ledger(odd(spark, rows))).collect():
        mask = next(p.mask for p in quality.VERSIONS if f"{p.name}-{p.version}" == r["policy"])
        here, there = [b & mask == 0 for b in bits], [b & latest.mask == 0 for b in bits]
        assert (r["n_kept"], r["n_gained"], r["n_lost"]) == (sum(here), sum(x > y for x, y in zip(here, there)), sum(x < y for x, y in zip(here, there)))
    assert quality.compared(quality.ledger(spark.createDataFrame([], DOCS))).count() == 0
    assert quality.ledger(spark.createDataFrame([], DOCS)).count() == 0


# 8


def test_bpe_equals_the_library(spark):
    rng = random.Random(11)
    parts = " '’\n\t\r\xa0  abcstdmrevl're  éßñ中文٣²½1234.,!$—\U0001f600́ʼªⅣ"
    texts = [None, "", "don't we'll I'd'ves ''s 's 'S", "<|endoftext|>x<|endoftext|> y", "aaaaaaaaaaa aaaa", "<|endoftext", "|>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["ab " * 100_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    tok = Tokenizer.from_file(BPE_50K)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r["doc_id"]: r["ids"] for r in bpe.encode_documents(odd(spark, rows), BPE_50K).collect()} == want
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(odd(spark, rows), BPE_50K), BPE_50K).collect()}
    assert back == {i: tok.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
    for r in bpe.round_trip(odd(spark, rows), BPE_50K).collect():
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[r["doc_id"]] or ""))
    assert bpe.round_trip(spark.createDataFrame([], DOCS), BPE_50K).count() == 0


def test_bpe_forgets_and_keeps_encoding_right(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "GROUP", 1)
    encoder, tok = bpe.Bpe(BPE_50K), Tokenizer.from_file(BPE_50K)
    for k in range(8):
        text = " ".join(f"word{j * (k + 1)}" for j in range(60))
        data = np.frombuffer(text.encode(), np.uint8)
        assert next(encoder.encode([(data, np.array([0, len(data)]))]))[0].tolist() == tok.encode(text, add_special_tokens=False).ids


# 9


def plain_sketch(words, fraction=8, exact=64, width=5):
    """The rule of the sketch again, over xxHash64 as Spark chains it."""
    long = lambda x, seed: xxhash.xxh64(x.to_bytes(8, "little"), seed=seed).intdigest()
    pair = lambda x, y: long(y, long(x, 42))
    h = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]
    if len(words) >= width:
        two = [pair(x, y) for x, y in zip(h, h[1:])]
        four = [pair(x, y) for x, y in zip(two, two[2:])]
        hashes = {pair(x, y) for x, y in zip(h, four[1:])}
    elif words:
        seed = 42
        for w in words:
            seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
        hashes = {seed}
    else:
        hashes = set()
    signed = sorted(x - (x >> 63 << 64) for x in hashes)
    return (signed, True) if len(signed) <= exact else ([x for x in signed if x < -(1 << 63) + (1 << 64) // fraction], False)


def plain_likeness(a, b):
    low = lambda x: {h for h in x if h < -(1 << 63) + (1 << 64) // 8}
    x, y = (set(a[0]), set(b[0])) if a[1] and b[1] else (low(a[0]), low(b[0]))
    return len(x & y) / len(x | y) if x | y else float(a[1] == b[1])


def test_fingerprints(spark):
    rows = corpus(3, 80) + [(90, "z" * 100_000 + " a b c"), (91, "again " * 30_000), (92, "É e\u0301 x")]
    out = {r["doc_id"]: r for r in fingerprint.edited_pairs(odd(spark, random.Random(1).sample(rows, len(rows)))).collect()}
    shown = lambda s: ("=" if s[1] else "~") + base64.b64encode(b"".join(h.to_bytes(8, "big", signed=True) for h in s[0])).decode()
    lengths = set()
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after, half = t or "", after or "", len(t or "") // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (plain_sketch(WORD.findall(x)) for x in (t, edited, after))
        lengths.add(a[1])
        r = out[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), sha(edited), shown(a), shown(b)), i
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(plain_likeness(a, b)), pytest.approx(plain_likeness(a, c)))
    assert lengths == {True, False}
    assert fingerprint.edited_pairs(spark.createDataFrame([], DOCS)).count() == 0
    one = fingerprint.edited_pairs(spark.createDataFrame([(None, "a b c d e f"), (None, None)], DOCS)).collect()
    assert len(one) == 2


def test_sketches_merge(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(300)]
    texts = ["", "a", "a b c"] + [" ".join(rng.choice(words) for _ in range(rng.choice([6, 20, 40, 66, 70, 200, 900]))) for _ in range(60)]
    rows = [(x, y) for x in texts for y in rng.sample(texts, 8)]
    df = spark.createDataFrame(rows, "a string, b string")
    both = F.array_distinct(F.concat(*[F.when(F.size(w) >= 5, run_hashes(w, 5)).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<long>")) for w in (words_of(F.col("a")), words_of(F.col("b")))]))
    sketched = df.select(fingerprint.sketch(F.col("a")).alias("x"), fingerprint.sketch(F.col("b")).alias("y"), both.alias("both"))
    out = sketched.select(fingerprint.merged(F.col("x"), F.col("y")).alias("got"), fingerprint._of_set(F.col("both")).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in out) and {r["want"]["exact"] for r in out} == {True, False}


def test_run_hashes_tell_runs_apart(spark):
    words = random.Random(5).choices("abc", k=400)
    for width in (1, 2, 3, 5, 7, 8):
        hashes = spark.createDataFrame([(words,), (words[: width - 1],), ([],)], "w array<string>").select(run_hashes(F.col("w"), width)).collect()
        runs = [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]
        assert len(hashes[0][0]) == len(runs) and len(set(zip(runs, hashes[0][0]))) == len(set(runs)) == len(set(hashes[0][0]))
        assert hashes[1][0] == hashes[2][0] == []


def test_fingerprints_are_small(spark, sf):
    """Both fingerprints of the given documents together take under half of the texts' characters."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = fingerprint.edited_pairs(docs)
    taken, n_chars = out.agg(F.sum(F.length("fingerprint") + F.length("edited_fingerprint")), F.sum("n_chars")).first()
    assert taken < n_chars / 2


def test_long_texts_without_a_hash_in_the_fraction(spark):
    none = "struct(cast(array() as array<long>) as hashes, {} as exact)"
    pairs = [("false", "false", 1.0), ("true", "true", 1.0), ("true", "false", 0.0), ("false", "true", 0.0)]
    for a, b, want in pairs:
        got = spark.range(1).select(fingerprint.similarity(F.expr(none.format(a)), F.expr(none.format(b)))).first()[0]
        assert got == want, (a, b)


def test_fingerprints_estimate_similarity(spark):
    words = [f"w{k}" for k in range(6000)]
    pairs = spark.createDataFrame([(" ".join(words[:4000]), " ".join(words[2000:])), (" ".join(words[:300]), " ".join(words)), (" ".join(words[:40]), " ".join(words))], "a string, b string")
    s = pairs.select(fingerprint.sketch(F.col("a")).alias("a"), fingerprint.sketch(F.col("b")).alias("b")).select(fingerprint.similarity(F.col("a"), F.col("b")), fingerprint.containment(F.col("a"), F.col("b"))).collect()
    assert s[0][0] == pytest.approx(1 / 3, abs=0.05) and s[1][1] == s[2][1] == 1.0


# 10

LABELLED = "doc_id long, text string, lang string, score double, row string"


def speech(seed, n):
    rng = random.Random(seed)
    bits = {"aa": ["the", "ing", "and", "wh"], "bb": ["eau", "lle", "çé", "que"], "cc": ["ich", "ßen", "sch", "ung"]}
    rows = [(i, " ".join("".join(rng.choice(bits[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 80))), lang, 0.0, "r") for i, lang in ((i, rng.choice(list(bits))) for i in range(n))]
    return [*rows, (n, None, "aa", 0.0, "r"), (n + 1, "123 !", "bb", 0.0, "r"), (n + 2, "", None, 0.0, "r"), (n, None, None, 0.0, "r")]


def test_language_id(spark):
    rows = [*speech(1, 300), (None, "the and ing whing", "aa", 0.0, "r"), (400, "eaulle çéque " * 30_000, None, 0.0, "r"), (401, "добрый день и до свидания", None, 0.0, "r")]
    out = langid.identify(spark.createDataFrame(rows, LABELLED)).select("row.doc_id", "row.lang", "held_out", "lang_pred", "score", "recognised").collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 300]
    assert sum(r["recognised"] for r in held) >= 0.97 * len(held) and [r["recognised"] for r in out if r["doc_id"] == 401] == [False]
    assert [(r["lang_pred"], r["recognised"]) for r in out if r["doc_id"] == 400] == [("bb", True)]
    other = langid.identify(spark.createDataFrame([(i, x, lang, 9.0, "other") if k % 2 else (i, x, None if i is not None and zlib.crc32(str(i).encode()) % 3 == 1 else lang, 1.0, "z") for k, (i, x, lang, *_) in enumerate(rows)], LABELLED))
    keyed = lambda rows_: sorted((str(r["doc_id"]), r["lang_pred"], r["score"]) for r in rows_)
    assert keyed(out) == keyed(other.select("row.doc_id", "lang_pred", "score").collect())  # source and held-out labels change nothing
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in out if r["doc_id"] and 300 <= r["doc_id"] < 400) and all(0 <= r["score"] <= 1 for r in out)
    none = langid.identify(spark.createDataFrame([(1, "abc", None, 0.0, "r")], LABELLED)).first()
    assert none["lang_pred"] == "und"
    assert langid.identify(spark.createDataFrame([], LABELLED)).count() == 0


def test_language_model_is_sparse_and_calibrated():
    labelled = [(t, lang) for _, t, lang, *_ in speech(2, 200) if t and lang]
    data = np.frombuffer("".join(t for t, _ in labelled).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t, _ in labelled)])
    rows = [(*found, lang) for found, (_, lang) in zip(langid.counted(data, offsets), labelled)]
    model = langid.fit(rows)
    assert 1 / 3 < model.least_score < 1 and 0 < model.least_known < 1
    assert (model.table != 0).mean() < 0.2 and model.temperature > 0
    assert langid.fit(rows).table.tolist() == model.table.tolist()


def test_chunks_cover_all_rows():
    from tallyweave.llm.textnp import chunks, text_buffers

    texts = ["", "abc", None, "x" * 100, "", "é" * 50, None, ""]
    column = pa.array(["skip", *texts], pa.string()).slice(1)
    rows = []
    for i, j, data, offsets in chunks(column, 40):
        rows += [(i + k, data[a:b].tobytes().decode()) for k, (a, b) in enumerate(zip(offsets, offsets[1:]))]
    assert rows == [(k, t or "") for k, t in enumerate(texts)]
    assert len(text_buffers(pa.array([], pa.string()))[1]) == 1


def test_values_of_any_script_and_in_quotes_are_redacted_whole():
    for text, left in (
        ("pwd=x9$Kq!vé2Lm9wZ end", "pwd=<guess> end"),
        ("password: naïve9$Kq!v2Lm", "password: <guess>"),
        ("secret: Zürich$2049!x", "secret: <guess>"),
        ('password: "my dog ate 99 Bones!" end', 'password: "<guess>" end'),
        ("pwd\t=\tx9$Kq!v2Lm", "pwd\t=\t<guess>"),
        ("pwd:\nx9$Kq!v2Lm", "pwd:\n<guess>"),
        ('"pwd" => "x9$Kq!v2Lm"', '"pwd" => "<guess>"'),
        ("password: secret: x9$Kq!v2Lm", "password: secret: <guess>"),
        ('pwd="x9$Kq!v2Lm, not closed', 'pwd="<guess>, not closed'),
        ("password:请输入您的密码以继续", "password:请输入您的密码以继续"),
        ('the secret is "never give up on it" she said', 'the secret is "never give up on it" she said'),
    ):
        assert secrets.redacted(text, spans_of(text)) == left


def test_values_take_linear_time():
    began = time.time()
    assert not spans_of("pwd=" + "z" * 300_000) and not spans_of("pwd=" + "zx" * 20_000)
    for text in ('pwd="a ' * 40_000, "pwd=' " * 40_000, 'pwd="' * 40_000, "pwd:" * 40_000, "pwd" + "\n" * 200_000, 'pwd="' + "\\" * 200_000 + " x"):
        assert all(e - s >= 6 for s, e in secrets.values(text, text.encode()))
    assert time.time() - began < 60


def test_repeated_units_are_all_found():
    rng = random.Random(4)
    for _ in range(60):
        value = "".join("".join(rng.choices("abX9$", k=rng.choice([1, 2, 3, 5, 30, 64, 65, 130]))) * rng.randint(1, 5) for _ in range(rng.randint(1, 4)))[:900]
        runs = set()
        for w in range(1, len(value) // 2 + 1):
            s = 0
            while s + w < len(value):
                e = s
                while e + w < len(value) and value[e] == value[e + w]:
                    e += 1
                if e - s >= w and not any(w % p == 0 and a <= s and e + w <= b for a, b, p in runs):
                    runs.add((s, e + w, w))
                s = e + 1
        found = list(secrets._periodic(value))
        assert len(found) == len(set(found)) and set(found) == {r for r in runs if r[2] > 1}
