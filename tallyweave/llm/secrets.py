"""Secret scans: fixed patterns, and password guess costs of values that stand in a credential context.

Base spans come from three patterns. Beyond them, a value after a word such as password, pin or login is cut by
dynamic programming into the cheapest sequence of segments (Wheeler's guess numbers): words (those of the documents,
ranked by a count over all of them outside such values, and common ones of passwords) with capital and look-alike
letters, dates, repeats of a character or of a unit, keyboard walks, character sequences and brute force. The cost of
a value is the decimal logarithm of the guesses an informed attacker needs; a value of `least_cost` or more
becomes a span of kind `guess`, also inside a base span; redaction covers the union of all spans.

Defined results: null text is empty and has no spans; any text length is scanned whole, and a value is as long as its
quotes or its run of visible characters of any script; of segmentations that cost the same any may be told, spans that start together go by kind;
repeated rows are scanned each for itself; extra columns, whatever their names, are carried by `find_secrets` and
ignored by `scan_digests`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tallyweave.staging import mapped, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # 16 characters at least: a shorter run of the class holds no longer match
HEX = re.compile(r"[0-9a-f]{32,}")
#: A name (identifier) and a sign, with what may stand before a value. The name is matched from its first character and all runs are possessive, so time is linear.
CONTEXT = re.compile(r"""(?<![a-z0-9_.-])([a-z0-9_.-]++)["']?(?:[\x20\t\r\n]*+(?:=>|[:=])|\x20++(is)(?=\x20))[\x20\t\r\n]*+(["']?)""", re.I | re.A)
NAMED = re.compile(r"""[A-Za-z0-9_.-]++["']?[:=]""")
#: Where a value ends: a quoted one at its quote (not at one after a backslash or before a letter or digit) if that is in its line, any other at a blank.
CLOSING = {q: re.compile(rf"(?<!\\)(?:\\\\)*+{q}(?![A-Za-z0-9])|[\r\n]") for q in "\"'"}
RUN = {q: re.compile(rf"(?:\\\S|[^{q}\s]|{q}(?=[A-Za-z0-9]))*+") for q in "\"'"} | {"": re.compile(r"\S*+")}
#: What makes a name a credential's: a long keyword anywhere in it; a short one, which other words hold too (compass, opinion, author), as a part of its own.
LONG_NAME = re.compile(r"password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|credential|login", re.I | re.A)
SHORT_NAME = re.compile(r"(?:(?<![A-Za-z])(?:[Pp]ass|PASS|[Pp]in|PIN|[Oo]?[Aa]uth|O?AUTH)|(?<=[a-z])(?:Pass|Pin|PIN|O?Auth))(?![a-z]|(?<=[A-Z])[A-Z])", re.A)
#: Characters that end a sentence or a quotation rather than a value, in any script.
TRAILING = ",;.:)]}>'\"\u2019\u201d\u00bb\u3001\u3002\uff0c\uff1b\uff1a\uff09"
#: Bytes of lower-cased text without which a pattern cannot match.
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT_HINTS = (b"pass", b"pwd", b"pin", b"secret", b"token", b"api", b"credential", b"login", b"auth")

#: Common words of passwords, most common first; their rank is their cost. The documents' own words come beside them.
WORDS = (
    "password 123456 qwerty admin welcome letmein dragon monkey master login princess sunshine shadow football baseball superman batman "
    "trustno1 iloveyou hello freedom whatever michael jennifer jordan hunter ranger buster soccer hockey killer george charlie andrew "
    "thomas robert daniel jessica pepper ginger summer winter spring autumn secret access flower cheese computer internet service "
    "server system user guest root test temp default change changeme pass love angel star diamond silver golden orange purple banana "
    "cookie coffee chocolate tiger eagle falcon phoenix matrix london berlin paris madrid correct horse battery staple blue green "
    "black white money happy lucky magic music power"
).split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
LOOKALIKE = str.maketrans("4@8361!|05$7+2", "aabegiilossttz")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


@lru_cache(1)
def _ranks() -> dict[str, int]:
    return {w: k + 1 for k, w in enumerate(WORDS)}


#: The dictionary from the documents: at most so many words, each of 3 to LONGEST letters and seen LEAST_SEEN times, so it is a few MB at any size.
DICTIONARY, LONGEST, LEAST_SEEN = 50_000, 24, 2
LETTERS = re.compile(r"(?<![a-z])[a-z]{3,24}(?![a-z])")


def word_ranks(docs: DataFrame) -> dict[str, int]:
    """Ranks of the most frequent words of all documents, after those of WORDS; values in a credential context do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    at = 0
                    for s, e in values(t, t.encode()):
                        seen.update(LETTERS.findall(t[at:s].lower()))
                        at = e
                    seen.update(LETTERS.findall(t[at:].lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = mapped(docs.select(docs["text"]), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)
    level = F.floor(F.log2("n") * 16).cast("int")  # at most 1024 levels
    table = written(counted.withColumn("level", level), "words")
    least, room = 1 << 10, DICTIONARY
    for r in sorted(table.groupBy("level").agg(F.count("*").alias("n")).collect(), reverse=True):  # levels go in whole as long as they fit
        if r["n"] > room:
            break
        least, room = r["level"], room - r["n"]
    common = sorted(table.where(F.col("level") >= least).select("word", "n").collect(), key=lambda r: (-r["n"], r["word"]))
    return {r["word"]: k + 1 for k, r in enumerate(common)} | {w: k + 1 for k, w in enumerate(WORDS)}


#: Place of each key: row and column.
PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}


def _beside(a: str, b: str) -> bool:
    """Whether two keys are the same or next to each other, also across rows."""
    p, q = PLACE.get(a), PLACE.get(b)
    return p is not None and q is not None and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


#: How far from a run's ends its parts begin and end: as far as a word can reach into the run. Units of up to SHORT
#: characters are tried from all of these places on, longer ones from the run's first character.
REACH, SHORT = LONGEST, 64


def _runs(flags: list[bool], more: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each run of true flags, `more` characters longer than its flags."""
    at = 0
    for value, group in groupby(flags):
        n = len(list(group))
        if value:
            yield at, at + n + more
        at += n


def _parts(start: int, end: int, least: int) -> Iterator[tuple[int, int]]:
    """Parts of a run of `least` characters and more that begin near its start and end near its end: a part with both
    ends far inside is never better than the run, as what borders it there would be of the same run."""
    for s in range(start, min(start + REACH, end - least) + 1):
        for e in range(max(s + least, end - REACH), end + 1):
            yield s, e


def _periodic(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, width) of each maximal run with a period of `width` >= 2 and two whole units, shortest period first.

    Two runs of periods p and w that are not one share less than p + w characters, so a run of two whole units of w has
    at least w - p outside of a known run: where a run of p fills all but r characters, none is wider than p + r."""
    points = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    n = len(points)
    known: list[tuple[int, int, int]] = [(s, e, 1) for s, e in _runs((points[1:] == points[:-1]).tolist(), 1)]
    widest, width = min([n // 2, *(p + n - (e - s) for s, e, p in known)]), 1
    while (width := width + 1) <= widest:
        equal = points[width:] == points[:-width]
        if np.count_nonzero(equal) < width:
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if e - s >= width and not any(width % p == 0 and a <= s and e + width <= b for a, b, p in known):
                known.append((s, e + width, width))
                widest = min(widest, width + n - (e + width - s))
                yield known[-1]


def segments(value: str, ranks: dict[str, int] | None = None, memo: dict[str, float] | None = None) -> Iterator[tuple[int, int, float, str]]:
    """(start, end, log10 of guesses, kind) of the segments of a value that are cheaper than brute force might be:
    words, dates, and runs (equal characters, repeated units, keyboard walks, character sequences) with their parts."""
    low, n, ranks, memo = value.lower(), len(value), ranks or _ranks(), {} if memo is None else memo
    plain = low.translate(LOOKALIKE)
    equal = list(_runs([x == y for x, y in zip(value, value[1:])], 1))
    alike = np.zeros(n, bool)  # where the parts that may be words are those of the place before, of one character each
    for a, b in equal:
        if b - a > LONGEST and not any(x * k in ranks for x in (low[a], plain[a]) for k in range(3, LONGEST + 1)):
            alike[a : b - LONGEST + 1] = True
    for s in range(n):
        for e in range(s + 3, 0 if alike[s] else min(n, s + LONGEST) + 1):
            rank = ranks.get(low[s:e])
            swapped = 0
            if rank is None and plain[s:e] != low[s:e]:
                rank, swapped = ranks.get(plain[s:e]), sum(a != b for a, b in zip(plain[s:e], low[s:e]))
            if rank:
                capitals = sum(c.isupper() for c in value[s:e])
                shapes = 1 if not capitals else 2 if capitals in (1, e - s) and value[s].isupper() else math.comb(e - s, min(capitals, (e - s) // 2)) + 1
                yield s, e, math.log10(max(rank, 2) * shapes * (1 << swapped)), "word"
        if value[s].isdecimal():
            for size in (4, 8, 9, 10):
                if s + size <= n and DATE.fullmatch(value, s, s + size):
                    yield s, s + size, math.log10(365 * 120 if size > 4 else 120), "date"
    for a, b in equal:
        for s, e in _parts(a, b, 3):
            yield s, e, math.log10(_alphabet(value[s]) * (e - s)), "repeat"
    for step in (1, -1):
        for a, b in _runs([ord(y) - ord(x) == step for x, y in zip(low, low[1:])], 1):
            for s, e in _parts(a, b, 3):
                yield s, e, math.log10(_alphabet(value[s]) * (e - s)), "sequence"
    for a, b in _runs([_beside(x, y) for x, y in zip(low, low[1:])], 1):
        keys = [PLACE[c] for c in low[a:b]]
        moves = [(q[0] - p[0], q[1] - p[1]) for p, q in zip(keys, keys[1:])]
        turned = [0, 0, *accumulate(int(x != y) for x, y in zip(moves, moves[1:]))]  # turns before the step to each key
        for s, e in _parts(a, b, 4):
            yield s, e, math.log10(47 * (e - s)) + 0.5 * (1 + turned[e - 1 - a] - turned[s + 1 - a]), "walk"
    for a, b, width in _periodic(value):
        for s in range(a, min(a + (min(REACH, width) if width <= SHORT else 0), b - 2 * width) + 1):
            unit = value[s : s + width]
            if unit not in memo:
                memo[unit] = cheapest(unit, ranks, memo)[-1][0]
            most = (b - s) // width
            for times in range(max(2, most - REACH // width), most + 1):
                yield s, s + times * width, memo[unit] + math.log10(times), "repeat"


def cheapest(value: str, ranks: dict[str, int] | None = None, memo: dict[str, float] | None = None) -> list[tuple[float, int, str]]:
    """For each k, the least log10 of guesses for the first k characters, and start and kind of the last segment there.

    Each segment costs a factor of 2 for the attacker's choice of kinds, and a run of brute force is one segment, so
    the least cost that ends in brute force is kept beside the least of all: going on with it may be cheaper later.
    memo: costs of repeated units, which are values themselves."""
    n = len(value)
    choice = math.log10(2)
    ends: dict[int, list[tuple[int, float, str]]] = {}
    for s, e, cost, kind in segments(value, ranks, memo):
        ends.setdefault(e, []).append((s, cost, kind))
    best: list[tuple[float, int, str]] = [(0.0, 0, "")]
    brute = (math.inf, 0, "brute")
    for k in range(1, n + 1):
        each = math.log10(_alphabet(value[k - 1]))
        brute = min((brute[0] + each, brute[1], "brute"), (best[k - 1][0] + each + choice, k - 1, "brute"))
        best.append(min([brute, *((best[s][0] + c + choice, s, kind) for s, c, kind in ends.get(k, ()))]))
    return best


def guess_cost(value: str, ranks: dict[str, int] | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """log10 of the guesses for the cheapest segmentation of a value, and its segments."""
    best, cut, k = cheapest(value, ranks), [], len(value)
    while k:
        _, s, kind = best[k]
        cut.append((s, k, kind))
        k = s
    return best[-1][0], cut[::-1]


#: First prefix of a value that is looked at.
PREFIX = 256


def costly(value: str, least_cost: float, ranks: dict[str, int] | None = None) -> bool:
    """Whether guess_cost(value) is `least_cost` or more, decided on a prefix where that proves it: whatever segment
    crosses the prefix's end, its part up to some place in the prefix's second half costs no more than all of it (a
    word or date begins there, a run goes on from it, a repeated unit that is shorter ends there)."""
    size = PREFIX
    while size < len(value):
        if min(best[0] for best in cheapest(value[:size], ranks)[size // 2 :]) >= least_cost:
            return True
        size *= 4
    return guess_cost(value, ranks)[0] >= least_cost


def values(text: str, raw: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the values of 6 characters and more in a credential context; shorter ones cost less than 8.

    A value in quotes that close in its line is all between them, blanks too, but after the word `is` its first run only,
    as that is prose. What stands without quotes, or in ones that never close, is a run of visible characters of any
    script; one without any ASCII character is a word of a language."""
    low = raw.lower()
    if not any(h in low for h in CONTEXT_HINTS) or not (b":" in raw or b"=" in raw or b" is " in low):
        return
    at, ends = 0, {}  # of each quote: the end that was found last and the place from which it is the next one
    while m := CONTEXT.search(text, at):
        at = s = m.end()
        if not (LONG_NAME.search(m[1]) or SHORT_NAME.search(m[1])):
            at = m.end(1)
            continue
        quote, e = m[3], s
        if quote and not m[2]:
            since, until = ends.get(quote, (s, -1))
            if not since <= s <= until:
                found = CLOSING[quote].search(text, s)
                since, until = s, found.end() - 1 if found else len(text)
                ends[quote] = since, until
            if until < len(text) and text[until] == quote:
                e = at = until
        if e == s:
            e = RUN[quote].match(text, s).end()
            at = s if NAMED.fullmatch(text, s, e) else e  # a name and a sign are no value but a context of their own
            e = s + len(text[s:e].rstrip(TRAILING))
        if e - s >= 6 and not text[s:e].isspace() and any(c.isascii() for c in text[s:e]):
            yield s, e


def scan(text: str, raw: bytes, least_cost: float, ranks: dict[str, int] | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans of a text, by start, then kind as listed; ranks: of words, by default of WORDS alone."""
    low = raw.lower()
    found: list[tuple[int, int, int]] = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if LONG_HEX.search(raw):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found += [(s, 3, e) for s, e in values(text, raw) if costly(text[s:e], least_cost, ranks)]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


LONG_HEX = re.compile(rb"[0-9a-f]{32}")


def find_secrets(docs: DataFrame, least_cost: float = 8.0) -> DataFrame:
    """(row, spans, redacted) for each row; row is a struct of all its columns, redacted has <kind> for each span."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0)
            texts = row.field(row.type.get_field_index("text")).to_pylist()
            spans = [scan(t, t.encode(), least_cost, ranks.value) if t else [] for t in texts]
            listed = [[{"kind": k, "start": s, "end": e} for s, k, e in x] for x in spans]
            yield pa.RecordBatch.from_arrays([row, pa.array(listed, SPANS), pa.array([redacted(t, x) if x else t for t, x in zip(texts, spans)], pa.string())], names=["row", "spans", "redacted"])

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    span = StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return mapped(rows, run, StructType([rows.schema["row"], StructField("spans", ArrayType(span)), StructField("redacted", StringType())]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def redacted(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with every run of overlapping spans replaced by the first one's <kind>."""
    out, at = [], 0
    for s, kind, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan_digests(docs: DataFrame, least_cost: float = 8.0) -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans, for each row."""
    ranks = docs.sparkSession.sparkContext.broadcast(word_ranks(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                spans = scan(t, t.encode(), least_cost, ranks.value) if t else []
                kinds = [k for _, k, _ in spans]
                base = ",".join(f"{k}:{s}:{e}" for s, k, e in spans if k != "guess")
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, k, e in spans)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, types))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return mapped(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
