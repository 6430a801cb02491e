"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, chat, divergence, fingerprint, langid, lexical, minhash, packing, quality, secrets, substring, toxicity, warc

BPE_50K = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digests(table(spark, sf_dir, "documents"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 1 that SQL can express."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = r"\### Assistant: </turn> ok"
    probe = spark.range(2).selectExpr("-7L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").withColumn("text", F.lit(says))
    return chat.digests(turns.unionByName(probe))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), 50))


def remove_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The broadcast form of operator 3: passages of 13 words and more that the benchmark has leave the documents."""
    documents, benchmark = (table(spark, sf_dir, name).select(*columns) for name, columns in (("documents", ["doc_id", "text"]), ("benchmark", ["text"])))
    return substring.digests(substring.remove_reference(documents, benchmark, 13))


def ledger_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of operator 7's ledger drops, and what it alone drops."""
    return quality.ablation(quality.ledger(table(spark, sf_dir, "documents")), quality.EVERY_RULE)


def ledger_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version of every policy of operator 7, judged from one ledger and held against the latest default."""
    return quality.compared(quality.ledger(table(spark, sf_dir, "documents")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BPE_50K, 1024, 2)


def op5_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("target_uri")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, threshold=0.8)


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(quality.ledger(table(spark, sf_dir, "documents")))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BPE_50K)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_pairs(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "held_out", "lang_pred", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offending sentences are listed as start:end in code points, comma-joined."""
    found = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted", spans.alias("offending"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")} | {f.__name__: f for f in (secret_base_counts, remove_benchmark_passages, ledger_ablation, ledger_policies)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": CHAT_SQL, "op3_substring_dedup": REPEATS_SQL, "op5_warc_packages": WARC_SQL, "op6_minhash_near_dedup": NEAR_SQL, "op7_quality_ledger": QUALITY_SQL, "remove_benchmark_passages": BENCHMARK_SQL, "ledger_ablation": ABLATION_SQL, "ledger_policies": POLICIES_SQL, "secret_base_counts": SECRET_SQL, "op11_ranked_search": SEARCH_SQL, "op12_source_divergence": DIVERGENCE_SQL}


SECRET_SQL = r"""
with texts as (select doc_id, coalesce(text, '') as text from documents)
select doc_id, len(list_filter(regexp_extract_all(text, '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) as n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) as n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32)) as n_hex
from texts
"""

#: The formatted length: 4 for the opening, 2 for ": ", 8 for the closing, and one more for each escaped character.
CHAT_SQL = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length(text) + length(text) - length(translate(text, '\#<', '')) + length(role) + length(role) - length(translate(role, '\#<:', '')) + 14 as chars from said
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""

QUALITY_SQL = r"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
cut as (
  select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\v\f\r]')) as lines,
    length(regexp_replace(text, '[ \t\n\v\f\r]+', '', 'g')) as word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
    len(regexp_extract_all(text, '(?i)\b(?:clown|disgusting|idiot|loser|moron|pathetic|scum|stupid|trash|worthless)\b')) as n_insults
  from texts),
windows as (select doc_id, unnest(generate_series(1, len(words) - 7)) as pos, words from cut),
hashed as (select doc_id, pos, array_to_string(list_slice(words, pos, pos + 7), ' ') as w from windows),
twice as (select doc_id, pos from (select *, count(*) over (partition by doc_id, w) as n from hashed) where n > 1),
covered as (select doc_id, sum(least(8, coalesce(following - pos, 8))) as n_repeat_words from (select *, lead(pos) over (partition by doc_id order by pos) as following from twice) group by doc_id),
facts as (
  select c.doc_id, cast(len(words) as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(n_insults as bigint) as n_insults
  from cut c left join covered using (doc_id)),
bits as (
  select *, cast((n_words < 20)::int + 2 * (100 * n_repeat_words > 30 * n_words)::int + 4 * (10 * n_symbols > n_words)::int + 8 * (n_lines > 3 and 100 * n_dup_lines > 30 * n_lines)::int
    + 16 * (n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words))::int + 32 * (n_insults >= 2 or 100 * n_insults > n_words)::int as bigint) as failed_bits from facts)
select *, (failed_bits & 3) <> 0 as base_failed, (failed_bits & 31) = 0 as kept, 'default-2' as policy from bits
"""

REPEATS_SQL = r"""
with cut as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') as words from documents),
windows as (select doc_id, pos, array_to_string(list_slice(words, pos, pos + 49), ' ') as w from (select doc_id, words, unnest(generate_series(1, len(words) - 49)) as pos from cut)),
later as (select doc_id, pos from (select doc_id, pos, min(doc_id) over (partition by w) as first from windows) where first < doc_id),
gone as (select distinct doc_id, unnest(generate_series(pos, pos + 49)) as pos from later),
kept as (
  select c.doc_id, c.pos, c.word from (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from cut) c
  left join gone g on c.doc_id = g.doc_id and c.pos = g.pos where g.pos is null),
texts as (select doc_id, count(*) as n, string_agg(word, ' ' order by pos) as kept from kept group by doc_id)
select c.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from cut c left join texts using (doc_id)
"""

BENCHMARK_SQL = REPEATS_SQL.replace("pos + 49", "pos + 12").replace("len(words) - 49", "len(words) - 12").replace("later as (select doc_id, pos from (select doc_id, pos, min(doc_id) over (partition by w) as first from windows) where first < doc_id)", """items as (select list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') as words from benchmark),
passages as (select distinct array_to_string(list_slice(words, pos, pos + 12), ' ') as w from (select words, unnest(generate_series(1, len(words) - 12)) as pos from items)),
later as (select doc_id, pos from windows semi join passages using (w))""")

ABLATION_SQL = "with judged as (" + QUALITY_SQL + """), rules as (select unnest(['few_words', 'repeated_windows', 'symbols', 'repeated_lines', 'word_length', 'insults']) as rule, unnest([1, 2, 4, 8, 16, 32]) as bit)
select rule, count(*) filter (where failed_bits & bit <> 0) as n_failed, count(*) filter (where failed_bits = bit) as n_only from judged, rules group by rule"""

POLICIES_SQL = "with judged as (" + QUALITY_SQL + """), policies as (select unnest(['base-1', 'default-1', 'default-2']) as name, unnest([3, 63, 31]) as mask),
verdicts as (select name, failed_bits & mask = 0 as here, kept as there from judged, policies)
select name as policy, count(*) filter (where here) as n_kept, count(*) filter (where here and not there) as n_gained, count(*) filter (where there and not here) as n_lost from verdicts group by name"""

WARC_SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as digest, cast(strlen(coalesce(html, '')) as bigint) as n from pages),
q as (select *, max(page_id) over (partition by digest, n) as last from p)
select page_id, n as payload_bytes, digest as payload_digest, case when n >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id < last then last end as refers_to
from q
"""

NEAR_SQL = r"""
with recursive cut as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') as words from documents),
shingles as (
  select distinct doc_id, array_to_string(list_slice(words, pos, pos + 3), ' ') as s
  from (select doc_id, words, unnest(generate_series(1, greatest(len(words) - 3, 1))) as pos from cut where len(words) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b where 100 * p.n >= 80 * (x.n + y.n - p.n)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least_ as (select a as doc_id, min(b) as b from reach group by a)
select c.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(c.doc_id, coalesce(b, c.doc_id)) as component_id, least(c.doc_id, coalesce(b, c.doc_id)) = c.doc_id as kept
from cut c left join sizes using (doc_id) left join least_ using (doc_id)
"""

SEARCH_SQL = r"""
with texts as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
full_ as (select doc_id, terms, cast(len(terms) as bigint) as n from texts where len(terms) > 0),
means as (select count(*) as docs, cast(sum(n) as bigint) as total from full_),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
postings as (select doc_id, n, term, count(*) as tf from (select doc_id, n, unnest(terms) as term from full_) semi join asked using (term) group by all),
weights as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from postings, means group by term),
scores as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) as bigint) as score
  from asked join postings using (term) join weights using (term), means group by item_id, doc_id),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from ranked where rank <= 10
"""

DIVERGENCE_SQL = r"""
with texts as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
found as (select lang, source, doc_id, term, count(*) as n from (select lang, source, doc_id, unnest(terms) as term from texts) group by all),
kept as (select lang, term, sum(n) as lang_n from found group by lang, term having count(*) >= 3),
counts as (select lang, source, term, sum(n) as n from found semi join kept using (lang, term) group by all),
langs as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
groups_ as (
  select g.lang, g.source, coalesce(any_value(v), 0) as v, coalesce(any_value(lang_total), 0) as lang_total, coalesce(sum(n), 0) as total
  from (select distinct lang, source from texts) g left join langs using (lang) left join counts c on c.lang = g.lang and c.source = g.source group by g.lang, g.source),
shares as (
  select g.lang, g.source, k.term, coalesce(n, 0) as n, cast(1 + (1000000000::hugeint * (coalesce(n, 0) + 1)) // (total + v) as hugeint) as p, cast(1 + (1000000000::hugeint * (lang_n + 1)) // (lang_total + v) as hugeint) as q
  from groups_ g join kept k on k.lang = g.lang left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
all_pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from groups_ a join groups_ b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
parts as (
  select lang, source, 'pair' as part, item, value from all_pairs
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from parts)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 200
"""
