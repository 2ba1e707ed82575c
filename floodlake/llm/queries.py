"""The registered queries of the language-model operators, and their DuckDB
SQL where SQL can express them. Each query applies its operator to the whole
table and derives the contract's columns from the operator's result."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crosstoken, exact_dedup, langid, licenses, line_dedup, mixing, quality_crf, quality_rules, quotes, simhash, spelling, url_filter
from .common import held_out, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER_A, TOKENIZER_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: a document is predicted good from this score on
GOOD = 0.3
#: one word in so many of a document gets a misspelling for op13 to find
TYPO_EVERY = 31


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.col("row.doc_id").alias("doc_id"), "source", "weight", "n_tokens", "pass", "order_key", "block")


def op4_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"), role="role", follow=True).select(
        "conv_id", "turn", F.col("row.role").alias("role"), "text", "n_passages", "n_linked", "reply_to", "thread", "depth", "position", "formatted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"), carry=("doc_id",)).select(
        F.col("row.doc_id").alias("doc_id"), *quality_rules.STATS, "base_failed", "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, ~held_out(F.col("doc_id"))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_crf.score_quality(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.drop_lines(line_dedup.insert(None, docs), docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstoken.align(table(spark, sf_dir, "documents"), TOKENIZER_A, TOKENIZER_B)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_byte_bpe, op3_source_mixing, op4_quote_links, op5_license_scan, op6_quality_rules,
    op7_language_id, op8_simhash, op9_exact_dedup, op10_quality_crf, op11_line_dedup, op12_token_alignment, op13_spelling_variants)} | {"pipeline": _pipeline}


def _glob_regex(glob: str) -> str:
    """The glob as a regular expression over ``.host/path``."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    to = {"**": r"(.|\n)*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(to.get(p) or re.sub(r"([.+()\[\]{}^$|\\])", r"\\\1", p) for p in parts) + "$"


def _url_sql() -> str:
    rules = sorted(url_filter.HOST_RULES, key=lambda r: (-len(r[0] + r[1]), r))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in rules)
    globs = ", ".join(f"CASE WHEN regexp_matches('.' || host || path, '{_glob_regex(g)}') THEN '{g}' END" for g in url_filter.BLOCK_GLOBS)
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)),
r AS (SELECT *, CASE {rule} END AS rule, array_to_string(list_filter([{globs}], lambda g: g IS NOT NULL), ',') AS globs FROM hp)
SELECT page_id, host, path, rule, CASE {verdict} WHEN globs <> '' THEN 'block' ELSE 'allow' END AS verdict, globs FROM r"""


_BLANK = r"[\x20\x09-\x0D]"
_SYMBOLS = r"[^#*$%&|<>]"
_QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, list_filter(regexp_split_to_array(text, '{_BLANK}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_BLANK}', '', 'g') <> '') AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM tri) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
s AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '{_SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
f AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS x FROM f GROUP BY source),
p AS (SELECT sum(x) / sum(n) AS m, sum(x * x / n) / sum(n) - (sum(x) / sum(n)) * (sum(x) / sum(n))
  - sum(x) / sum(n) * (1 - sum(x) / sum(n)) * count(*) / sum(n) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 0) ELSE {quality_rules.FIRM} END AS k FROM p),
o AS (SELECT source, (x + k * m) / (n + k) < {quality_rules.HOST_LIMIT} AS ok FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.ok AS kept
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source"""

_DEDUP_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, length(coalesce(text, '')) AS n, coalesce(text, '') AS text,
  regexp_replace(coalesce(text, ''), '{_BLANK}', '', 'g') AS body FROM documents),
g AS (SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST, text, rid))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g"""

_LINE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{_BLANK}+', ''), '{_BLANK}+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key),
m AS (SELECT rid, k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM first AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id"""

ORACLES = {"op1_url_filter": _url_sql(), "op6_quality_rules": _QUALITY_SQL, "op9_exact_dedup": _DEDUP_SQL, "op11_line_dedup": _LINE_SQL}
