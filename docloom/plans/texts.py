"""Queries over scalar text, URL and signature functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures, text, urls
from ..functions.similarity import normalize_title
from ..session import table

_WS = text.WHITE_SPACE


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("canonical_url")
    return table(spark, sf_dir, "normalized_documents").select("id", urls.url_key(url).alias("url_key"), urls.canonical_url(url).alias("canonical"))


def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = table(spark, sf_dir, "intel_documents").select("id", normalize_title("title").alias("folded"))
    return folded.withColumn("compact", F.replace("folded", F.lit(" "), F.lit("")))


def body_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intel_documents").select(
        "id",
        text.summary(F.col("body"), F.col("title"), 120).alias("summary"),
        text.clean_summary(F.col("body"), 120).alias("clean_summary"),
    )


def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_markup(F.col("text")).alias("plain"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.identifiers_in(F.col("text"), "cve").alias("cve")).filter(F.size("cve") > 0)


def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "normalized_documents")
    return docs.select("id", text.parse_quality(F.col("title_original"), F.col("published_at"), F.col("body_text")).alias("quality"))


def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "normalized_documents")
    return docs.select("id", text.concatenated_sha256(F.col("canonical_url"), F.col("title_original"), F.col("body_text")).alias("digest"))


def evidence_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "intel_documents").withColumn("quote", F.substring("body", 11, 20))
    return docs.select("id", text.locate_evidence(F.col("quote"), F.col("title"), F.col("body")).alias("e")).select(
        "id", F.col("e.field").alias("field"), F.col("e.start").alias("start_pos"), F.col("e.end").alias("end_pos")
    )


def document_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = signatures.with_signature(table(spark, sf_dir, "intel_documents").select("id", "title", "body"), "title", "body").drop("title", "body")
    return signed.select(
        "id",
        F.array_join("tokens", " ").alias("tokens"),
        F.array_join("blocking", " ").alias("blocking"),
        "simhash",
        F.array_join("minhash", " ").alias("minhash"),
        F.array_join(signatures.simhash_bands(F.col("simhash")), " ").alias("simhash_bands"),
        F.array_join(signatures.minhash_bands(F.col("minhash")), " ").alias("minhash_bands"),
    )


QUERIES = {f.__name__: f for f in (url_normalize, title_normalize, body_summary, strip_markup, identifiers, parse_quality, content_digest, evidence_offsets, document_signature)}

FOLD = "trim(regexp_replace(replace(lower(nfc_normalize(coalesce({0}, ''))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_SQ = f"trim(regexp_replace({{0}}, '[\\s{_WS}]+', ' ', 'g'))"

def _tokens_sql(column: str) -> str:
    words = f"list_filter(regexp_extract_all({column}, '[a-z0-9][a-z0-9+.#_-]{{2,}}'), lambda w: length(w) >= 4)"
    runs = f"regexp_extract_all({column}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]+')"
    pairs = f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))"
    return f"list_sort(list_distinct(list_concat({words}, {pairs})))"


SIGNED = f"""
folded AS (SELECT id, {FOLD.format("title")} AS title, {FOLD.format("coalesce(title, '') || chr(10) || substr(coalesce(body, ''), 1, 600)")} AS whole,
  {FOLD.format("substr(coalesce(body, ''), 1, 600)")} AS body FROM intel_documents),
tok AS (SELECT id, title, {_tokens_sql("whole")} AS tokens, {_tokens_sql("title")} AS title_tokens, {_tokens_sql("body")} AS body_tokens FROM folded)"""
SIGNATURE_SQL = f"""
WITH {SIGNED},
sig AS (SELECT id, tokens, CASE WHEN length(replace(title, ' ', '')) < 24 THEN [] ELSE
    list_concat(title_tokens[:24], list_filter(body_tokens[:8], lambda t: NOT list_contains(title_tokens[:24], t))) END AS blocking,
  CASE WHEN len(tokens) > 0 THEN list_transform(range(16), lambda s: list_min(list_transform(tokens, lambda t: substr(sha256(s::VARCHAR || ':' || t), 1, 16)))) ELSE [] END AS minhash,
  CASE WHEN len(tokens) > 0 THEN list_transform(range(16), lambda d: list_sum(list_transform(range(4), lambda b: CASE WHEN 2 * list_sum(list_transform(tokens, lambda t:
    (instr('0123456789abcdef', substr(sha256(t), d::INT + 1, 1)) - 1) >> (3 - b)::INT & 1)) >= len(tokens) THEN 1 << (3 - b)::INT ELSE 0 END))::INT) END AS digits
  FROM tok),
hexed AS (SELECT *, list_aggregate(list_transform(digits, lambda d: substr('0123456789abcdef', d + 1, 1)), 'string_agg', '') AS simhash FROM sig)
SELECT id, array_to_string(tokens, ' ') AS tokens, array_to_string(blocking, ' ') AS blocking, simhash, array_to_string(minhash, ' ') AS minhash,
  CASE WHEN simhash IS NULL THEN '' ELSE array_to_string(list_transform(range(4), lambda b: 'sim:' || b || ':' || substr(simhash, (13 - 4 * b)::INT, 4)), ' ') END AS simhash_bands,
  CASE WHEN len(minhash) < 16 THEN '' ELSE array_to_string(list_transform(range(4), lambda b: 'min:' || b || ':' || substr(sha256(array_to_string(
    list_transform(minhash[b * 4 + 1 : b * 4 + 4], lambda h: ('0x' || h)::UBIGINT::VARCHAR), ':')), 1, 16)), ' ') END AS minhash_bands
FROM hexed"""

_Q = "array_to_string(list_filter(string_split(regexp_extract({0}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|ref)(=|$)')), '&')"
_ABS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_CLEAN = f"trim(canonical_url, '{_WS}')"

SQL = {
    "url_normalize": f"""
SELECT id, CASE WHEN regexp_matches({_CLEAN}, '{_ABS}') THEN lower(regexp_extract({_CLEAN}, '{_ABS}', 1)) || '://' || lower(regexp_extract({_CLEAN}, '{_ABS}', 2))
    || coalesce(nullif(regexp_replace(regexp_extract({_CLEAN}, '{_ABS}', 3), '/+$', ''), ''), '/')
    || coalesce('?' || nullif(regexp_extract({_CLEAN}, '{_ABS}', 4), ''), '') ELSE {_CLEAN} END AS url_key,
  regexp_extract(canonical_url, '^([^?#]*)', 1) || coalesce('?' || nullif({_Q.format("canonical_url")}, ''), '') AS canonical
FROM normalized_documents""",
    "title_normalize": f"SELECT id, {FOLD.format('title')} AS folded, replace({FOLD.format('title')}, ' ', '') AS compact FROM intel_documents",
    "body_summary": f"""
WITH d AS (SELECT id, {_SQ.format("body")} AS flat, trim(title, '{_WS}') AS t, trim(regexp_replace(coalesce(body, ''), '<[^>]+>', '', 'g'), '{_WS}') AS plain FROM intel_documents),
h AS (SELECT *, substr(plain, 1, 120) AS head FROM d),
p AS (SELECT *, [{", ".join(f"CASE WHEN instr(reverse(head), '{m[::-1]}') > 0 THEN length(head) - instr(reverse(head), '{m[::-1]}') - {len(m) - 1} ELSE -1 END" for m in ("。", "！", "？", ". ", "! ", "? "))}] AS places FROM h)
SELECT id, CASE WHEN flat <> '' AND flat IS DISTINCT FROM t THEN rtrim(substr(flat, 1, 120), ' ') END AS summary,
  CASE WHEN length(plain) <= 120 THEN plain {" ".join(f"WHEN places[{i}] > 50 THEN rtrim(substr(head, 1, (places[{i}] + {n})::INT), ' ')" for i, n in ((1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 2)))} ELSE rtrim(head, ' ') || '…' END AS clean_summary
FROM p""",
    "strip_markup": f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'), 'https?://[^ \\t\\n\\x0b\\f\\r]+', ' ', 'g'), '[\\s{_WS}]+', ' ', 'g')) AS plain FROM documents",
    "identifiers": "SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\bCVE-\\d{4}-\\d{4,7}\\b'), lambda x: upper(x)))) AS cve FROM documents WHERE regexp_matches(text, '(?i)\\bCVE-\\d{4}-\\d{4,7}\\b')",
    "parse_quality": f"""
SELECT id, round(CASE WHEN coalesce(trim(title_original, '{_WS}'), '') <> '' THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN published_at IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN length(trim(body_text, '{_WS}')) >= 80 THEN 0.4::DOUBLE ELSE 0 END, 3) AS quality FROM normalized_documents""",
    "content_digest": "SELECT id, sha256(coalesce(canonical_url, '') || coalesce(title_original, '') || coalesce(body_text, '')) AS digest FROM normalized_documents",
    "evidence_offsets": """
WITH q AS (SELECT id, title, body, substr(body, 11, 20) AS quote FROM intel_documents)
SELECT id, CASE WHEN quote <> '' AND instr(title, quote) > 0 THEN 'title' WHEN quote <> '' AND instr(body, quote) > 0 THEN 'body' ELSE 'unknown' END AS field,
  CASE WHEN quote <> '' AND instr(title, quote) > 0 THEN instr(title, quote) - 1 WHEN quote <> '' AND instr(body, quote) > 0 THEN instr(body, quote) - 1 END AS start_pos,
  CASE WHEN quote <> '' AND instr(title, quote) > 0 THEN instr(title, quote) - 1 + length(quote) WHEN quote <> '' AND instr(body, quote) > 0 THEN instr(body, quote) - 1 + length(quote) END AS end_pos
FROM q""",
    "document_signature": SIGNATURE_SQL,
}
