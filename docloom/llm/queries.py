"""Queries pN_... of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..session import cut, table
from .groups import consolidate
from .history import repeats
from .mixing import mix
from .neighbours import similar_pairs
from .repeated_lines import frequent_sequences, repeated_lines, without_repeated_lines
from .sentences import sentences
from .survivors import best_representatives, current_values, valid_time
from .tokens import encoded, token_counts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(table(spark, sf_dir, "atomic_event_embeddings"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_representatives(table(spark, sf_dir, "intel_documents"))


def p2_current_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "intel_documents").select(
        F.col("dedupe_component_id").alias("group_key"), F.col("event_type").alias("value"), valid_time().alias("time")
    )
    return current_values(rows).select(F.col("group_key").alias("dedupe_component_id"), F.col("value").alias("event_type"), "by")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = consolidate(table(spark, sf_dir, "dedup_decisions"), "document_id", "near_dup_of")
    return groups.select(F.col("member").alias("document_id"), "group_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "normalized_documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "normalized_documents"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "normalized_documents"))


def p7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_sequences(table(spark, sf_dir, "normalized_documents"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def _mixture(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mixture that keeps all shares, or with as many tokens as the target sources have."""
    sizes, targets = cut(token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"])), table(spark, sf_dir, "mix_targets")
    budget = None
    if whole:
        wanted = targets.filter("target_share > 0 AND max_repeats >= 1").select("source")
        budget = sizes.filter("tokens > 0").join(wanted, "source", "left_semi").agg(F.coalesce(F.sum("tokens"), F.lit(0))).head()[0]
    return mix(sizes, targets, budget)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p9_whole_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir, whole=True)[0]


def p9_whole_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir, whole=True)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_current_type": p2_current_type,
    "p4_found": p4_found,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p7_sequences": p7_sequences,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_whole_mix": p9_whole_mix,
    "p9_whole_shares": p9_whole_shares,
    "p10_found": p10_found,
}

_BLANK = "coalesce(trim({0}, '" + WHITE_SPACE + "'), '') = ''"

SQL = {
    "p2_found": f"""
WITH r AS (
  SELECT dedupe_component_id AS g, id, {_BLANK.format("title")} AS no_title, {_BLANK.format("body")} AS no_body,
    CASE WHEN published_at > fetched_at THEN NULL ELSE published_at END AS t,
    CASE upper(trim(trust_tier, '{WHITE_SPACE}')) WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END AS tier,
    CASE WHEN parse_quality >= 0 AND parse_quality <= 1 THEN parse_quality ELSE -1 END AS q
  FROM intel_documents WHERE dedupe_component_id IS NOT NULL
), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY tier, q DESC, t DESC NULLS LAST, id) AS n FROM r)
SELECT g AS dedupe_component_id, arg_min(id, n) AS survivor_id,
  coalesce(arg_min(id, n) FILTER (NOT no_title), 0) AS title_from,
  coalesce(arg_min(id, n) FILTER (NOT no_body), 0) AS body_from,
  coalesce((list(id ORDER BY t DESC, n) FILTER (t IS NOT NULL))[1], 0) AS published_from
FROM o GROUP BY g""",
    "p4_found": """
WITH RECURSIVE e AS (
  SELECT document_id AS a, near_dup_of AS b FROM dedup_decisions WHERE near_dup_of IS NOT NULL
  UNION SELECT near_dup_of, document_id FROM dedup_decisions WHERE near_dup_of IS NOT NULL
), n AS (SELECT document_id AS v FROM dedup_decisions UNION SELECT near_dup_of FROM dedup_decisions WHERE near_dup_of IS NOT NULL),
r AS (SELECT v, v AS u FROM n UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT v AS document_id, min(u) AS group_id FROM r GROUP BY v""",
    "p7_found": f"""
WITH d AS (
  SELECT id, endpoint_id, string_split(body_text, chr(10)) AS lines FROM normalized_documents WHERE NOT ({_BLANK.format("body_text")})
), l AS (
  SELECT id, endpoint_id, unnest(lines) AS line, unnest(range(len(lines)))::INT AS line_no FROM d
), n AS (
  SELECT id, endpoint_id, line_no, regexp_replace(trim(regexp_replace(lower(line), '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line FROM l
), t AS (SELECT endpoint_id, count(*) AS total FROM d GROUP BY endpoint_id),
f AS (
  SELECT n.endpoint_id, line FROM n JOIN t USING (endpoint_id) WHERE line <> '' GROUP BY n.endpoint_id, line, total
  HAVING count(DISTINCT id) >= 4 AND count(DISTINCT id) * 100 >= 8 * total
)
SELECT id AS document_id, line_no FROM n JOIN f USING (endpoint_id, line)""",
    "p7_clean": f"""
WITH d AS (
  SELECT id, endpoint_id, string_split(body_text, chr(10)) AS lines FROM normalized_documents WHERE NOT ({_BLANK.format("body_text")})
), l AS (
  SELECT id, endpoint_id, unnest(lines) AS raw, unnest(range(len(lines)))::INT AS line_no FROM d
), n AS (
  SELECT id, endpoint_id, line_no, raw, regexp_replace(trim(regexp_replace(lower(raw), '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS line FROM l
), t AS (SELECT endpoint_id, count(*) AS total FROM d GROUP BY endpoint_id),
f AS (
  SELECT n.endpoint_id, line FROM n JOIN t USING (endpoint_id) WHERE line <> '' GROUP BY n.endpoint_id, line, total
  HAVING count(DISTINCT id) >= 4 AND count(DISTINCT id) * 100 >= 8 * total
), c AS (
  SELECT id, coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (WHERE f.line IS NULL), '') AS body
  FROM n LEFT JOIN f ON f.endpoint_id = n.endpoint_id AND f.line = n.line GROUP BY id
)
SELECT d.id, coalesce(c.body, d.body_text) AS body_text FROM normalized_documents d LEFT JOIN c ON c.id = d.id""",
}
