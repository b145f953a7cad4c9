"""Operational queries: self-check counts, result fingerprints, stable component ids, similar titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe
from ..operators.graph import connected_components, stable_ids
from ..session import cut, table
from .texts import FOLD

#: The moment the self-check looks from: a parameter, so that results can be reproduced.
NOW = "2026-09-01 00:00:00"


def self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(metric, n): stale and failing endpoints, failed items, hidden and body-less documents, groups without a master."""
    ends, raw, docs, intel = (table(spark, sf_dir, t) for t in ("source_endpoints", "raw_items", "normalized_documents", "intel_documents"))
    now = F.lit(NOW).cast("timestamp_ntz")
    late = F.col("last_success_at").isNull() | (F.col("last_success_at") < now - F.expr("INTERVAL 3 DAYS"))
    one = lambda df, metric, test: df.agg(F.count_if(F.coalesce(test, F.lit(False))).alias("n")).select(F.lit(metric).alias("metric"), "n")
    parts = (
        one(ends, "stale_endpoints", F.col("enabled") & late),
        one(ends, "unhealthy_endpoints", F.col("status") != "active"),
        one(raw, "failed_items", F.col("stage") == "failed"),
        one(raw, "http_errors", F.col("http_status") >= 400),
        one(docs, "hidden_documents", F.col("record_status").isin("rejected", "withdrawn")),
        one(docs, "without_body", F.coalesce(F.col("body_text"), F.lit("")) == ""),
        one(intel, "without_group", F.col("dedupe_component_id").isNull()),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def result_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group a fingerprint of its members in any order: equal ones mean an unchanged result.

    The members' hashes are added up, so a group of any size is combined before the shuffle.
    """
    rows = table(spark, sf_dir, "intel_documents").filter("dedupe_component_id IS NOT NULL")
    digest = F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.coalesce("event_type", F.lit(""))), 256)
    part = lambda i: F.sum(F.conv(F.substring(digest, i, 8), 16, 10).cast("bigint"))
    return rows.groupBy("dedupe_component_id").agg(part(1).alias("high"), part(9).alias("low"), F.count(F.lit(1)).alias("members"))


def stable_component_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all decisions named after those of the older decisions they overlap most."""
    links = table(spark, sf_dir, "dedup_decisions").filter("near_dup_of IS NOT NULL").select("id", F.col("document_id").alias("a"), F.col("near_dup_of").alias("b"))
    former = connected_components(links.filter("id % 3 != 0").select("a", "b")).withColumnRenamed("component", "former_id")
    return stable_ids(cut(connected_components(links.select("a", "b"))), cut(former))


def near_title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All similar but different titles, one row per pair of titles."""
    docs = dedupe.prepared(table(spark, sf_dir, "intel_documents"))
    titles = cut(docs.filter(F.char_length("compact") >= dedupe.SHORTEST_FUZZY_TITLE).groupBy("folded").agg(F.min("id").alias("id")))
    return dedupe.similar_titles(titles, 82)


def title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by folded title: how often each occurs and in how many sources."""
    docs = dedupe.prepared(table(spark, sf_dir, "intel_documents")).select("id", "folded").join(table(spark, sf_dir, "intel_documents").select("id", "source_id"), "id")
    return docs.filter("folded != ''").groupBy("folded").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source_id").alias("sources")).filter("documents >= 2")


QUERIES = {f.__name__: f for f in (self_check, result_fingerprints, stable_component_ids, near_title_pairs, title_groups)}

SQL = {
    "self_check": f"""
SELECT 'stale_endpoints' AS metric, count(*) FILTER (enabled AND (last_success_at IS NULL OR last_success_at < TIMESTAMP '{NOW}' - INTERVAL 3 DAY)) AS n FROM source_endpoints
UNION ALL SELECT 'unhealthy_endpoints', count(*) FILTER (status <> 'active') FROM source_endpoints
UNION ALL SELECT 'failed_items', count(*) FILTER (stage = 'failed') FROM raw_items UNION ALL SELECT 'http_errors', count(*) FILTER (http_status >= 400) FROM raw_items
UNION ALL SELECT 'hidden_documents', count(*) FILTER (record_status IN ('rejected', 'withdrawn')) FROM normalized_documents
UNION ALL SELECT 'without_body', count(*) FILTER (coalesce(body_text, '') = '') FROM normalized_documents
UNION ALL SELECT 'without_group', count(*) FILTER (dedupe_component_id IS NULL) FROM intel_documents""",
    "result_fingerprints": """
WITH d AS (SELECT dedupe_component_id, sha256(id::VARCHAR || '|' || coalesce(event_type, '')) AS d FROM intel_documents WHERE dedupe_component_id IS NOT NULL)
SELECT dedupe_component_id, sum(('0x' || substr(d, 1, 8))::BIGINT)::BIGINT AS high, sum(('0x' || substr(d, 9, 8))::BIGINT)::BIGINT AS low, count(*) AS members FROM d GROUP BY 1""",
    "title_groups": f"""
SELECT {FOLD.format("title")} AS folded, count(*) AS documents, count(DISTINCT source_id) AS sources FROM intel_documents WHERE {FOLD.format("title")} <> '' GROUP BY 1 HAVING count(*) >= 2""",
}
