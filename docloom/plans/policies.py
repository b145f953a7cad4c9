"""Queries over what is due, stale, noise or followed, over hotspots and timelines, and over sets and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import events, reads
from ..session import table
from .texts import _WS

#: Parameters of these queries: any words, versions and bounds can be given.
NOISE, FOLLOW, LEAST = ("gateway", "价格", "review"), ("mirror", "registry", "网关"), 0.5
VERSION, STALE_BEFORE = "m2.1", "2026-06-01 00:00:00"


def not_only_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose topics aren't exactly the one given: equality of arrays, null excluded."""
    return table(spark, sf_dir, "intel_documents").filter(F.col("tech_directions") != F.array(F.lit("agents"))).select("id")


def due_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents never deduplicated or by another version only."""
    latest = table(spark, sf_dir, "dedup_decisions").groupBy("document_id").agg(F.max("dedupe_version").alias("version"))
    docs = table(spark, sf_dir, "normalized_documents").select("id").join(latest, F.col("id") == F.col("document_id"), "left")
    return docs.filter(reads.version_due(F.col("version"), VERSION)).select("id", "version")


def unpaired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no decision names as the repeat, or none as the original: two NOT EXISTS under OR."""
    links = table(spark, sf_dir, "dedup_decisions").filter("near_dup_of IS NOT NULL")
    marks = [links.select(F.col(c).alias("id"), F.lit(True).alias(c)).distinct() for c in ("document_id", "near_dup_of")]
    docs = table(spark, sf_dir, "normalized_documents").select("id").join(marks[0], "id", "left").join(marks[1], "id", "left")
    return docs.filter(F.col("document_id").isNull() | F.col("near_dup_of").isNull()).select("id", F.col("document_id").isNull().alias("no_repeat"), F.col("near_dup_of").isNull().alias("no_original"))


def withdrawn_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose (endpoint, native id) was withdrawn at some time: a tuple IN, as a semi-join on two columns."""
    gone = table(spark, sf_dir, "raw_items").filter("lower(trim(operation)) = 'withdraw'").select("endpoint_id", text.strip(F.col("native_id")).alias("raw_item_native_id"))
    return table(spark, sf_dir, "normalized_documents").join(gone, ["endpoint_id", "raw_item_native_id"], "left_semi").select("id")


def stale_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints that aren't both enabled and lately successful: NOT (a AND b), unknown times excluded as in SQL."""
    fresh = F.col("enabled") & (F.col("last_success_at") >= F.lit(STALE_BEFORE).cast("timestamp_ntz"))
    return table(spark, sf_dir, "source_endpoints").filter(~fresh).select("id", "status")


def unknown_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of sources without a target share: a left anti-join that finds rows."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "mix_targets").filter("target_share >= 0.1"), "source", "left_anti").select("doc_id", "source")


def noise_and_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it is noise (a word in the title and no topic) and whether it is followed (a score and a word in its texts)."""
    docs = table(spark, sf_dir, "intel_documents")
    topic = F.get("tech_directions", F.lit(0))
    followed = reads.is_followed(F.col("parse_quality").cast("string"), [F.col("title"), F.col("body")], FOLLOW, LEAST)
    return docs.select("id", reads.is_noise(F.col("title"), topic, NOISE).alias("noise"), followed.alias("followed"))


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each group's documents by time, without noise, as the twenty hottest groups: by sources, members, time and id."""
    docs = table(spark, sf_dir, "intel_documents").filter("dedupe_component_id IS NOT NULL")
    sizes = docs.groupBy("dedupe_component_id").agg(F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("members"), F.max("fetched_at").alias("last_at"))
    first = reads.first_of_each(docs, "dedupe_component_id", [F.col("fetched_at").asc_nulls_last(), F.col("id")])
    kept = first.filter(~reads.is_noise(F.col("title"), F.get("tech_directions", F.lit(0)), NOISE)).select("dedupe_component_id", "id", "title").join(sizes, "dedupe_component_id")
    return reads.page(kept, [F.col("sources").desc(), F.col("members").desc(), F.col("last_at").desc_nulls_last(), F.col("id")], 0, 20)


def module_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest documents of each connector and day, with their summaries."""
    docs = reads.with_endpoint(table(spark, sf_dir, "intel_documents").drop("trust_tier", "source_id"), table(spark, sf_dir, "source_endpoints"), ["connector"])
    day = F.to_date(F.from_utc_timestamp(F.col("fetched_at").cast("timestamp"), "Asia/Shanghai")).cast("string")
    top = reads.top_per_group(docs.withColumn("day", day).filter("day IS NOT NULL"), ["connector", "day"], [F.col("fetched_at").desc(), F.col("id").desc()], 5)
    return top.select("connector", "day", "rank", "id", text.summary(F.col("body"), F.col("title"), 120).alias("summary"))


def usage_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of a number in JSON, missing ones as 0."""
    value = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.coalesce(value, F.lit(0))).alias("k"), F.count(value).alias("known"))


def group_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 over each small group's sorted members; large groups have sums of hashes in ``result_fingerprints``."""
    rows = table(spark, sf_dir, "source_endpoints")
    return reads.set_fingerprint(rows, ["source_id"], F.concat_ws("|", "id", "status"))


def current_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revision of a record with its state: the last one by arrival is current, the others are superseded by the next."""
    rows = table(spark, sf_dir, "raw_items").select("id", "endpoint_id", text.strip(F.col("native_id")).alias("native_id"), "fetched_at").filter("native_id != ''")
    return events.superseded(rows, ["endpoint_id", "native_id"], ["fetched_at", "id"], "id").select("id", "superseded_by")


QUERIES = {
    f.__name__: f
    for f in (
        not_only_topic, due_documents, unpaired_documents, withdrawn_before, stale_endpoints, unknown_sources, noise_and_follow, hotspots, module_timeline,
        usage_sums, group_fingerprints, current_revisions,
    )
}


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w.lower()}')" for w in words) + ")"


_NOISE = f"coalesce(coalesce(tech_directions[1], '') = '' AND {_any('lower(title)', NOISE)}, false)"
_FLAT = f"trim(regexp_replace(body, '[\\s{_WS}]+', ' ', 'g'))"

SQL = {
    "not_only_topic": "SELECT id FROM intel_documents WHERE tech_directions <> ['agents']",
    "due_documents": f"""SELECT d.id, v.version FROM normalized_documents d LEFT JOIN (SELECT document_id, max(dedupe_version) AS version FROM dedup_decisions GROUP BY 1) v ON v.document_id = d.id
WHERE v.version IS DISTINCT FROM '{VERSION}'""",
    "unpaired_documents": """WITH l AS (SELECT * FROM dedup_decisions WHERE near_dup_of IS NOT NULL),
m AS (SELECT id, NOT EXISTS (SELECT 1 FROM l WHERE l.document_id = d.id) AS no_repeat, NOT EXISTS (SELECT 1 FROM l WHERE l.near_dup_of = d.id) AS no_original FROM normalized_documents d)
SELECT * FROM m WHERE no_repeat OR no_original""",
    "withdrawn_before": f"""SELECT id FROM normalized_documents WHERE (endpoint_id, raw_item_native_id) IN
(SELECT (endpoint_id, trim(native_id, '{_WS}')) FROM raw_items WHERE lower(trim(operation)) = 'withdraw' AND native_id IS NOT NULL)""",
    "stale_endpoints": f"SELECT id, status FROM source_endpoints WHERE NOT (enabled AND last_success_at >= TIMESTAMP '{STALE_BEFORE}')",
    "unknown_sources": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM mix_targets t WHERE t.source = d.source AND target_share >= 0.1)",
    "noise_and_follow": f"""SELECT id, {_NOISE} AS noise, coalesce(parse_quality, 0) >= {LEAST}
  AND {_any("lower(concat_ws(' ', title, body))", FOLLOW)} AS followed FROM intel_documents""",
    "hotspots": f"""WITH s AS (SELECT dedupe_component_id, count(DISTINCT source_id) AS sources, count(*) AS members, max(fetched_at) AS last_at FROM intel_documents WHERE dedupe_component_id IS NOT NULL GROUP BY 1),
f AS (SELECT *, row_number() OVER (PARTITION BY dedupe_component_id ORDER BY fetched_at NULLS LAST, id) AS n FROM intel_documents WHERE dedupe_component_id IS NOT NULL)
SELECT dedupe_component_id, id, title, sources, members, last_at FROM f JOIN s USING (dedupe_component_id) WHERE n = 1 AND NOT {_NOISE}
ORDER BY sources DESC, members DESC, last_at DESC NULLS LAST, id LIMIT 20""",
    "module_timeline": f"""WITH d AS (SELECT e.connector, (fetched_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai')::DATE::VARCHAR AS day, i.id, fetched_at, {_FLAT} AS flat, trim(title, '{_WS}') AS t
  FROM intel_documents i JOIN source_endpoints e ON e.id = i.endpoint_id WHERE fetched_at IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY connector, day ORDER BY fetched_at DESC, id DESC) AS rank FROM d)
SELECT connector, day, rank, id, CASE WHEN flat <> '' AND flat IS DISTINCT FROM t THEN rtrim(substr(flat, 1, 120), ' ') END AS summary FROM r WHERE rank <= 5""",
    "usage_sums": "SELECT event_type, sum(coalesce(TRY_CAST(props->>'$.k' AS BIGINT), 0))::BIGINT AS k, count(TRY_CAST(props->>'$.k' AS BIGINT)) AS known FROM events GROUP BY 1",
    "group_fingerprints": """WITH d AS (SELECT DISTINCT source_id, sha256(concat_ws('|', id, status)) AS d FROM source_endpoints)
SELECT source_id, sha256(string_agg(d, chr(10) ORDER BY d)) AS fingerprint, count(*) AS members FROM d GROUP BY 1""",
    "current_revisions": f"""SELECT id, lead(id) OVER (PARTITION BY endpoint_id, trim(native_id, '{_WS}') ORDER BY fetched_at NULLS FIRST, id) AS superseded_by
FROM raw_items WHERE trim(native_id, '{_WS}') <> ''""",
}
