"""Queries over event keys, drafts, versions, snapshots, relations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events, semantic
from ..session import cut, table
from .texts import _SQ, _WS


#: Blocks of vectors that a set of queries is compared with.
BLOCKS = 64


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intel_documents")


def _decisions(docs: DataFrame) -> DataFrame:
    """Decisions as the stored duplicate groups give them."""
    masters = docs.filter("dedupe_component_id IS NOT NULL").groupBy("dedupe_component_id").agg(F.min("id").alias("master"))
    linked = docs.join(masters, "dedupe_component_id", "left")
    return linked.select(F.col("id").alias("document_id"), F.when(F.col("id") != F.col("master"), F.col("master")).alias("near_dup_of"), F.lit("group").alias("duplicate_kind"))


def _vulnerability_feed():
    return F.col("endpoint_id").endswith("-vuln")


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    return docs, events.memberships(docs, _decisions(docs), _vulnerability_feed())


def strong_event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = events.strong_keys(F.col("identifiers"), F.col("canonical_url"), _vulnerability_feed())
    return _docs(spark, sf_dir).select("id", F.explode(keys).alias("fingerprint"))


def event_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)[1]


def event_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, members = _members(spark, sf_dir)
    return events.event_drafts(docs, cut(members))


def daily_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.daily_snapshot(event_drafts(spark, sf_dir), 20).select(F.col("day").cast("string").alias("day"), "rank", "fingerprint", "score")


def mode_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).filter("dedupe_component_id IS NOT NULL")
    return events.mode_first_seen(rows, ["dedupe_component_id"], "event_type", "id", "event_type")


def reconcile_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History's state of each endpoint's titles against all batches': what a sync would create, update or supersede."""
    docs = table(spark, sf_dir, "normalized_documents")
    state = lambda d: d.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n"), F.max("parse_quality").alias("quality"))
    return events.reconcile(state(docs.filter("batch_no <= 4")), state(docs.filter("batch_no = 0 OR batch_no > 2")), "canonical_url", ["n", "quality"])


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_items").filter("native_id IS NOT NULL").select(F.concat_ws("/", "endpoint_id", "native_id").alias("record"), F.col("id").alias("version"), "content_hash", "operation", "stage")
    return events.version_diffs(rows, "record", "version", ["content_hash", "operation", "stage"]).select("record", "version", F.array_join("changed", ",").alias("changed"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "raw_items").filter("native_id IS NOT NULL").select(F.concat_ws("/", "endpoint_id", "native_id").alias("record"), "id", "content_hash")
    return events.revisions(rows, "record", "id", "content_hash")


def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dedup_decisions").select("document_id", "id", "dedupe_version", "deduped_at")
    latest = events.as_of(rows, ["document_id"], "deduped_at", F.lit("2026-11-01 00:00:00").cast("timestamp_ntz"))
    return latest.select("document_id", "dedupe_version", "deduped_at")


def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error of a user with the value of the user's last click before it."""
    rows = table(spark, sf_dir, "events")
    left, right = rows.filter("event_type = 'error'").select("event_id", "user_id", "ts"), rows.filter("event_type = 'click'").select("user_id", "ts", "value")
    return events.as_of_join(left, right, ["user_id"], "ts", "ts", ["value"])


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.col("id").alias("atomic_id"), F.coalesce("dedupe_component_id", -F.col("id")).alias("document_id"), F.col("title").alias("entity"))


def entity_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.shared_entity_pairs(_mentions(spark, sf_dir))


def entity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates without the window, as classes and their members."""
    return semantic.shared_entity_classes(_mentions(spark, sf_dir))


def relation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    side = lambda p, k: docs.select(F.col("id").alias(k), F.sha2(F.coalesce("event_type", F.lit("")), 256).alias(f"{p}_fingerprint"), F.coalesce("dedupe_component_id", -F.col("id")).alias(f"{p}_document_id"), F.col("published_at").alias(f"{p}_at"))
    pairs = entity_candidates(spark, sf_dir).join(side("l", "left_id"), "left_id").join(side("r", "right_id"), "right_id")
    return semantic.adjudicate(pairs)


def claim_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).filter("event_type IS NOT NULL")
    claims = docs.select(F.col("source_id"), F.lit("type").alias("claim_type"), F.col("event_type").alias("value"), F.col("title").alias("text"), F.col("id").alias("document_id"), F.when(F.col("parse_quality").between(0, 1), F.col("parse_quality")).otherwise(0.0).alias("confidence"))
    merged = semantic.merge_claims(claims, ["source_id"])
    return merged.select("source_id", "value", "text", F.size("documents").alias("documents"), "confidence")


def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "normalized_documents")
    values = docs.select("endpoint_id", F.lit("published").alias("claim_type"), (F.col("record_status") == "published").cast("string").alias("value"))
    return semantic.contradictions(values, ["endpoint_id"])


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar of all vectors for every query vector (ids divisible by 100)."""
    from pyspark.sql import Window

    # the vectors stay where they are, in blocks; each block keeps its ten best of every query before they meet
    rows = table(spark, sf_dir, "embeddings").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(BLOCKS)))
    asked = rows.filter("vec_id % 100 = 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    pairs = asked.alias("q").join(rows.alias("v"), "block").filter((F.size("q.embedding") == F.size("v.embedding")) & (F.col("q.vec_id") != F.col("v.vec_id")))
    scored = pairs.select("block", F.col("q.vec_id").alias("query_id"), F.col("v.vec_id").alias("vec_id"), F.round(semantic.cosine(F.col("q.embedding"), F.col("v.embedding")), 6).alias("similarity"))
    best = [F.row_number().over(Window.partitionBy(*by, "query_id").orderBy(F.col("similarity").desc(), "vec_id")) for by in (["block"], [])]
    near = scored.withColumn("rank", best[0]).filter("rank <= 10").drop("rank")
    return near.drop("block").withColumn("rank", best[1]).filter("rank <= 10")


def vector_recall_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "atomic_event_embeddings").filter("size(vector) = dimensions AND NOT exists(vector, x -> x IS NULL OR isnan(x) OR abs(x) = float('Infinity'))")
    pool = rows.select("id", F.concat_ws("/", "execution_version", "dimensions").alias("space"), F.col("created_at").alias("at"), "vector")
    return semantic.recall_in_window(pool.filter("id % 100 = 0"), pool)


QUERIES = {
    f.__name__: f
    for f in (
        strong_event_keys, event_memberships, event_drafts, daily_snapshot, mode_event_type, reconcile_batches, version_diff, revisions, snapshot_as_of,
        as_of_join, entity_candidates, entity_classes, relation_verdicts, claim_merge, claim_conflicts, cosine_topk, vector_recall_window,
    )
}

_CVES = "list_sort(list_distinct(list_filter(list_transform(coalesce(identifiers['cve'], []), lambda x: upper(x)), lambda x: regexp_full_match(x, 'CVE-[0-9]{4}-[0-9]{4,19}'))))"
_KEYS = f"list_transform({_CVES}, lambda v: CASE WHEN endpoint_id LIKE '%-vuln' THEN 'cve-nvd:' ELSE 'cve:' END || v)"
_MEMBERS = f"""
d AS (SELECT *, {_KEYS} AS own, coalesce(min(id) OVER (PARTITION BY dedupe_component_id), id) AS m FROM intel_documents),
d2 AS (SELECT *, CASE WHEN dedupe_component_id IS NULL THEN id ELSE m END AS component FROM d),
k AS (SELECT DISTINCT component, unnest(own) AS key FROM d2),
kn AS (SELECT component, count(*) AS n FROM k GROUP BY component),
mem AS (
  SELECT id, component, own, dedupe_component_id, key FROM d2 JOIN k USING (component) JOIN kn USING (component) WHERE n <= 20
  UNION ALL SELECT id, component, own, dedupe_component_id, unnest(CASE WHEN len(own) > 0 THEN own ELSE ['document:' || id] END) FROM d2 JOIN kn USING (component) WHERE n > 20
  UNION ALL SELECT id, component, own, dedupe_component_id, 'document:' || component FROM d2 WHERE component NOT IN (SELECT component FROM kn)
),
members AS (SELECT key AS fingerprint, split_part(key, ':', 1) AS kind, id AS document_id,
  CASE WHEN list_contains(own, key) THEN 'identifier:' || split_part(key, ':', 1) ELSE 'group' END AS reason FROM mem)"""
_DRAFTS = f"""
{_MEMBERS},
x AS (SELECT m.fingerprint, m.kind, i.*, CASE trust_tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 ELSE 3 END AS tier,
  CASE WHEN parse_quality >= 0 AND parse_quality <= 1 THEN parse_quality ELSE 0 END AS q, {_SQ.format("body")} AS flat FROM members m JOIN intel_documents i ON i.id = m.document_id),
o AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY tier, q DESC, coalesce(length(body), 0) DESC, coalesce(length(title), 0) DESC, id) AS n FROM x),
ty AS (SELECT fingerprint, event_type, row_number() OVER (PARTITION BY fingerprint ORDER BY count(*) DESC, min(id)) AS n FROM x WHERE event_type IS NOT NULL GROUP BY fingerprint, event_type),
tp AS (SELECT fingerprint, topic, row_number() OVER (PARTITION BY fingerprint ORDER BY count(*) DESC, topic) AS n FROM (SELECT fingerprint, unnest(tech_directions) AS topic FROM x) WHERE topic <> 'cve' GROUP BY fingerprint, topic),
a AS (SELECT fingerprint, kind, min(tier) AS tier, count(DISTINCT coalesce(source_family, source_id)) AS families, max(q) AS q,
  min(coalesce(published_at, fetched_at)) AS first_seen_at, max(coalesce(published_at, fetched_at)) AS last_seen_at, count(*) AS documents FROM x GROUP BY ALL),
drafts AS (SELECT a.fingerprint, CASE WHEN a.kind LIKE 'cve%' THEN 'vulnerability' ELSE ty.event_type END AS event_type,
  CASE WHEN a.kind LIKE 'cve%' THEN 'cve' ELSE tp.topic END AS topic, CASE WHEN a.kind = 'cve-nvd' THEN 'vuln_db' ELSE 'general' END AS category,
  substr(trim(o.title, '{_WS}'), 1, 240) AS title, CASE WHEN flat <> '' AND flat IS DISTINCT FROM trim(o.title, '{_WS}') THEN rtrim(substr(flat, 1, 600), ' ') END AS summary,
  least(100, [40, 28, 15, 10][a.tier + 1] + CASE WHEN a.kind LIKE 'cve%' THEN 25 ELSE 5 END + least(20, (families - 1) * 7) + round_even(a.q * 15, 0)::INT)::INT AS score,
  ['A', 'B', 'C', 'other'][a.tier + 1] AS evidence_level, first_seen_at, last_seen_at, documents
  FROM a JOIN o ON o.fingerprint = a.fingerprint AND o.n = 1 LEFT JOIN ty ON ty.fingerprint = a.fingerprint AND ty.n = 1 LEFT JOIN tp ON tp.fingerprint = a.fingerprint AND tp.n = 1)"""
_RECORDS = "SELECT endpoint_id || '/' || native_id AS record, id AS version, content_hash, operation, stage FROM raw_items WHERE native_id IS NOT NULL"
_PAIRS = f"""
m AS (SELECT DISTINCT id AS atomic_id, coalesce(dedupe_component_id, -id) AS document_id, title AS entity FROM intel_documents),
p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY atomic_id) AS n FROM m),
pairs AS (SELECT l.atomic_id AS left_id, r.atomic_id AS right_id, min(entity) AS shared FROM p l JOIN p r USING (entity)
  WHERE l.n < r.n AND r.n - l.n <= 100 AND l.document_id <> r.document_id GROUP BY ALL)"""

SQL = {
    "strong_event_keys": f"SELECT id, unnest({_KEYS}) AS fingerprint FROM intel_documents",
    "event_memberships": f"WITH {_MEMBERS} SELECT DISTINCT * FROM members",
    "event_drafts": f"WITH {_DRAFTS} SELECT * FROM drafts",
    "daily_snapshot": f"""WITH {_DRAFTS}, r AS (SELECT (last_seen_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai')::DATE::VARCHAR AS day, fingerprint, score, last_seen_at FROM drafts WHERE last_seen_at IS NOT NULL),
n AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY score DESC, last_seen_at DESC, fingerprint DESC) AS rank, fingerprint, score FROM r)
SELECT * FROM n WHERE rank <= 20""",
    "mode_event_type": """
WITH c AS (SELECT dedupe_component_id, event_type, row_number() OVER (PARTITION BY dedupe_component_id ORDER BY count(*) DESC, min(id)) AS n
  FROM intel_documents WHERE dedupe_component_id IS NOT NULL AND event_type IS NOT NULL GROUP BY dedupe_component_id, event_type)
SELECT dedupe_component_id, event_type FROM c WHERE n = 1""",
    "reconcile_batches": """
WITH o AS (SELECT canonical_url, count(*) AS n, max(parse_quality) AS quality FROM normalized_documents WHERE batch_no <= 4 GROUP BY 1),
w AS (SELECT canonical_url, count(*) AS n, max(parse_quality) AS quality FROM normalized_documents WHERE batch_no = 0 OR batch_no > 2 GROUP BY 1)
SELECT coalesce(o.canonical_url, w.canonical_url) AS canonical_url, CASE WHEN o.canonical_url IS NULL THEN 'create' WHEN w.canonical_url IS NULL THEN 'supersede'
  WHEN o.n = w.n AND o.quality IS NOT DISTINCT FROM w.quality THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN w ON o.canonical_url = w.canonical_url""",
    "version_diff": f"""
WITH v AS ({_RECORDS}), l AS (SELECT *, row_number() OVER w AS n, lag(content_hash) OVER w AS c, lag(operation) OVER w AS o, lag(stage) OVER w AS s FROM v WINDOW w AS (PARTITION BY record ORDER BY version))
SELECT record, version, array_to_string(list_filter([CASE WHEN n = 1 OR c IS DISTINCT FROM content_hash THEN 'content_hash' END, CASE WHEN n = 1 OR o IS DISTINCT FROM operation THEN 'operation' END,
  CASE WHEN n = 1 OR s IS DISTINCT FROM stage THEN 'stage' END], lambda x: x IS NOT NULL), ',') AS changed FROM l""",
    "revisions": f"""
WITH v AS ({_RECORDS}), l AS (SELECT record, version AS id, content_hash, lag(content_hash) OVER (PARTITION BY record ORDER BY version) AS c FROM v)
SELECT record, id, content_hash, row_number() OVER (PARTITION BY record ORDER BY id) AS revision FROM l WHERE content_hash IS DISTINCT FROM c""",
    "snapshot_as_of": """
WITH r AS (SELECT document_id, dedupe_version, deduped_at, row_number() OVER (PARTITION BY document_id ORDER BY deduped_at DESC, id DESC) AS n FROM dedup_decisions WHERE deduped_at <= TIMESTAMP '2026-11-01 00:00:00')
SELECT document_id, dedupe_version, deduped_at FROM r WHERE n = 1""",
    "as_of_join": """
SELECT e.event_id, e.user_id, e.ts, c.value FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON e.user_id = c.user_id AND e.ts >= c.ts""",
    "entity_candidates": f"WITH {_PAIRS} SELECT * FROM pairs",
    "entity_classes": """
WITH m AS (SELECT DISTINCT id AS atomic_id, coalesce(dedupe_component_id, -id) AS document_id, title AS entity FROM intel_documents WHERE title IS NOT NULL)
SELECT entity, document_id, min(atomic_id) OVER (PARTITION BY entity, document_id) AS representative, atomic_id FROM m
WHERE entity IN (SELECT entity FROM m GROUP BY entity HAVING count(DISTINCT document_id) > 1)""",
    "relation_verdicts": f"""
WITH {_PAIRS}
SELECT left_id, right_id, CASE WHEN coalesce(l.event_type, '') = coalesce(r.event_type, '') THEN 'same_event' WHEN near THEN 'related_event' ELSE 'different_event' END AS decision,
  CASE WHEN coalesce(l.event_type, '') = coalesce(r.event_type, '') THEN 0.95 WHEN near THEN 0.7 ELSE 0.6 END::DOUBLE AS confidence,
  CASE WHEN coalesce(l.event_type, '') = coalesce(r.event_type, '') THEN 'identical_atomic_fingerprint' WHEN near THEN 'shared_entity_and_time' ELSE 'no_supporting_signal' END AS reason
FROM (SELECT p.*, coalesce(abs(epoch_us(l.published_at) - epoch_us(r.published_at)) <= 30 * 86400000000, false) AS near FROM pairs p JOIN intel_documents l ON l.id = left_id JOIN intel_documents r ON r.id = right_id) q
JOIN intel_documents l ON l.id = left_id JOIN intel_documents r ON r.id = right_id""",
    "claim_merge": """
WITH c AS (SELECT source_id, event_type AS value, title AS text, id, CASE WHEN parse_quality >= 0 AND parse_quality <= 1 THEN parse_quality ELSE 0 END AS confidence FROM intel_documents WHERE event_type IS NOT NULL)
SELECT source_id, value, arg_max(text, (confidence, -id)) AS text, count(DISTINCT id) AS documents, floor(avg(confidence) * 1000 + 0.5 + 1e-9) / 1000 AS confidence FROM c GROUP BY source_id, value""",
    "claim_conflicts": """
SELECT endpoint_id, 'published' AS claim_type, 'false' AS left_value, 'true' AS right_value FROM normalized_documents GROUP BY endpoint_id
HAVING count(*) FILTER (record_status = 'published') > 0 AND count(*) FILTER (record_status <> 'published') > 0""",
    "cosine_topk": """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""",
    "vector_recall_window": """
WITH e AS (SELECT id, execution_version, dimensions, created_at, vector::DOUBLE[] AS v FROM atomic_event_embeddings WHERE len(vector) = dimensions AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS seed_id, b.id, CASE WHEN list_sum(list_transform(a.v, lambda x: x * x)) > 0 AND list_sum(list_transform(b.v, lambda x: x * x)) > 0 THEN round(list_cosine_similarity(a.v, b.v), 6) ELSE -1 END AS similarity
  FROM e a JOIN e b ON a.execution_version = b.execution_version AND a.dimensions = b.dimensions AND b.id < a.id AND abs(epoch_us(a.created_at) - epoch_us(b.created_at)) <= 30 * 86400000000 WHERE a.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY similarity DESC, id) AS n FROM s)
SELECT seed_id, id, similarity FROM r WHERE n <= 10 AND similarity >= 0.82""",
}
