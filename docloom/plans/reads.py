"""Read queries: joins, filters, aggregates, windows, pages, set operations, labels, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators import reads
from ..session import table
from .texts import _WS

#: Parameters of the labelling queries: any vocabulary of labels and aliases can be given.
DIRECTIONS = {
    "agents": ["agent runtime", "tool manifest", "智能体", "代理运行时", "Agenten"],
    "supply-chain": ["package mirror", "container registry", "供应链", "Lieferketten"],
    "models": ["model gateway", "weight archive", "模型网关", "Modellgewichte"],
}
TYPES = {"vulnerability": ["CVE", "漏洞"], "incident": ["leaked", "泄露"], "release": ["Upgrade", "版本", "Version"]}


def _t(name: str):
    return lambda spark, sf_dir: table(spark, sf_dir, name)


_norm, _intel, _raw, _ends = (_t(n) for n in ("normalized_documents", "intel_documents", "raw_items", "source_endpoints"))


def star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current documents with their latest raw item's stage and their endpoint's source and tier."""
    from ..functions.text import strip

    latest = _raw(spark, sf_dir).select("endpoint_id", strip(F.col("native_id")).alias("native_id"), "id", "stage").filter("native_id IS NOT NULL")
    latest = latest.groupBy("endpoint_id", "native_id").agg(F.max_by("stage", "id").alias("stage"))
    docs = reads.current(_norm(spark, sf_dir)).select("id", "endpoint_id", F.col("raw_item_native_id").alias("native_id"), "record_status")
    joined = docs.join(latest, ["endpoint_id", "native_id"])
    return reads.with_endpoint(joined, _ends(spark, sf_dir), ["source_id", "trust_tier", "connector"]).select("id", "endpoint_id", "native_id", "stage", "source_id", "trust_tier", "connector")


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose raw item is unknown."""
    from ..functions.text import strip

    known = _raw(spark, sf_dir).select("endpoint_id", strip(F.col("native_id")).alias("raw_item_native_id")).distinct()
    return _norm(spark, sf_dir).join(known, ["endpoint_id", "raw_item_native_id"], "left_anti").select("id")


def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reads.current(_norm(spark, sf_dir)).select("id", "endpoint_id", "title_original", "fetched_at")
    return reads.feed_page(docs, "fetched_at", "id", 50, ("2026-01-01 00:00:00", 0))


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reads.search(reads.current(_norm(spark, sf_dir)), "review", ["title_original", "body_text"])
    return reads.page(found, [F.col("fetched_at").desc_nulls_last(), F.col("id").desc()], 10, 20).select("id", "title_original")


def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.search(_norm(spark, sf_dir), "100%_\\x", ["body_text"]).agg(F.count(F.lit(1)).alias("total")).unionByName(
        reads.search(_norm(spark, sf_dir), "REVIEW", ["body_text"]).agg(F.count(F.lit(1)).alias("total"))
    )


def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reads.with_endpoint(_intel(spark, sf_dir).drop("trust_tier"), _ends(spark, sf_dir), ["connector"])
    keep = F.array_contains("tech_directions", "agents") & reads.in_scope(F.col("endpoint_id"), F.col("connector"), "general") & F.col("event_type").isin("news", "incident")
    return docs.filter(keep).groupBy("connector", "event_type").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source_id").alias("sources"))


def stats_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda df, kind, c: df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    return (
        count(_raw(spark, sf_dir), "stage", "stage")
        .unionByName(count(_norm(spark, sf_dir), "record_status", "record_status"))
        .unionByName(count(_ends(spark, sf_dir), "endpoint", "status"))
        .unionByName(count(_intel(spark, sf_dir), "event_type", "event_type"))
    )


def top_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reads.current(_norm(spark, sf_dir))
    return reads.top_per_group(docs, ["endpoint_id"], [F.col("fetched_at").desc_nulls_last(), F.col("id").desc()], 5).select("endpoint_id", "rank", "id")


def event_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _intel(spark, sf_dir).filter("dedupe_component_id IS NOT NULL").groupBy("dedupe_component_id").agg(
        F.min("fetched_at").alias("first_at"), F.max("fetched_at").alias("last_at"), F.count_distinct("source_id").alias("sources")
    )
    since, until = (F.lit(t).cast("timestamp_ntz") for t in ("2025-03-01 00:00:00", "2025-09-01 00:00:00"))
    return reads.overlapping(spans, "first_at", "last_at", since, until)


def sample_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.round_robin(table(spark, sf_dir, "documents"), "source", "doc_id", 100, "s").select("doc_id", "source", "turn")


def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return docs.select("doc_id", F.array_join(reads.label_by_aliases(F.col("text"), DIRECTIONS), ",").alias("directions"), reads.first_matching(F.col("text"), TYPES, "opinion").alias("event_type"))


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older matcher's scores of 0.9 and more against its exact kinds."""
    pairs = table(spark, sf_dir, "dedup_decisions").filter("near_dup_of IS NOT NULL AND duplicate_score IS NOT NULL")
    return reads.binary_metrics(pairs, F.col("duplicate_score") >= 0.96, F.col("duplicate_kind").startswith("exact"))


def quality_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio breakdown: documents, share with a body, share of long ones."""
    docs = _norm(spark, sf_dir)
    has = (~blank(F.col("body_text"))).cast("int")
    return docs.groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg(has), 6).alias("with_body"), F.round(F.avg(F.coalesce((F.char_length("body_text") >= 600).cast("int"), F.lit(0))), 6).alias("long_body"))


def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native ids by how two halves of the feed hold them: snapshot differences and intersection."""
    rows = _raw(spark, sf_dir).filter("native_id IS NOT NULL")
    old, new = rows.filter("fetched_at < timestamp_ntz'2025-06-01 00:00:00'").select("endpoint_id", "native_id"), rows.filter("fetched_at >= timestamp_ntz'2025-06-01 00:00:00'").select("endpoint_id", "native_id")
    tag = lambda df, t: df.distinct().withColumn("held", F.lit(t))
    both = tag(old.intersect(new), "both")
    gone = tag(old.join(new.distinct(), ["endpoint_id", "native_id"], "left_anti"), "withdrawn")
    return both.unionByName(gone).unionByName(tag(new.join(old.distinct(), ["endpoint_id", "native_id"], "left_anti"), "fresh"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native extra over the event table: gap sessions of 30 minutes."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    grouped = rows.groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return grouped.select("user_id", F.unix_micros("w.start").alias("start_us"), "n", "value")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native extra over the event table: hourly counts by type, with a key of the JSON properties."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return rows.groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("max_k"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, filter and partial aggregation over the star schema."""
    rows = table(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


def region_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-way star join and aggregate."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


QUERIES = {
    f.__name__: f
    for f in (
        star_join, orphans, feed_page, search_page, search_total, facets, stats_by_status, top_per_source, event_overlap, sample_round_robin, rule_labels,
        binary_metrics, quality_by_source, set_algebra, sessions, tumbling, pricing_summary, region_revenue,
    )
}


def _alias_sql(words: list[str]) -> str:
    """RE2 has no look-around: whole words by explicit boundaries."""
    import re

    edge = "[^\\p{L}\\p{M}\\p{N}_-]"
    return "|".join(w if re.search("[㐀-鿿]", w) else f"(?:^|{edge}){w}(?:$|{edge})" for w in words)


_LABELS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){_alias_sql(w)}') THEN '{k}' END" for k, w in DIRECTIONS.items())
_TYPE = " ".join(f"WHEN regexp_matches(text, '(?i){_alias_sql(w)}') THEN '{k}'" for k, w in TYPES.items())
_CURRENT = "record_status NOT IN ('rejected', 'withdrawn')"

SQL = {
    "star_join": f"""
WITH r AS (SELECT endpoint_id, trim(native_id, '{_WS}') AS native_id, arg_max(stage, id) AS stage FROM raw_items WHERE native_id IS NOT NULL GROUP BY ALL)
SELECT d.id, d.endpoint_id, r.native_id, stage, e.source_id, e.trust_tier, e.connector FROM normalized_documents d
JOIN r ON r.endpoint_id = d.endpoint_id AND r.native_id = d.raw_item_native_id JOIN source_endpoints e ON e.id = d.endpoint_id WHERE {_CURRENT}""",
    "orphans": f"""SELECT id FROM normalized_documents d WHERE NOT EXISTS
(SELECT 1 FROM raw_items r WHERE r.endpoint_id = d.endpoint_id AND trim(r.native_id, '{_WS}') = d.raw_item_native_id)""",
    "feed_page": f"SELECT id, endpoint_id, title_original, fetched_at FROM normalized_documents WHERE {_CURRENT} AND fetched_at < TIMESTAMP '2026-01-01' ORDER BY fetched_at DESC NULLS LAST, id DESC LIMIT 51",
    "search_page": f"""SELECT id, title_original FROM normalized_documents WHERE {_CURRENT} AND (title_original ILIKE '%review%' OR body_text ILIKE '%review%')
ORDER BY fetched_at DESC NULLS LAST, id DESC LIMIT 20 OFFSET 10""",
    "search_total": r"""SELECT count(*) AS total FROM normalized_documents WHERE contains(body_text, '100%_\x') UNION ALL SELECT count(*) FROM normalized_documents WHERE contains(lower(body_text), 'review')""",
    "facets": """SELECT e.connector, i.event_type, count(*) AS documents, count(DISTINCT i.source_id) AS sources FROM intel_documents i JOIN source_endpoints e ON e.id = i.endpoint_id
WHERE list_contains(tech_directions, 'agents') AND e.connector IS DISTINCT FROM 'vuln' AND event_type IN ('news', 'incident') GROUP BY ALL""",
    "stats_by_status": """SELECT 'stage' AS kind, stage AS value, count(*) AS n FROM raw_items GROUP BY ALL UNION ALL SELECT 'record_status', record_status, count(*) FROM normalized_documents GROUP BY ALL
UNION ALL SELECT 'endpoint', status, count(*) FROM source_endpoints GROUP BY ALL UNION ALL SELECT 'event_type', event_type, count(*) FROM intel_documents GROUP BY ALL""",
    "top_per_source": f"""WITH r AS (SELECT endpoint_id, row_number() OVER (PARTITION BY endpoint_id ORDER BY fetched_at DESC NULLS LAST, id DESC) AS rank, id FROM normalized_documents WHERE {_CURRENT})
SELECT * FROM r WHERE rank <= 5""",
    "event_overlap": """WITH s AS (SELECT dedupe_component_id, min(fetched_at) AS first_at, max(fetched_at) AS last_at, count(DISTINCT source_id) AS sources FROM intel_documents WHERE dedupe_component_id IS NOT NULL GROUP BY 1)
SELECT * FROM s WHERE last_at >= TIMESTAMP '2025-03-01' AND first_at <= TIMESTAMP '2025-09-01'""",
    "sample_round_robin": """SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s' || doc_id::VARCHAR), doc_id) AS turn FROM documents)
ORDER BY turn, source NULLS FIRST, doc_id LIMIT 100""",
    "rule_labels": f"SELECT doc_id, array_to_string(list_filter([{_LABELS}], lambda x: x IS NOT NULL), ',') AS directions, CASE {_TYPE} ELSE 'opinion' END AS event_type FROM documents WHERE text IS NOT NULL",
    "binary_metrics": """WITH c AS (SELECT count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM
(SELECT duplicate_score >= 0.96 AS p, duplicate_kind LIKE 'exact%' AS a FROM dedup_decisions WHERE near_dup_of IS NOT NULL AND duplicate_score IS NOT NULL))
SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 4) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 4) END AS recall, CASE WHEN fp + tn = 0 THEN 0 ELSE round(fp / (fp + tn), 4) END AS wrong_merge_rate FROM c""",
    "quality_by_source": f"""SELECT endpoint_id, count(*) AS documents, round(avg(CASE WHEN coalesce(trim(body_text, '{_WS}'), '') <> '' THEN 1 ELSE 0 END), 6) AS with_body,
round(avg(CASE WHEN length(body_text) >= 600 THEN 1 ELSE 0 END), 6) AS long_body FROM normalized_documents GROUP BY 1""",
    "set_algebra": """WITH o AS (SELECT DISTINCT endpoint_id, native_id FROM raw_items WHERE native_id IS NOT NULL AND fetched_at < TIMESTAMP '2025-06-01'),
n AS (SELECT DISTINCT endpoint_id, native_id FROM raw_items WHERE native_id IS NOT NULL AND fetched_at >= TIMESTAMP '2025-06-01')
SELECT *, 'both' AS held FROM (FROM o INTERSECT FROM n) UNION ALL SELECT *, 'withdrawn' FROM (FROM o EXCEPT FROM n) UNION ALL SELECT *, 'fresh' FROM (FROM n EXCEPT FROM o)""",
    "sessions": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 2) AS value FROM s GROUP BY user_id, s""",
    "tumbling": "SELECT epoch_us(ts) // 3600000000 AS hour, event_type, count(*) AS n, max((props->>'$.k')::INT) AS max_k FROM events GROUP BY ALL",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "region_revenue": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
}
