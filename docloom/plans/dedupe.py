"""Queries over duplicate edges, components, decisions and candidate assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signatures
from ..operators import dedupe
from ..operators.graph import connected_components
from ..session import cut, table
from .texts import _SQ, _WS, FOLD, SIGNATURE_SQL


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "intel_documents")


def exact_content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose squeezed text is equal: group size and the smallest id, per document."""
    from ..functions.text import blank, squeeze

    docs = table(spark, sf_dir, "documents").filter(~blank(F.col("text"))).select("doc_id", F.sha2(squeeze(F.col("text")), 256).alias("digest"))
    groups = docs.groupBy("digest").agg(F.min("doc_id").alias("master_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return docs.join(groups, "digest").select("doc_id", "master_id", "copies")


def components_from_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "dedup_decisions").select(F.col("document_id").alias("a"), F.col("near_dup_of").alias("b"))
    return connected_components(links)


def exact_title_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the exact-title generator."""
    return connected_components(dedupe.exact_title_edges(cut(dedupe.prepared(_docs(spark, sf_dir)))))


def dedupe_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.deduplicate(_docs(spark, sf_dir))


def _signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = signatures.with_signature(_docs(spark, sf_dir).select("id", F.col("published_at").alias("at"), "title", "body"), "title", "body").drop("title", "body")
    bands = F.concat(signatures.simhash_bands(F.col("simhash")), signatures.minhash_bands(F.col("minhash")))
    return docs.select("id", "at", bands.alias("bands"), "blocking", "simhash", "minhash")


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(_signatures(spark, sf_dir))


def lsh_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.candidate_pairs(_signatures(spark, sf_dir))


def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each index token, and whether the token may generate candidates."""
    tokens = _signed(spark, sf_dir).select(F.explode(F.array_distinct(F.concat("bands", "blocking"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("documents")).withColumn("usable", F.col("documents") <= dedupe.BUCKET)


def assessed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all candidate pairs.

    A side of a pair is kept small: addresses and contents, which are only compared,
    are the smallest id that has the same, hashes are numbers. Joins are merges: the
    planner's estimates of these tables are far too small to broadcast by.
    """
    signed = _signed(spark, sf_dir)
    docs = cut(dedupe.prepared(_docs(spark, sf_dir)).select("id", "at", "url", "folded", "content", "ids"))
    hashes = F.transform("minhash", lambda h: F.conv(h, 16, -10).cast("bigint")).alias("minhash")
    keys = docs.join(signed.select("id", "simhash", hashes).hint("merge"), "id")
    for key in ("url", "content"):
        first = docs.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("first"))
        keys = keys.join(first.hint("merge"), key, "left").withColumn(key, F.col("first")).drop("first")
    keys = cut(keys)
    side = lambda p, k: keys.select(F.col("id").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in ("at", "url", "folded", "content", "ids", "simhash", "minhash"))).hint("merge")
    candidates = dedupe.candidate_pairs(signed).select("a", "b").unionByName(dedupe.exact_pairs(docs)).repartition("a").distinct()
    pairs = candidates.join(side("l", "a"), "a").join(side("r", "b"), "b")
    pairs = pairs.withColumn("distance", signatures.simhash_distance(F.col("l_simhash"), F.col("r_simhash"))).withColumn("minhash", signatures.minhash_similarity(F.col("l_minhash"), F.col("r_minhash")))
    return dedupe.assess(pairs)


QUERIES = {
    f.__name__: f
    for f in (exact_content_dedupe, components_from_decisions, exact_title_edges, dedupe_decisions, lsh_candidate_pairs, token_buckets, assessed_pairs)
}

_TOKENS = f"""
WITH g AS ({SIGNATURE_SQL}),
t AS (SELECT DISTINCT g.id, published_at AS at, unnest(list_concat(string_split(simhash_bands, ' '), string_split(minhash_bands, ' '), string_split(blocking, ' '))) AS token FROM g JOIN intel_documents USING (id)),
n AS (SELECT * FROM t WHERE token <> '')"""

SQL = {
    "exact_content_dedupe": f"""
WITH d AS (SELECT doc_id, sha256({_SQ.format("text")}) AS digest FROM documents WHERE coalesce(trim(text, '{_WS}'), '') <> ''),
g AS (SELECT digest, min(doc_id) AS master_id, count(*) AS copies FROM d GROUP BY digest HAVING count(*) > 1)
SELECT doc_id, master_id, copies FROM d JOIN g USING (digest)""",
    "components_from_decisions": """
WITH RECURSIVE e AS (
  SELECT document_id AS a, near_dup_of AS b FROM dedup_decisions WHERE near_dup_of <> document_id
  UNION SELECT near_dup_of, document_id FROM dedup_decisions WHERE near_dup_of <> document_id
), r AS (SELECT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT v AS node, min(u) AS component FROM r GROUP BY v""",
    "exact_title_edges": f"""
WITH RECURSIVE d AS (
  SELECT id, published_at AS at, replace({FOLD.format("title")}, ' ', '') AS compact,
    list_distinct(list_filter(list_transform(coalesce(identifiers['cve'], []), lambda x: upper(x)), lambda x: regexp_full_match(x, 'CVE-[0-9]{{4}}-[0-9]{{4,19}}'))) AS ids
  FROM intel_documents
), p AS (
  SELECT l.id AS a, r.id AS b FROM d l JOIN d r ON l.compact = r.compact AND l.id <> r.id
  WHERE length(l.compact) >= 20 AND (len(l.ids) = 0 OR len(r.ids) = 0 OR list_has_any(l.ids, r.ids))
    AND coalesce(abs(epoch_us(l.at) - epoch_us(r.at)) <= 30 * 86400000000, true)
), r AS (SELECT a AS v, a AS u FROM p UNION SELECT r.v, p.b FROM r JOIN p ON r.u = p.a)
SELECT v AS node, min(u) AS component FROM r GROUP BY v""",
    "lsh_candidate_pairs": f"""{_TOKENS},
c AS (SELECT token FROM n GROUP BY token HAVING count(*) BETWEEN 2 AND 100)
SELECT l.id AS a, r.id AS b, count(*) FILTER (regexp_matches(l.token, '^(sim|min):')) AS bands, count(*) FILTER (NOT regexp_matches(l.token, '^(sim|min):')) AS lexical
FROM n l JOIN c ON c.token = l.token JOIN n r ON r.token = l.token AND l.id < r.id
WHERE coalesce(abs(epoch_us(l.at) - epoch_us(r.at)) <= 30 * 86400000000, true)
GROUP BY ALL HAVING bands >= 1 OR lexical >= 2""",
    "token_buckets": f"{_TOKENS} SELECT token, count(*) AS documents, count(*) <= 100 AS usable FROM n GROUP BY token",
}
