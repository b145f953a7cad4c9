"""Events from duplicate components: strong keys, memberships, drafts, versions and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identity_values, strip, summary
from ..session import cut
from .dedupe import trust_rank

#: Addresses that identify a paper or a release.
ARXIV = r"(?i)arxiv\.org/(?:abs|pdf)/([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?"
RELEASE = r"(?i)github\.com/([^/]+)/([^/]+?)/releases/tag/([^/?#]+)"
#: Points for the best tier and the kind of identity, and the order topics are preferred in.
TIER_POINTS = {0: 40, 1: 28, 2: 15}
KIND_POINTS = {"cve": 25, "ghsa": 25, "cnvd": 25, "cve-nvd": 25, "github_release": 25, "incident": 25, "campaign": 25, "model_release": 20, "package_release": 20, "arxiv": 15}
TOPIC_ORDER = ("security_for_ai", "ai_for_security", "agent", "llm", "system_security")
KIND_TYPES = {
    "cve": "vulnerability", "ghsa": "vulnerability", "cnvd": "vulnerability", "cve-nvd": "vulnerability", "arxiv": "research",
    "github_release": "release", "model_release": "release", "package_release": "release", "incident": "incident", "campaign": "incident",
}
MOST_KEYS = 20
LONGEST_KEY = 160


def identity_part(text: Column) -> Column:
    """Lower case, everything outside [a-z0-9._+-] as single hyphens, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(text)), "[^a-z0-9._+-]+", "-"), "^-+|-+$", "")


def bounded_key(kind: str, *parts: Column) -> Column:
    """kind:a@b[@c]; null if a part is empty, hashed if longer than LONGEST_KEY."""
    named = [identity_part(p) for p in parts]
    whole = F.concat(F.lit(f"{kind}:"), F.concat_ws("@", *named))
    usable = F.lit(True)
    for p in named:
        usable = usable & F.coalesce(p != "", F.lit(False))
    short = F.when(F.char_length(whole) > LONGEST_KEY, F.concat(F.lit(f"{kind}:sha256:"), F.sha2(whole, 256))).otherwise(whole)
    return F.when(usable, short)


def strong_keys(identifiers: Column, url: Column, vulnerability_feed: Column) -> Column:
    """Distinct stable event keys of a document, identities before addresses."""
    cve = F.transform(identity_values(identifiers, "cve"), lambda v: F.concat(F.when(vulnerability_feed, "cve-nvd:").otherwise("cve:"), v))
    # a second parameter of the function would be the place in the array
    marked = lambda kind: F.transform(identity_values(identifiers, kind), lambda v: F.concat(F.lit(f"{kind}:"), v))
    others = [marked(kind) for kind in ("ghsa", "cnvd")]
    paper = F.regexp_extract(url, ARXIV, 1)
    release = bounded_key("github_release", *(F.regexp_extract(url, RELEASE, i) for i in (1, 2, 3)))
    addresses = F.array_compact(F.array(F.when(paper != "", F.concat(F.lit("arxiv:"), paper)), F.when(url.rlike(RELEASE), release)))
    return F.array_distinct(F.concat(cve, *others, addresses))


def memberships(documents: DataFrame, decisions: DataFrame, vulnerability_feed: Column) -> DataFrame:
    """(fingerprint, kind, document_id, reason): which documents take part in which events.

    Within a component every document joins every key, unless there are more than
    MOST_KEYS of them, when each keeps to its own; a component without keys is the
    event of its master.
    """
    keyed = documents.select("id", strong_keys(F.col("identifiers"), F.col("canonical_url"), vulnerability_feed).alias("own"))
    linked = decisions.select(F.col("document_id").alias("id"), F.coalesce("near_dup_of", "document_id").alias("component"), "duplicate_kind")
    rows = cut(keyed.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")))
    keys = rows.select("component", F.explode("own").alias("key")).distinct()
    counted = keys.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    few = keys.join(counted.filter(F.col("n") <= MOST_KEYS), "component")
    shared = rows.join(few, "component").select("id", "component", "own", "duplicate_kind", "key")
    many = rows.join(counted.filter(F.col("n") > MOST_KEYS), "component")
    alone = F.array(F.concat(F.lit("document:"), F.col("id")))
    own = many.select("id", "component", "own", "duplicate_kind", F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(alone)).alias("key"))
    none = rows.join(counted, "component", "left_anti").select("id", "component", "own", "duplicate_kind", F.concat(F.lit("document:"), F.col("component")).alias("key"))
    kind = F.substring_index("key", ":", 1)
    reason = F.when(F.array_contains("own", F.col("key")), F.concat(F.lit("identifier:"), kind)).otherwise(F.coalesce("duplicate_kind", F.lit("component")))
    return shared.unionByName(own).unionByName(none).select(F.col("key").alias("fingerprint"), kind.alias("kind"), F.col("id").alias("document_id"), reason.alias("reason")).distinct()


def mode_first_seen(rows: DataFrame, by: list[str], value: str, position: str, out: str) -> DataFrame:
    """The most frequent value of each group, ties to the one seen first; null values don't count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct(F.col("n"), (-F.col("first")))).alias(out))


def event_drafts(documents: DataFrame, members: DataFrame) -> DataFrame:
    """One row per event: type, topic, title, summary, score, best tier, observed span, size.

    Each field is an aggregate over the members, combined before the shuffle. A
    quality that is missing or not within 0 to 1 counts as 0.
    """
    usable = F.when(F.col("parse_quality").between(0, 1), F.col("parse_quality")).otherwise(0.0)
    rows = members.join(documents.withColumn("parse_quality", usable).withColumnRenamed("id", "document_id"), "document_id")
    observed = F.coalesce("published_at", "fetched_at")
    rank = F.struct(
        trust_rank(F.col("trust_tier")).alias("tier"), (-F.coalesce("parse_quality", F.lit(0.0))).alias("quality"), (-F.coalesce(F.char_length("body"), F.lit(0))).alias("body"),
        (-F.coalesce(F.char_length("title"), F.lit(0))).alias("length"), F.col("document_id"),
    )
    drafts = rows.groupBy("fingerprint", "kind").agg(
        F.min_by(F.struct(F.substring(strip(F.col("title")), 1, 240).alias("title"), summary(F.col("body"), F.col("title")).alias("summary")), rank).alias("p"),
        F.min(trust_rank(F.col("trust_tier"))).alias("tier"),
        F.count_distinct(F.coalesce("source_family", "source_id")).alias("families"),
        F.max(F.coalesce("parse_quality", F.lit(0.0))).alias("quality"),
        F.min(observed).alias("first_seen_at"),
        F.max(observed).alias("last_seen_at"),
        F.count(F.lit(1)).alias("documents"),
    )
    types = mode_first_seen(rows, ["fingerprint"], "event_type", "document_id", "mode_type")
    topic_rows = rows.select("fingerprint", F.explode("tech_directions").alias("topic")).filter("topic != 'cve'")
    place = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for i, t in enumerate(TOPIC_ORDER) for x in (t, i))), F.col("topic")), F.lit(99))
    counts = topic_rows.groupBy("fingerprint", "topic").agg(F.count(F.lit(1)).alias("n"))
    topics = counts.groupBy("fingerprint").agg(F.min(F.struct(-F.col("n"), place, "topic"))["topic"].alias("mode_topic"))
    by_kind = lambda table, default: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("kind")), default)
    points = F.when(F.col("tier") == 0, 40).when(F.col("tier") == 1, 28).when(F.col("tier") == 2, 15).otherwise(10)
    score = points + by_kind(KIND_POINTS, F.lit(5)) + F.least(F.lit(20), (F.col("families") - 1) * 7) + F.bround(F.col("quality") * 15).cast("int")
    vulnerability = F.col("kind").isin("cve", "ghsa", "cnvd", "cve-nvd")
    return (
        drafts.join(types, "fingerprint", "left").join(topics, "fingerprint", "left")
        .select(
            "fingerprint",
            by_kind(KIND_TYPES, F.col("mode_type")).alias("event_type"),
            F.when(vulnerability, "cve").otherwise(F.col("mode_topic")).alias("topic"),
            F.when(F.col("kind") == "cve-nvd", "vuln_db").otherwise("general").alias("category"),
            F.col("p.title").alias("title"), F.col("p.summary").alias("summary"),
            F.least(F.lit(100), score).cast("int").alias("score"),
            F.element_at(F.array(*(F.lit(t) for t in ("A", "B", "C", "other"))), F.col("tier") + 1).alias("evidence_level"),
            "first_seen_at", "last_seen_at", "documents",
        )
    )


def reconcile(stored: DataFrame, drafts: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, action): create, update, supersede or keep, by a full join on the key and null-safe comparison."""
    old, new = stored.alias("o"), drafts.alias("n")
    equal = F.lit(True)
    for c in compared:
        equal = equal & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    action = F.when(F.col(f"o.{key}").isNull(), "create").when(F.col(f"n.{key}").isNull(), "supersede").when(equal, "keep").otherwise("update")
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), action.alias("action"))


def version_diffs(versions: DataFrame, key: str, version: str, compared: list[str]) -> DataFrame:
    """(key, version, changed): which columns differ from the version before; all of the first one."""
    order = Window.partitionBy(key).orderBy(version)
    before = versions.withColumn("__old", F.lag(F.struct(*compared)).over(order))
    changed = F.array_compact(F.array(*(F.when(F.col("__old").isNull() | ~F.col(c).eqNullSafe(F.col(f"__old.{c}")), F.lit(c)) for c in compared)))
    return before.select(key, version, changed.alias("changed"))


def daily_snapshot(events: DataFrame, limit: int = 50, zone: str = "Asia/Shanghai") -> DataFrame:
    """(day, rank, ...): each natural day's events ranked by score, last sight and key, the first ``limit``.

    The limit is the ranking's size; its window is planned with a group limit below the exchange.
    """
    day = F.to_date(F.from_utc_timestamp(F.col("last_seen_at").cast("timestamp"), zone))
    order = Window.partitionBy("day").orderBy(F.col("score").desc(), F.col("last_seen_at").desc_nulls_first(), F.col("fingerprint").desc())
    ranked = events.withColumn("day", day).filter("day IS NOT NULL").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit)


def revisions(snapshots: DataFrame, key: str, at: str, payload: str) -> DataFrame:
    """Only the snapshots whose payload differs from the one before, numbered from 1."""
    order = Window.partitionBy(key).orderBy(at)
    fresh = snapshots.withColumn("__old", F.lag(payload).over(order)).filter(~F.col("__old").eqNullSafe(F.col(payload)))
    return fresh.withColumn("revision", F.row_number().over(order)).drop("__old")


def superseded(revisions: DataFrame, keys: list[str], order: list[str], key: str) -> DataFrame:
    """``revisions`` with superseded_by, the ``key`` of the next one of the same keys; null for the current one. Null orders come first."""
    following = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_first() for c in order))
    return revisions.withColumn("superseded_by", F.lead(key).over(following))


def with_fulltext(documents: DataFrame, texts: DataFrame, key: str, body: str, versions: list[str]) -> DataFrame:
    """Documents with the bodies fetched for them; what was derived from another body is due again (its versions are null).

    ``texts`` has the key and the body, one row a key; null bodies change nothing.
    """
    fetched = texts.filter(F.col(body).isNotNull()).select(key, F.col(body).alias("__new"))
    joined = documents.join(fetched, key, "left")
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(body))
    reset = {v: F.when(~changed, F.col(v)) for v in versions}
    return joined.withColumns(reset | {body: F.coalesce("__new", body)}).select(*documents.columns)


def as_of(versions: DataFrame, keys: list[str], at: str, moment: Column) -> DataFrame:
    """The latest version of every key at or before a moment; of equal times the largest in the other columns, in their order."""
    rest = [F.col(c).desc() for c in versions.columns if c not in (*keys, at)]
    order = Window.partitionBy(*keys).orderBy(F.col(at).desc(), *rest)
    return versions.filter(F.col(at) <= moment).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of its keys at or before it.

    One sort of the union instead of a range join: the last value seen so far.
    """
    blank = [F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values]
    rows = left.withColumn("__at", F.col(left_at)).withColumn("__side", F.lit(1)).select("*", *blank)
    other = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), *(F.col(v).alias(f"__{v}") for v in values))
    seen = Window.partitionBy(*keys).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.unionByName(other, allowMissingColumns=True)
    packed = F.last(F.when(F.col("__side") == 0, F.struct(*(F.col(f"__{v}").alias(v) for v in values))), ignorenulls=True).over(seen)
    return whole.withColumn("__last", packed).filter("__side = 1").select(*left.columns, *(F.col(f"__last.{v}").alias(v) for v in values))
