"""Non-destructive deduplication of documents: edge generators, components, masters, kinds."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signatures import cjk_pairs_of, words_of
from ..functions.similarity import nfkc, normalize_title, plain_ratio, similar_in, title_similarity
from ..functions.text import identity_values, squeeze
from ..functions.urls import url_key
from ..session import cut
from .graph import connected_components

#: Thresholds of the matching rules.
SHORTEST_EXACT_TITLE, SHORTEST_FUZZY_TITLE = 20, 24
EXACT_DAYS, FUZZY_DAYS = 30, 14
FUZZY_SCORE, FUZZY_RATIO, CONTENT_SCORE, LENGTH_RATIO = 94.0, 88.0, 80.0, 0.72
BUCKET = 100
SHORTEST_CONTENT = 200
#: Endpoints of structured vulnerability feeds are a scope of their own.
VULNERABILITY_CONNECTORS = ("vuln",)


def trust_rank(tier: Column) -> Column:
    return F.when(tier == "A", 0).when(tier == "B", 1).when(tier == "C", 2).otherwise(3)


def content_key(body: Column) -> Column:
    """SHA-256 of the NFKC, squeezed body; null below SHORTEST_CONTENT characters."""
    flat = squeeze(nfkc(body))
    return F.when(F.char_length(flat) >= SHORTEST_CONTENT, F.sha2(flat, 256))


def within_days(left: Column, right: Column, days: int, both_known: bool = False) -> Column:
    """Never null: an unknown time is compatible unless both must be known."""
    apart = F.abs(F.unix_micros(left.cast("timestamp")) - F.unix_micros(right.cast("timestamp")))
    return F.coalesce(apart <= days * 86_400_000_000, F.lit(not both_known))


def prepared(documents: DataFrame, scope: Column | None = None) -> DataFrame:
    """The keys of every document that the edge generators join on; bodies are left behind."""
    vulnerabilities = F.array_sort(F.array_distinct(F.concat(*(identity_values(F.col("identifiers"), k) for k in ("cve", "ghsa", "cnvd")))))
    return documents.select(
        "id",
        (scope if scope is not None else F.lit("general")).alias("scope"),
        "trust_tier",
        F.when(F.col("parse_quality").between(0, 1), F.col("parse_quality")).otherwise(0.0).alias("parse_quality"),
        F.coalesce(F.char_length("body"), F.lit(0)).alias("body_length"),
        F.coalesce(F.char_length("title"), F.lit(0)).alias("title_length"),
        url_key(F.col("canonical_url")).alias("url"),
        normalize_title("title").alias("folded"),
        content_key(F.col("body")).alias("content"),
        vulnerabilities.alias("ids"),
        F.col("published_at").alias("at"),
    ).withColumn("compact", F.replace("folded", F.lit(" "), F.lit("")))


def identities_conflict(left: Column, right: Column) -> Column:
    """Both have identities and share none."""
    return (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)


def review_conflict(left: Column, right: Column) -> Column:
    """Why a review must not merge: the first kind of which both have identities and share none, else any of them; null if nothing does.

    Stricter than ``identities_conflict``: a shared identity of one kind doesn't outweigh different ones of another.
    """
    reason = F.when(identities_conflict(left, right), "conflict:vulnerability")
    for kind in ("ghsa", "cve", "cnvd"):  # innermost first: cnvd, cve, ghsa in their order
        mark = f"{kind.upper()}-"
        own = [F.filter(side, lambda v: v.startswith(mark)) for side in (left, right)]  # noqa: B023
        reason = F.when(identities_conflict(*own), f"conflict:{kind}").otherwise(reason)
    return reason


def _star(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the smallest id of its key: as many edges as rows, however large the group."""
    centre = rows.groupBy(*keys).agg(F.min("id").alias("b"))
    return rows.join(centre, keys).filter("id != b").select(F.col("id").alias("a"), "b")


def url_edges(docs: DataFrame) -> DataFrame:
    """Documents of one address and scope: a star per identity, one for those without, joined if there is at most one identity."""
    named = docs.filter(F.col("url").isNotNull())
    with_ids = _star(named.select("id", "url", "scope", F.explode("ids").alias("identity")), ["url", "scope", "identity"])
    plain = named.filter(F.size("ids") == 0)
    without = _star(plain.select("id", "url", "scope"), ["url", "scope"])
    single = named.select("url", "scope", "id", F.explode("ids").alias("identity")).groupBy("url", "scope").agg(F.min("id").alias("a"), F.count_distinct("identity").alias("n")).filter("n = 1")
    bridge = single.join(plain.groupBy("url", "scope").agg(F.min("id").alias("b")), ["url", "scope"]).select("a", "b")
    return with_ids.unionByName(without).unionByName(bridge)


def _pairs(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    left, right = docs.alias("l"), docs.alias("r")
    same = [F.col(f"l.{key}") == F.col(f"r.{key}"), F.col("l.scope") == F.col("r.scope"), F.col("l.id") > F.col("r.id")]
    both = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("id", *columns)]
    return left.join(right, same).select(*both)


def _linked(rows: DataFrame, key: list[str]) -> DataFrame:
    """Edges that connect what all pairs of a key connect whose dates are within a month or unknown and whose identities don't conflict.

    ``rows`` has id, the key, ids and at. A few edges a row, however many share a key:
    rows of one identity, and rows without any, are chained by time; a row with
    identities is linked to the nearest row without on either side; rows of unknown
    time are centres of stars.
    """
    long = rows.select("id", *key, "ids", "at", (F.size("ids") == 0).alias("plain"))
    timed, untimed = long.filter(F.col("at").isNotNull()), long.filter(F.col("at").isNull())
    here = F.struct("at", "id")

    def chained(rows: DataFrame, neighbours: list[Column]) -> DataFrame:
        found = rows.select(F.col("id").alias("a"), "at", F.array(*neighbours).alias("n")).select("a", "at", F.explode("n").alias("n"))
        return found.filter(F.col("n").isNotNull() & within_days(F.col("at"), F.col("n.at"), EXACT_DAYS)).select("a", F.col("n.id").alias("b"))

    def starred(rows: DataFrame, centres: DataFrame, by: list[str]) -> DataFrame:
        return rows.join(centres.groupBy(*by).agg(F.min("id").alias("b")), by).filter("id != b").select(F.col("id").alias("a"), "b")

    back, ahead = (Window.partitionBy(*key).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1) for o in (("at", "id"), (F.col("at").desc(), F.col("id").desc())))
    nearest = [F.last(F.when(F.col("plain"), here), ignorenulls=True).over(w) for w in (back, ahead)]
    of_identity = Window.partitionBy(*key, "identity").orderBy("at", "id")
    named = long.withColumn("identity", F.explode("ids"))
    edges = chained(timed, nearest)
    for more in (
        chained(named.filter(F.col("at").isNotNull()), [F.lag(here).over(of_identity)]),
        starred(long, untimed.filter("plain"), key),
        starred(named, named.filter(F.col("at").isNull()), [*key, "identity"]),
        starred(long.filter("plain"), untimed.filter("NOT plain"), key),
        starred(untimed.filter("NOT plain"), long.filter("plain"), key),
    ):
        edges = edges.unionByName(more)
    return edges


def exact_title_edges(docs: DataFrame) -> DataFrame:
    """Equal long titles, dates within a month or unknown, no conflicting identities."""
    return _linked(docs.filter(F.char_length("compact") >= SHORTEST_EXACT_TITLE), ["compact", "scope"])


def exact_content_edges(docs: DataFrame) -> DataFrame:
    """Equal long bodies whose titles are similar too, dates within a month or unknown, no conflicting identities.

    Documents of one body, title and identities are a class. Within one, and between
    two similar ones, each document is linked to the last one before it; those of unknown time are centres of stars.
    """
    long = docs.filter(F.col("content").isNotNull()).withColumn("class", F.struct("content", "scope", "ids", "folded"))
    one = long.groupBy("class", "content", "scope").agg(F.min("id").alias("id"), F.first("ids").alias("ids"), F.first("folded").alias("folded"))
    pairs = _pairs(one, "content", ["ids", "folded", "class"])
    kept = pairs.filter(~identities_conflict(F.col("l_ids"), F.col("r_ids"))).filter(title_similarity("l_folded", "r_folded") >= CONTENT_SCORE)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("l_class").alias("class")), F.struct(F.lit(1).alias("side"), F.col("r_class").alias("class")))
    met = kept.select("l_id", "r_id", F.explode(sides).alias("s")).select("l_id", "r_id", "s.*").join(long.select("class", "id", "at"), "class").drop("class")
    before = Window.partitionBy("l_id", "r_id").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    other = [F.last(F.when(F.col("side") == s, F.struct("at", "id")), ignorenulls=True).over(before) for s in (1, 0)]
    timed = met.filter(F.col("at").isNotNull()).withColumn("n", F.when(F.col("side") == 0, other[0]).otherwise(other[1]))
    edges = timed.filter(F.col("n").isNotNull() & within_days(F.col("at"), F.col("n.at"), EXACT_DAYS)).select(F.col("id").alias("a"), F.col("n.id").alias("b"))
    centres = met.filter(F.col("at").isNull()).groupBy("l_id", "r_id", (1 - F.col("side")).alias("side")).agg(F.min("id").alias("b"))
    stars = met.join(centres, ["l_id", "r_id", "side"]).select(F.col("id").alias("a"), "b")
    return _linked(long, ["class"]).unionByName(edges).unionByName(stars)


def blocking_keys(folded: Column) -> Column:
    """Words of four or more characters and pairs of CJK characters, each marked with its kind."""
    marked = lambda kind, found: F.transform(found, lambda t: F.concat(F.lit(f"{kind}:"), t))
    return F.array_distinct(F.concat(marked("w", words_of(folded)), marked("c", cjk_pairs_of(folded))))


def fuzzy_title_edges(docs: DataFrame, score: float = FUZZY_SCORE) -> DataFrame:
    """Similar long titles within a fortnight that share a key held by at most BUCKET titles.

    Classes of equal title, scope and identities stand for their documents at their
    different times; blocking on keys of bounded frequency is the rule's definition,
    cheap tests come before the similarity.
    """
    long = docs.filter((F.char_length("compact") >= SHORTEST_FUZZY_TITLE) & F.col("at").isNotNull())
    keyed = long.withColumn("key", F.explode(blocking_keys(F.col("folded"))))
    rare = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, BUCKET)).select("key")
    pairs = _pairs(keyed.join(rare, "key").select("id", "scope", "key", "folded", "ids", "at"), "key", ["folded", "ids", "at"]).dropDuplicates(["l_id", "r_id"])
    shorter, longer = F.least(F.char_length("l_folded"), F.char_length("r_folded")), F.greatest(F.char_length("l_folded"), F.char_length("r_folded"))
    cheap = pairs.filter(within_days(F.col("l_at"), F.col("r_at"), FUZZY_DAYS, both_known=True) & ~identities_conflict(F.col("l_ids"), F.col("r_ids")) & (shorter >= longer * LENGTH_RATIO))
    alike = (title_similarity("l_folded", "r_folded") >= score) & (plain_ratio("l_folded", "r_folded") >= FUZZY_RATIO)
    return cheap.filter(alike).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def similar_titles(titles: DataFrame, score: float, block: int = 4000) -> DataFrame:
    """(a, b, similarity): all pairs of titles of at least this similarity, a < b; no key has to be shared.

    ``titles`` has id and folded, different in each row. Lengths bound the similarity,
    so only titles of the same or the next band of lengths meet. Bands are split by a
    hash into blocks of about ``block`` titles, however many there are; a task compares two blocks
    (``similar_in``). The comparisons grow with the square of the different titles.
    """
    least = (score - 0.006) / 100
    base = math.log((2 - least) / least * 1.0001)
    banded = titles.filter("folded != ''").select("id", "folded", F.floor(F.log(F.char_length("folded").cast("double")) / F.lit(base)).alias("band"))
    parts = banded.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    placed = banded.join(parts, "band").select("id", "folded", "band", F.pmod(F.xxhash64("folded"), F.col("parts")).alias("part"))
    blocks = parts.select("band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    same = (F.col("l.band") == F.col("r.band")) & (F.col("l.part") <= F.col("r.part"))
    meeting = blocks.alias("l").join(blocks.alias("r"), same | (F.col("l.band") + 1 == F.col("r.band"))).select(F.struct("l.band", "l.part").alias("x"), F.struct("r.band", "r.part").alias("y"))
    sides = meeting.select(F.concat_ws("/", "x.band", "x.part", "y.band", "y.part").alias("pair"), F.explode(F.array(F.struct(F.lit(0).alias("side"), "x.*"), F.struct(F.lit(1).alias("side"), "y.*"))).alias("s")).select("pair", "s.*")

    def compared(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        x, y = left["folded"].tolist(), right["folded"].tolist()
        i, j = similar_in(x, y, score) if x and y else ((), ())
        ids = [list(side["id"]) for side in (left, right)]
        columns = {"i": [ids[0][k] for k in i], "j": [ids[1][k] for k in j], "x": [x[k] for k in i], "y": [y[k] for k in j]}
        return pd.DataFrame({c: pd.Series(v, dtype="object") for c, v in columns.items()})

    kind = dict(titles.dtypes)["id"]
    # by number: partitions coalesced by their bytes would leave the comparisons to a few tasks
    tasks = 4 * titles.sparkSession.sparkContext.defaultParallelism
    found = placed.join(sides, ["band", "part"]).select("pair", "side", "id", "folded").repartition(tasks, "pair").groupBy("pair").applyInPandas(compared, f"i {kind}, j {kind}, x string, y string")
    # a block that meets itself has each pair twice, and each title with itself
    pairs = found.filter("i != j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(F.col("i") < F.col("j"), F.col("x")).otherwise(F.col("y")).alias("x"), F.when(F.col("i") < F.col("j"), F.col("y")).otherwise(F.col("x")).alias("y")).dropDuplicates(["a", "b"])
    return pairs.select("a", "b", title_similarity("x", "y").alias("similarity")).filter(F.col("similarity") >= score)


def duplicate_edges(docs: DataFrame) -> DataFrame:
    generators = (url_edges, exact_title_edges, exact_content_edges, fuzzy_title_edges)
    # one plan of all generators would be too large for the driver
    found = cut(generators[0](docs).distinct())
    for generator in generators[1:]:
        found = found.unionByName(cut(generator(docs).distinct()))
    return found.distinct()


def approved_edges(docs: DataFrame, approved: DataFrame) -> DataFrame:
    """The reviewed pairs (a, b) within one scope whose identities don't conflict: a review overrides neither."""
    side = lambda p: docs.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "scope", "ids")))
    both = approved.join(side("l"), F.col("a") == F.col("l_id")).join(side("r"), F.col("b") == F.col("r_id"))
    return both.filter((F.col("l_scope") == F.col("r_scope")) & ~identities_conflict(F.col("l_ids"), F.col("r_ids"))).select("a", "b").distinct()


def deduplicate(documents: DataFrame, scope: Column | None = None, approved: DataFrame | None = None) -> DataFrame:
    """(document_id, near_dup_of, duplicate_kind, duplicate_score): every document; nulls for masters and singles.

    Edges make components; the master is the member of the best trust tier, then
    quality, body length, title length and smallest id. The kind says how a document
    compares with its master: review_approved where only the pair with it was reviewed.
    ``approved`` (a, b) adds reviewed pairs within a scope that don't conflict.
    """
    docs = cut(prepared(documents, scope))
    edges = duplicate_edges(docs)
    if approved is not None:
        edges = edges.unionByName(approved_edges(docs, approved))
    components = connected_components(edges)
    rank = F.struct(
        trust_rank(F.col("trust_tier")).alias("tier"), (-F.col("parse_quality")).alias("quality"), (-F.col("body_length")).alias("body"),
        (-F.col("title_length")).alias("title"), F.col("id").alias("id"),
    )
    members = docs.join(components, docs.id == components.node).drop("node")
    masters = members.groupBy("component").agg(F.min(rank)["id"].alias("master"))
    keys = ["url", "compact", "content", "folded"]
    master_keys = docs.select(F.col("id").alias("master"), *(F.col(k).alias(f"m_{k}") for k in keys))
    judged = members.join(masters, "component").filter("id != master").join(master_keys, "master")
    similarity = title_similarity("folded", "m_folded")
    kind = (
        F.when(F.col("url") == F.col("m_url"), "exact_url")
        .when((F.col("compact") == F.col("m_compact")) & (F.char_length("compact") >= SHORTEST_EXACT_TITLE), "exact_title")
        .when(F.col("content") == F.col("m_content"), "exact_content")
        .otherwise("near_title")
    )
    judged = judged.select("id", "master", kind.alias("kind"), similarity.alias("similarity"))
    if approved is not None:
        ways = approved_edges(docs, approved).select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("master")), F.struct(F.col("b").alias("id"), F.col("a").alias("master")))).alias("w")).select("w.*").distinct()
        judged = judged.join(ways.withColumn("reviewed", F.lit(True)), ["id", "master"], "left")
        judged = judged.withColumn("kind", F.when(F.col("reviewed") & (F.col("kind") == "near_title"), "review_approved").otherwise(F.col("kind")))
    score = F.when(F.col("kind").isin("near_title", "review_approved"), F.round(F.col("similarity") / 100, 4)).otherwise(1.0)
    return documents.select("id").join(judged, "id", "left").select(
        F.col("id").alias("document_id"), F.col("master").alias("near_dup_of"), F.col("kind").alias("duplicate_kind"), F.when(F.col("kind").isNotNull(), score).alias("duplicate_score")
    )


def candidate_pairs(signed: DataFrame, days: int = 30, bucket: int = BUCKET) -> DataFrame:
    """(a, b, shared): pairs that share a band token, or at least two lexical tokens, of bounded frequency.

    ``signed`` has id, at, bands array<string>, blocking array<string>. Tokens held by
    more than ``bucket`` documents generate nothing: that is the index's definition.
    Pairs are made within a token's rows, so no table is estimated and sent to the driver for a join.
    """
    tokens = signed.select("id", "at", F.explode(F.array_distinct(F.concat("bands", "blocking"))).alias("token"))
    # one row more than a usable token may have shows that it is too common; the limit is applied below the shuffle
    place = F.row_number().over(Window.partitionBy("token").orderBy("id"))
    few = tokens.withColumn("place", place).filter(F.col("place") <= bucket + 1)
    held = few.groupBy("token").agg(F.collect_list(F.struct("id", "at")).alias("held")).filter(F.size("held").between(2, bucket))
    banded = F.col("token").rlike("^(sim|min):").alias("banded")
    pairs = held.select(banded, "held", F.explode("held").alias("l")).select("banded", "l", F.explode("held").alias("r"))
    pairs = pairs.filter((F.col("l.id") < F.col("r.id")) & within_days(F.col("l.at"), F.col("r.at"), days))
    return (
        pairs.groupBy(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        .agg(F.count_if("banded").alias("bands"), F.count_if(~F.col("banded")).alias("lexical"))
        .filter("bands >= 1 OR lexical >= 2")
        .select("a", "b", "bands", "lexical")
    )


def exact_pairs(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of equal address, long folded title or content, whatever their times, a < b.

    ``docs`` is as ``prepared`` gives it. Up to ``bucket`` documents of a value give
    all their pairs; more of them give the edges that connect all that can merge, a
    few a row, so that no document of a large group is left without candidates.
    """
    long_title = F.when(F.char_length(F.replace("folded", F.lit(" "), F.lit(""))) >= SHORTEST_EXACT_TITLE, F.col("folded"))
    keys = {"url": F.nullif("url", F.lit("")), "title": long_title, "content": F.col("content")}
    values = F.array(*(F.struct(F.lit(k).alias("kind"), F.sha2(v, 256).alias("value")) for k, v in keys.items()))
    rows = docs.select("id", "ids", "at", F.explode(values).alias("v")).select("id", "ids", "at", "v.*").filter("value IS NOT NULL")
    sizes = rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # merged: what the planner takes these tables for is far too small to send one to the driver by
    grouped = rows.join(sizes.hint("merge"), ["kind", "value"])
    few = grouped.filter(F.col("n") <= bucket)
    pairs = few.alias("l").join(few.alias("r").hint("merge"), ["kind", "value"]).filter("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    many = _linked(grouped.filter(F.col("n") > bucket), ["kind", "value"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.unionByName(many).distinct()


def assess(pairs: DataFrame) -> DataFrame:
    """decision, reason and score of candidate pairs, by rules tried one after the other.

    ``pairs`` has both sides' ids, at, url, folded, content, distance and minhash
    (similarity), prefixed l_ and r_ where there are two.
    """
    scored = pairs.withColumn("title_score", title_similarity("l_folded", "r_folded"))
    conflict = review_conflict(F.col("l_ids"), F.col("r_ids"))
    outside = ~within_days(F.col("l_at"), F.col("r_at"), 30)
    distance, shared = F.col("distance"), F.coalesce("minhash", F.lit(0.0))
    blend = F.round(F.greatest(F.col("title_score") / 100, F.coalesce(1 - distance / F.lit(64), F.lit(0.0)), shared), 4)
    rules = (
        (conflict.isNotNull(), "separate", conflict, F.lit(0.0)),
        (outside, "separate", F.lit("outside_time_window"), F.lit(0.0)),
        (F.col("l_url") == F.col("r_url"), "merge", F.lit("exact_url"), F.lit(1.0)),
        ((F.col("l_folded") == F.col("r_folded")) & (F.col("l_folded") != ""), "merge", F.lit("exact_title"), F.lit(1.0)),
        (F.col("l_content") == F.col("r_content"), "merge", F.lit("exact_content"), F.lit(1.0)),
        (F.col("title_score") >= 94, "merge", F.lit("near_title"), F.round(F.col("title_score") / 100, 4)),
        ((F.col("title_score") >= 82) | F.coalesce(distance <= 8, F.lit(False)) | (shared >= 0.5), "review", F.lit("semantic_candidate"), blend),
    )
    verdict = F.struct(F.lit("separate").alias("decision"), F.lit("below_threshold").alias("reason"), blend.alias("score"))
    for test, decision, reason, score in reversed(rules):
        verdict = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(decision).alias("decision"), reason.alias("reason"), score.alias("score"))).otherwise(verdict)
    return scored.select("a", "b", verdict.alias("v")).select("a", "b", "v.decision", "v.reason", "v.score")

