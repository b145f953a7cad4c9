"""Best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip

#: Trust tiers, best first; anything else ranks behind them.
TIERS = ("A", "B", "C")


def valid_time() -> Column:
    """published_at where it isn't missing or later than the row's own fetched_at, else null."""
    return F.when(~F.coalesce(F.col("published_at") > F.col("fetched_at"), F.lit(False)), F.col("published_at"))


def trust_rank() -> Column:
    tier = F.upper(strip(F.col("trust_tier")))
    rank = F.lit(len(TIERS))
    for i, name in reversed(list(enumerate(TIERS))):
        rank = F.when(tier == name, i).otherwise(rank)
    return rank


def standing(time: Column) -> Column:
    """A struct that is larger the better the record: tier, quality, time, smaller id; unusable values last."""
    quality = F.when(F.col("parse_quality").between(0, 1), F.col("parse_quality"))
    return F.struct(
        (-trust_rank()).alias("tier"),
        F.coalesce(quality, F.lit(-1.0)).alias("quality"),
        time.isNotNull().alias("timed"),
        time.alias("time"),
        (-F.col("id")).alias("id"),
    )


def best_representatives(documents: DataFrame) -> DataFrame:
    """One row per group: the surviving record and where its title, body and time come from.

    The members of a group are totally ordered by ``standing``; each field is taken
    from the first member that has it, the publication time from the latest usable
    one. All of it is one aggregation whose partial results are combined before the
    shuffle, so a group with a third of all rows is no hot task. Rows in no group
    (null key) give nothing; a field nobody has is 0; the group of rows that repeat
    entirely is still one row.
    """
    # extra columns of the input can't clash: only these are read
    rows = documents.select("dedupe_component_id", "id", "trust_tier", "parse_quality", "published_at", "fetched_at", "title", "body")
    rows = rows.filter(F.col("dedupe_component_id").isNotNull()).select(
        "dedupe_component_id", "id", standing(valid_time()).alias("s"), valid_time().alias("t"), blank(F.col("title")).alias("no_title"), blank(F.col("body")).alias("no_body")
    )
    best = lambda keep: F.coalesce(F.max(F.when(keep, F.col("s")))["id"] * -1, F.lit(0))
    return rows.groupBy("dedupe_component_id").agg(
        best(F.lit(True)).alias("survivor_id"),
        best(~F.col("no_title")).alias("title_from"),
        best(~F.col("no_body")).alias("body_from"),
        F.coalesce(F.max(F.when(F.col("t").isNotNull(), F.struct("t", "s")))["s"]["id"] * -1, F.lit(0)).alias("published_from"),
    )


def _acyclic(edges: list) -> tuple[list, dict]:
    """The edges that close no cycle with stronger ones before them, and what each value precedes, directly or not."""
    kept, after = [], {}
    for e in edges:
        above = {e.later} | after.get(e.later, set())
        if e.earlier in above:
            continue
        kept.append(e)
        for value in [e.earlier, *(v for v, later in after.items() if e.earlier in later)]:
            after.setdefault(value, set()).update(above)
    return kept, after


def learn_precedence(rows: DataFrame, min_support: int = 3) -> DataFrame:
    """(earlier, later, margin, support): which value of an attribute replaces which, learned from timestamped rows.

    ``rows`` has group_key, value, time (null where missing). A group's values are
    put in the order they first appear in; each step counts as one transition. a
    precedes b if a->b was seen at least ``min_support`` times and more often than
    b->a. Of each cycle only the weakest edge is left out: edges are taken by falling
    margin over the opposite, then support. The edges between the different values of
    an attribute, a small vocabulary, are looked at by the driver.
    """
    timed = rows.filter(F.col("value").isNotNull() & F.col("time").isNotNull())
    first = timed.groupBy("group_key", "value").agg(F.min("time").alias("first"))
    step = Window.partitionBy("group_key").orderBy("first", "value")
    steps = first.withColumn("earlier", F.lag("value").over(step)).filter("earlier IS NOT NULL").groupBy("earlier", F.col("value").alias("later")).agg(F.count(F.lit(1)).alias("n"))
    back = steps.select(F.col("later").alias("earlier"), F.col("earlier").alias("later"), F.col("n").alias("against"))
    majority = (
        steps.join(back, ["earlier", "later"], "left")
        .withColumn("margin", F.col("n") - F.coalesce("against", F.lit(0)))
        .filter((F.col("n") >= min_support) & (F.col("margin") > 0))
        .select("earlier", "later", "margin", F.col("n").alias("support"))
    )
    kept, _ = _acyclic(sorted(majority.collect(), key=lambda e: (-e.margin, -e.support, e.earlier, e.later)))
    return rows.sparkSession.createDataFrame(kept, majority.schema)


def current_values(rows: DataFrame, precedence: DataFrame | None = None) -> DataFrame:
    """(group_key, value, by): the most current value of an attribute in each group.

    The partial order of a group's values comes from the times of its rows where
    they have some, and from the learned precedence, followed through any number of
    values, where they don't. Of the timed values the latest stands (``by`` = time).
    A value seen only without a time takes its place if the precedence leads from the
    standing one to it, the topologically latest first (``by`` = precedence). Groups
    without a single time take the value that the precedence reaches last, unknown
    values by their order. Null values don't count; a group with nothing else gives
    no row. ``precedence`` has earlier and later, without cycles.
    """
    known = rows.filter(F.col("group_key").isNotNull() & F.col("value").isNotNull())
    order = precedence if precedence is not None else learn_precedence(known)
    _, after = _acyclic(order.select("earlier", "later").collect())
    before: dict = {}
    for a, later in after.items():
        for b in later:
            before.setdefault(b, set()).add(a)
    # a value has more values before it than each of those before it: their number is a topological order
    kind = order.schema["later"].dataType.simpleString()
    place = rows.sparkSession.createDataFrame([(v, len(x)) for v, x in before.items()], f"value {kind}, place int")
    closed = rows.sparkSession.createDataFrame([(a, b, True) for a, later in after.items() for b in later], f"timed {kind}, value {kind}, replaces boolean")
    values = known.groupBy("group_key", "value").agg(F.max("time").alias("last"))
    standing_value = values.groupBy("group_key").agg(F.max(F.when(F.col("last").isNotNull(), F.struct("last", "value")))["value"].alias("timed"))
    untimed = (
        values.filter(F.col("last").isNull())
        .join(standing_value, "group_key")
        .join(place, "value", "left")
        .join(closed, ["timed", "value"], "left")
        .filter(F.col("timed").isNull() | F.col("replaces"))
        .groupBy("group_key")
        .agg(F.max(F.struct(F.coalesce("place", F.lit(0)), "value"))["value"].alias("untimed"))
    )
    return (
        standing_value.join(untimed, "group_key", "left")
        .select("group_key", F.coalesce("untimed", "timed").alias("value"), F.when(F.col("untimed").isNull(), "time").otherwise("precedence").alias("by"))
        .filter("value IS NOT NULL")
    )
