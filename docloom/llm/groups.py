"""Consolidating pairwise matches into groups: hash-to-min over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _fingerprint(clusters: DataFrame) -> tuple:
    row = clusters.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("v", "u")).alias("x"),
        F.bit_xor(F.xxhash64("u", F.lit(7), "v")).alias("y"),
    ).head()
    return row.n, row.x, row.y


def consolidate(links: DataFrame, left: str, right: str, max_rounds: int = 100) -> DataFrame:
    """(member, group_id): the smallest member of all that are linked directly or indirectly.

    Every vertex keeps a cluster; each round it sends the whole cluster to the
    cluster's minimum and that minimum to all others, until nothing changes. A
    cluster is never one value: it is the rows (v, u) of its members, so the hub of
    a component with a third of all records is only a frequent key. Minima are
    pre-aggregated before their shuffle, duplicate rows are removed by (v, u), which
    spreads a hub over all tasks, and the join that hands a vertex its minimum is
    one AQE splits where a key is skewed (its other side has one row per vertex).
    Rounds grow with the logarithm of the longest chain; each is cut by a reliable
    checkpoint. Nothing but three numbers per round reaches the driver.

    A null ``right`` is a record without a match, a link to itself adds nothing;
    repeated and turned-round links count once; a null ``left`` with a ``right``
    leaves ``right`` as a member. No links at all give no rows. Stops with an
    error should ``max_rounds`` not suffice, never with a partial result.
    """
    ends = links.select(F.col(left).alias("a"), F.col(right).alias("b"))
    pairs = ends.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"))
    clusters = cut(
        pairs.select(F.col("p.a").alias("v"), F.explode(F.array("p.a", "p.b")).alias("u"))
        .filter(F.col("v").isNotNull() & F.col("u").isNotNull())
        .distinct()
    )
    before = _fingerprint(clusters)
    for _ in range(max_rounds):
        minima = clusters.groupBy("v").agg(F.min("u").alias("m"))
        sent = clusters.join(minima, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("s")
        )
        clusters = cut(sent.select("s.v", "s.u").distinct())
        now = _fingerprint(clusters)
        if now == before:
            return clusters.groupBy("v").agg(F.min("u").alias("group_id")).withColumnRenamed("v", "member")
        before = now
    raise RuntimeError(f"groups still change after {max_rounds} rounds")
