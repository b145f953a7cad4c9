"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).head()
    return row.n, row.x


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest id of everything a node is connected with.

    ``edges`` has a and b. Every step links neighbours to the smallest of them
    (larger ones in the first step, smaller ones in the second), so stars grow and
    no neighbourhood is ever collected; minima are combined before the shuffle.
    Each round is cut by a reliable checkpoint. Nodes that have only null or self
    links are left out. No edges give no rows.
    """
    larger = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = cut(larger.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        large = large.unionByName(both.join(least, "a").filter("a != m").select("a", F.col("m").alias("b"))).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").filter("a != b").distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    members = edges.groupBy("a").agg(F.min("b").alias("component"))
    roots = members.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    return members.withColumnRenamed("a", "node").unionByName(roots)


def stable_ids(members: DataFrame, former: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(component, stable_id): new components named after the former ones they overlap most.

    ``members`` has node and component, ``former`` node and former_id. In each round
    the pairs that prefer each other (largest overlap, then smallest former id, then
    smallest component) are settled, which gives the greedy assignment by falling
    overlap; all such pairs of a round are settled at once. Components without a
    former id left get fresh ones above all former ids, in their order. Overlaps are
    counted before the shuffle; only a count per round reaches the driver.
    """
    shared = members.join(former, "node").groupBy("component", "former_id").agg(F.count(F.lit(1)).alias("n"))
    open_pairs, settled = cut(shared), None
    for _ in range(max_rounds):
        if open_pairs.isEmpty():
            break
        rank = F.struct((-F.col("n")).alias("n"), F.col("former_id").alias("f"), F.col("component").alias("c"))
        by_component = open_pairs.groupBy("component").agg(F.min(rank)["f"].alias("former_id"))
        by_former = open_pairs.groupBy("former_id").agg(F.min(rank)["c"].alias("component"))
        agreed = cut(by_component.join(by_former, ["component", "former_id"]))
        settled = agreed if settled is None else cut(settled.unionByName(agreed))
        open_pairs = cut(open_pairs.join(agreed.select("component"), "component", "left_anti").join(agreed.select("former_id"), "former_id", "left_anti"))
    else:
        raise RuntimeError(f"ids still open after {max_rounds} rounds")
    components = members.select("component").distinct()
    if settled is None:
        settled = shared.select("component", "former_id").limit(0)
    fresh = components.join(settled, "component", "left_anti")
    # fresh numbers in order of the components, in two steps: counts of ranges, then places within them
    spread = fresh.withColumn("r", F.floor(F.col("component") / F.lit(10_000)))
    starts = spread.groupBy("r").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    top = former.agg(F.coalesce(F.max("former_id"), F.lit(0))).head()[0]
    numbered = spread.join(starts, "r").withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("component")))
    return settled.withColumnRenamed("former_id", "stable_id").unionByName(numbered.select("component", (F.lit(top) + F.col("before") + F.col("k")).alias("stable_id")))
