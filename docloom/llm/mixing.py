"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Documents per bucket of a distributed running sum.
BUCKET = 10_000


def _running(rows: DataFrame, group: list[str], bucket: Column, order: list[str], size: str, out: str) -> DataFrame:
    """Add ``out``, the running sum of ``size`` by ``order``, in two steps: within buckets and over their sums.

    Buckets follow the order and hold about BUCKET rows, so neither step puts a group in one task.
    """
    rows = rows.withColumn("__b", bucket)
    keys = [*group, "__b"]
    totals = rows.groupBy(*keys).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(offsets, keys).withColumn(out, F.col("__before") + F.sum(size).over(within)).drop("__b", "__before")


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    ``sizes`` has doc_id (unique), source, tokens; ``targets`` has source,
    target_share, max_repeats, one row per source of a hand-kept list. Returns

    * (doc_id, source, tokens, uses): each document that is used, and how often;
    * (source, target_share, max_repeats, documents, uses, tokens, share): what each
      target source contributes, its share of all tokens reached, 0 for a source without tokens.

    Every source's documents are shuffled by a hash of their id, and its list is
    repeated up to max_repeats times. The finish time of a copy is the number of the
    source's tokens up to and with it, over the source's weight. All copies are put
    in order of their finish times and taken until the ``budget`` of tokens is
    full. Without a budget it is the largest for which no source runs out of
    repetitions, so that every source that has tokens gets its share; weights of
    sources without tokens are spread over the others in proportion. With a larger
    budget, exhausted sources stay below their share, which the report shows.

    Documents that are null or in no target source, or without tokens, are not used.
    Shares that are null or not positive and repeats below 1 take a source out.
    No usable document gives an empty mixture and shares of 0.
    """
    goals = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    wanted = goals.filter("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1")
    usable = sizes.select("doc_id", "source", "tokens").filter("tokens > 0")
    totals = usable.groupBy("source").agg(F.sum("tokens").alias("all_tokens"), F.count(F.lit(1)).alias("all_documents"))
    # one row per target source: a hand-kept list, whose size is that of the targets
    present = wanted.join(totals, "source").collect()
    weight = sum(r.target_share for r in present)
    limit = min((r.max_repeats * r.all_tokens * weight / r.target_share for r in present), default=0.0)
    budget = math.floor(limit) if budget is None else budget
    plan = [(r.source, r.target_share / weight, r.all_tokens, min(r.max_repeats, math.ceil(budget * (r.target_share / weight) / r.all_tokens) + 1)) for r in present]
    # an exhausted source leaves its time to the others: they may need all their repeats
    if budget > limit:
        plan = [(s, w, n, next(r.max_repeats for r in present if r.source == s)) for s, w, n, _ in plan]
    spark = sizes.sparkSession
    queues = spark.createDataFrame(plan, "source string, weight double, all_tokens bigint, copies int")
    rows = sum(r.all_documents for r in present)
    bits = max(0, math.ceil(math.log2(max(1, rows / BUCKET))))
    shuffled = usable.join(F.broadcast(queues), "source").withColumn("draw", F.xxhash64(F.lit(seed), "doc_id"))
    queued = _running(shuffled, ["source"], F.shiftright("draw", 64 - bits) if bits else F.lit(0), ["draw", "doc_id"], "tokens", "upto")
    copies = queued.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("finish", (F.col("copy") * F.col("all_tokens") + F.col("upto")) / F.col("weight"))
    copies = cut(copies.select("doc_id", "source", "tokens", "copy", "finish"))
    # the range sort: buckets of equal finish time; only the one in which the budget ends is looked into
    span = max((n * c / w for _, w, n, c in plan), default=1.0)
    parts = max(1, math.ceil(sum(r.all_documents * c for r, (_, _, _, c) in zip(present, plan)) / BUCKET))
    part = F.floor(F.col("finish") / F.lit(span / parts))
    taken = _running(copies, [], part, ["finish", "source", "doc_id"], "tokens", "total").filter(F.col("total") <= budget)
    mixture = cut(taken.groupBy("doc_id", "source").agg(F.first("tokens").alias("tokens"), F.count(F.lit(1)).cast("int").alias("uses")))
    reached = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("documents", "uses", "tokens")]
    # a window over the handful of target sources
    report = goals.join(reached, "source", "left").select("source", "target_share", "max_repeats", *filled)
    return mixture, report.withColumn("share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0)), F.lit(0.0)))
