"""Deduplicating new batches against everything accepted before: a persisted prefix-tree hash forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import document_url_key
from ..operators.graph import connected_components
from ..session import cut, shared_table
from ..sources.runs import BucketedRuns, look_up
from .forest import close_sketches, distinct_runs, planted, prefix_length, signed, within_prefix

WIDTH = 8
TREES = 64
OVERLAP = 0.5
RECALL = 0.98
LEAST = 200
#: How many rows of a range are compared first; the others follow where these decide nothing.
HEADS = 16
#: Rounds in which all documents are decided at once; what long chains leave is walked through in order.
ROUNDS = 6


def comparable(documents: DataFrame) -> DataFrame:
    """(id, place, letters, text, url): what two documents are compared by.

    place orders documents by batch_no, then id. letters is the lower-cased body's
    letters and digits, null below LEAST of them. text and url are the hubs where
    documents of equal letters and of equal URLs meet.
    """
    letters = F.regexp_replace(F.lower("body_text"), r"[^\p{L}\p{N}]+", "")
    rows = documents.select(
        "id",
        F.struct(F.coalesce("batch_no", F.lit(0)).alias("batch_no"), "id").alias("place"),
        F.when(F.char_length(letters) >= LEAST, letters).alias("letters"),
        F.md5(document_url_key(F.col("canonical_url"))).alias("url"),
    )
    return rows.select("id", "place", "letters", F.concat(F.lit("t"), F.md5("letters")).alias("text"), F.concat(F.lit("u"), "url").alias("url"))


def hubs_of(docs: DataFrame) -> DataFrame:
    """(id, place, hub): every document under its hubs."""
    return docs.select("id", "place", F.explode(F.array_compact(F.array("text", "url"))).alias("hub"))


def text_classes(docs: DataFrame) -> DataFrame:
    """(text, class, letters): each different text once, under its smallest id."""
    first = Window.partitionBy("text").orderBy("id")
    return docs.filter("text IS NOT NULL").withColumn("n", F.row_number().over(first)).filter("n = 1").select("text", F.col("id").alias("class"), "letters")


def verified(pairs: DataFrame, left: DataFrame, right: DataFrame | list[DataFrame]) -> DataFrame:
    """The pairs (a, b) whose distinct runs of WIDTH characters overlap by OVERLAP or more.

    The whole texts are compared, run by run (as 64-bit hashes). ``left`` and ``right``
    have class and letters; ``right`` may be the runs of a table.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def runs_of(key: int, text: str) -> np.ndarray:
            nonlocal size
            if key not in held:
                if size > 1 << 22:
                    held.clear()
                    size = 0
                held[key] = distinct_runs(text, WIDTH)
                size += len(held[key])
            return held[key]

        for frame in frames:
            keep = []
            for a, b, ta, tb in zip(frame.a, frame.b, frame.ta, frame.tb):
                x, y = runs_of(a, ta), runs_of(b, tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= OVERLAP * (len(x) + len(y) - common))
            yield frame.loc[keep, ["a", "b"]]

    # few pairs take long to compare: spread them whatever their bytes
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    named = pairs.repartition(parts, "b").join(left.select(F.col("class").alias("a"), F.col("letters").alias("ta")), "a")
    columns = [F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.ta").alias("ta"), F.col("r.letters").alias("tb")]
    joined = look_up(named.withColumn("class", F.col("b")), right if isinstance(right, list) else [right], "class", columns)
    return joined.mapInPandas(run, "a bigint, b bigint")


class History:
    """All accepted documents, under one path of the shared folder; later sessions open it by that path.

    Three tables of sorted runs: the forest (the signature of each different text in
    every tree), the texts themselves, and the hubs with the smallest id accepted in
    each. A batch signs its own texts only and looks them up; what it accepts is
    appended as a run.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.forest = BucketedRuns(spark, f"{path}/forest", "bucket", ("low",), "class")
        self.texts = BucketedRuns(spark, f"{path}/texts", "class")
        self.hubs = BucketedRuns(spark, f"{path}/hubs", "hub")

    def accept(self, classes: DataFrame, signs: DataFrame, members: DataFrame) -> None:
        """Append accepted documents: their texts (class, letters), the signatures of these, and their (hub, id)."""
        least = cut(members.groupBy("hub").agg(F.min("id").alias("id")))
        self.hubs.append(least, least.count())
        texts = classes.select("class", "letters")
        n = texts.count()
        self.texts.append(texts, n)
        self.forest.append(planted(signs, "class"), n * TREES)

    def start(self, documents: DataFrame) -> None:
        """Accept all of the documents unseen, as the history that later batches are compared with."""
        docs = cut(comparable(documents))
        classes = cut(text_classes(docs))
        self.accept(classes, cut(signed(classes, "class", "letters", TREES, WIDTH)), hubs_of(docs))

    def drop(self) -> None:
        for runs in (self.forest, self.texts, self.hubs):
            runs.drop()

    def nearest(self, classes: DataFrame, signs: DataFrame) -> DataFrame:
        """(class, old): the smallest accepted id with a similar text, for each class that has one.

        In each range of the forest a text is first compared with the HEADS smallest
        accepted ids. Later ones of the range matter only if they may be smaller than
        what was found anywhere: a range with a third of all texts, all alike, costs
        as many comparisons as texts are looked up.
        """
        runs = self.forest.runs()
        if not runs:
            return self.spark.createDataFrame([], "class bigint, old bigint")
        length = prefix_length(OVERLAP, TREES, RECALL)
        near = close_sketches("w", "r", OVERLAP) & within_prefix("w", "r", length)
        pair = [F.col("w.class").alias("a"), F.col("r.class").alias("b")]
        probes = planted(signs, "class")
        heads = [r.filter(F.col("rank") <= HEADS) for r in runs]
        first = cut(verified(look_up(probes, heads, "bucket", pair, near).distinct(), classes, self.texts.runs()))
        found = first.groupBy("a").agg(F.min("b").alias("old")).withColumnRenamed("a", "class")
        rest = None
        for r in runs:
            full = r.filter(F.col("rank") == HEADS).select("bucket", F.col("class").alias("last"))
            wanted = look_up(probes, [full], "bucket", [F.col("w.*"), F.col("r.last").alias("last")]).join(found, "class", "left")
            wanted = wanted.filter(F.col("old").isNull() | (F.col("old") > F.col("last")))
            later = F.col("r.class") > F.col("w.last")
            more = look_up(wanted, [r], "bucket", pair, near & later & (F.col("w.old").isNull() | (F.col("r.class") < F.col("w.old"))))
            rest = more if rest is None else rest.unionByName(more)
        second = cut(verified(rest.distinct().join(first, ["a", "b"], "left_anti"), classes, self.texts.runs()))
        return first.unionByName(second).groupBy("a").agg(F.min("b").alias("old")).withColumnRenamed("a", "class")

    def absorb(self, documents: DataFrame, keep: bool = True) -> DataFrame:
        """(kept_id, repeat_id) of the next documents, which may be of several batches; accepted ones join the history.

        First everything is compared with the history. Whatever matches it is a repeat
        and no longer a target; the texts of the others are compared among themselves
        in the same way as with the history: in each range with its HEADS earliest
        ones first, and with later ones only where that leaves something open. Then
        the documents are decided, each once all earlier members of its hubs are.
        ``keep=False`` leaves the history as it is, where nothing will follow.
        """
        docs = cut(comparable(documents))
        members = hubs_of(docs)
        classes = cut(text_classes(docs))
        signs = cut(signed(classes, "class", "letters", TREES, WIDTH))
        near = cut(self.nearest(classes, signs))
        named = classes.join(near, "class").select("text", "old")
        exact = look_up(members, self.hubs.runs(), "hub", [F.col("w.id").alias("id"), F.col("r.id").alias("old")])
        similar = docs.join(named, "text").select("id", "old")
        old = (similar if exact is None else similar.unionByName(exact)).groupBy("id").agg(F.min("old").alias("old"))
        known = cut(docs.join(old, "id", "left").join(classes.select("text", "class"), "text", "left").select("id", "place", "text", "url", "class", "old"))
        state, links = self._decide(known, classes, signs)
        fresh = hubs_of(known.filter("old IS NULL"))
        accepted = fresh.join(state.filter("status = 'accepted'").select("id"), "id", "left_semi")
        # a hub accepts one document at most: any other of its members matches it
        kept = accepted.groupBy("hub").agg(F.min("place").alias("accepted"))
        new = _heard(known, links).join(kept, "hub").filter(F.col("accepted") < F.col("place")).groupBy("id").agg(F.min("accepted.id").alias("new"))
        out = known.select("id", "old").join(new, "id", "left").select(F.least("old", "new").alias("kept_id"), F.col("id").alias("repeat_id")).filter("kept_id IS NOT NULL")
        if keep:
            out = cut(out)
            texts = known.filter("class IS NOT NULL").join(state.filter("status = 'accepted'").select("id"), "id", "left_semi").select("id", "class")
            named = classes.join(texts, "class").select("class", F.col("id").alias("as"), "letters")
            own = cut(signs.join(named.select("class", "as"), "class").drop("class").withColumnRenamed("as", "class"))
            self.accept(cut(named.select(F.col("as").alias("class"), "letters")), own, accepted.select("hub", "id"))
        return out

    def _decide(self, known: DataFrame, classes: DataFrame, signs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(id, place, status) of the documents that nothing of the history matches, and all links (class, text) between texts."""
        open_ = known.filter("old IS NULL")
        state = cut(open_.select("id", "place", F.lit("open").alias("status")))
        targets = open_.filter("class IS NOT NULL").groupBy("class").agg(F.min("place").alias("first"), F.min("id").alias("least"))
        # what still asks: open texts for all, others for ids smaller than the one they have
        asking = lambda bound: known.filter("class IS NOT NULL").groupBy("class").agg(F.max(F.coalesce(bound, F.lit(2**63 - 1))).alias("bound"))
        # ranges with a single text have nothing to compare: most of them
        placed = planted(signs, "class").repartition("bucket")
        shared = placed.groupBy("bucket").agg(F.min("class").alias("from"), F.max("class").alias("to")).filter(F.col("from") != F.col("to"))
        rows = cut(placed.join(shared, "bucket", "left_semi"))
        aims = cut(rows.join(targets, "class"))
        earliest = Window.partitionBy("bucket").orderBy("first")
        ranked = cut(aims.withColumn("rank", F.row_number().over(earliest)).filter(F.col("rank") <= HEADS + 1))
        heads = ranked.filter(F.col("rank") <= HEADS)
        near = close_sketches("w", "r", OVERLAP) & within_prefix("w", "r", prefix_length(OVERLAP, TREES, RECALL)) & (F.col("w.class") != F.col("r.class")) & (F.col("r.least") < F.col("w.bound"))
        pair = [F.col("w.class").alias("a"), F.col("r.class").alias("b")]
        asked = rows.join(asking(F.col("old")), "class")
        first = cut(verified(look_up(asked, [heads], "bucket", pair, near).distinct(), classes, classes))
        links = _both_ways(first, classes)
        crowded = cut(ranked.filter(F.col("rank") == HEADS + 1).select("bucket"))
        if not crowded.isEmpty():
            # a text may only be accepted yet if all that precede it in its ranges were compared
            full = aims.join(crowded, "bucket", "left_semi")
            behind = full.join(heads.select("bucket", "class"), ["bucket", "class"], "left_anti").select("class").distinct()
            unsure = open_.join(full.select("class", "first").distinct(), "class").join(behind.withColumn("behind", F.lit(True)), "class", "left")
            unsure = cut(unsure.filter(F.col("behind") | (F.col("place") != F.col("first"))).select("id").distinct())
            state = _settled(state, open_, links, unsure)
            hit = state.filter("status = 'repeat'").select("id")
            alive = open_.join(hit, "id", "left_anti").filter("class IS NOT NULL").select("class").distinct()
            told = hubs_of(open_).join(state.filter("status = 'accepted'").select("id"), "id", "left_semi").groupBy("hub").agg(F.min("id").alias("new"))
            sure = _heard(known, links).join(told, "hub").filter("new != id").groupBy("id").agg(F.min("new").alias("new")).join(hit, "id", "left_semi")
            bounds = known.join(sure, "id", "left").withColumn("best", F.least("old", "new"))
            still = bounds.filter("class IS NOT NULL").groupBy("class").agg(F.max(F.coalesce("best", F.lit(2**63 - 1))).alias("bound"))
            late = full.join(heads.select("bucket", "class"), ["bucket", "class"], "left_anti").join(alive, "class", "left_semi")
            asked = rows.join(crowded, "bucket", "left_semi").join(still, "class")
            second = cut(verified(look_up(asked, [late], "bucket", pair, near).distinct().join(first, ["a", "b"], "left_anti"), classes, classes))
            links = _both_ways(first.unionByName(second), classes)
        state = _settled(state, open_, links)
        return (state if state.filter("status = 'open'").isEmpty() else _walked(state, open_, links)), links


def _both_ways(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, hub): the text hubs that the members of a class listen to besides their own."""
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return cut(ways.join(classes.select(F.col("class").alias("b"), F.col("text").alias("hub")), "b").select(F.col("a").alias("class"), "hub"))


def _heard(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(id, place, hub): the hubs whose accepted members a document repeats."""
    linked = docs.filter("class IS NOT NULL").join(links, "class").select("id", "place", "hub")
    return hubs_of(docs).unionByName(linked)


def _told(state: DataFrame, open_: DataFrame, heard: DataFrame) -> DataFrame:
    """(id, hit, wait): of each open document, whether an accepted one and whether an open one precedes it in its hubs."""
    alive = hubs_of(open_).select("id", "hub").join(state.filter("status != 'repeat'"), "id")
    hubs = alive.groupBy("hub").agg(
        F.min(F.when(F.col("status") == "accepted", F.col("place"))).alias("accepted"), F.min(F.when(F.col("status") == "open", F.col("place"))).alias("open")
    )
    before = lambda c: F.max(F.coalesce(F.col(c) < F.col("place"), F.lit(False)))
    asking = heard.join(state.filter("status = 'open'").select("id"), "id", "left_semi")
    return asking.join(hubs, "hub", "left").groupBy("id").agg(before("accepted").alias("hit"), before("open").alias("wait"))


def _settled(state: DataFrame, open_: DataFrame, links: DataFrame, unsure: DataFrame | None = None) -> DataFrame:
    """Decide in rounds: a document is a repeat once an accepted one precedes it in its hubs, accepted once nothing open does.

    ``unsure`` documents are not accepted. A document without hubs is accepted. After
    ROUNDS rounds, or one that decides nothing, the rest stays open.
    """
    heard = cut(_heard(open_, links))
    left = None
    for _ in range(ROUNDS):
        told = _told(state, open_, heard)
        rows = state.join(told, "id", "left")
        free = ~F.coalesce("wait", F.lit(False))
        if unsure is not None:
            rows = rows.join(unsure.withColumn("unsure", F.lit(True)), "id", "left")
            free = free & F.col("unsure").isNull()
        verdict = F.when(F.col("status") != "open", F.col("status")).when(F.col("hit"), "repeat").when(free, "accepted").otherwise("open")
        state = cut(rows.select("id", "place", verdict.alias("status")))
        now = state.filter("status = 'open'").count()
        if now in (0, left):
            break
        left = now
    return state


def _walked(state: DataFrame, open_: DataFrame, links: DataFrame) -> DataFrame:
    """Decide what long chains left open: each connected component of open documents in order of place, in one stream.

    A task keeps the hubs that a component's walk accepted, nothing else; components
    are spread over the tasks.
    """
    heard = cut(_heard(open_, links))
    hit = _told(state, open_, heard).select("id", "hit")
    waiting = state.filter("status = 'open'").select("id")
    own = hubs_of(open_).join(waiting, "id", "left_semi").select("id", "hub")
    asked = heard.join(waiting, "id", "left_semi").join(own.select("hub").distinct(), "hub", "left_semi")
    edges = asked.select(F.concat(F.lit("d"), "id").alias("a"), F.col("hub").alias("b"))
    parts = connected_components(cut(edges.distinct())).select(F.col("node").alias("key"), "component")
    lists = asked.groupBy("id", "place").agg(F.collect_set("hub").alias("heard")).join(own.groupBy("id").agg(F.collect_set("hub").alias("own")), "id", "left").join(hit, "id")
    rows = lists.withColumn("key", F.concat(F.lit("d"), "id")).join(parts, "key", "left").select(F.coalesce("component", "key").alias("component"), "place", "id", "heard", "own", "hit")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, accepted = None, set()
        for frame in frames:
            verdicts = []
            for part, heard_, own_, hit_ in zip(frame.component, frame.heard, frame.own, frame.hit):
                if part != now:
                    now, accepted = part, set()
                repeat = bool(hit_) or not accepted.isdisjoint(heard_)
                if not repeat and own_ is not None:
                    accepted.update(own_)
                verdicts.append("repeat" if repeat else "accepted")
            yield pd.DataFrame({"id": frame.id, "verdict": verdicts})

    ordered = rows.repartition("component").sortWithinPartitions("component", "place")
    verdicts = ordered.mapInPandas(run, f"id {open_.schema['id'].dataType.simpleString()}, verdict string")
    return cut(state.join(verdicts, "id", "left").select("id", "place", F.when(F.col("status") == "open", F.col("verdict")).otherwise(F.col("status")).alias("status")))


def repeats(documents: DataFrame) -> DataFrame:
    """(kept_id, repeat_id): the documents of later batches that repeat an accepted one.

    Documents are gone through by batch_no, then id. All of batch 0 are accepted; a
    later one is a repeat if its URL equals that of an accepted one or its text is
    similar to it, else accepted; kept_id is the smallest id it matches. Batch 0 is
    planted as a history; all later batches are absorbed at once, in their order,
    which gives what absorbing them one by one does.

    Null, blank and short bodies match by URL only; null, relative and pathless URLs
    by text only; a document with neither is accepted. Empty tables give no rows.
    A null batch_no counts as batch 0. ``id`` must be unique.
    """
    spark = documents.sparkSession
    history = History(spark, shared_table(spark, "history"))
    first = F.coalesce("batch_no", F.lit(0)) == 0
    history.start(documents.filter(first))
    out = cut(history.absorb(documents.filter(~first), keep=False))
    history.drop()
    return out
