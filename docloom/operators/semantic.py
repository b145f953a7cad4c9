"""Atomic events: shared-entity candidates, verdicts, claim merging and vector recall."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of claim values that contradict each other.
OPPOSITES = (("exploited", "not_exploited"), ("affected", "unaffected"), ("patched", "unpatched"), ("confirmed", "denied"), ("active", "inactive"))


def shared_entity_pairs(mentions: DataFrame, bucket: int = 100) -> DataFrame:
    """(left_id, right_id, shared): atomic events of different documents that mention the same entity.

    ``mentions`` has atomic_id, document_id, entity. Each event meets the ``bucket``
    events before it with the entity, which is the candidate index's definition.
    """
    distinct = mentions.filter("entity IS NOT NULL").select("atomic_id", "document_id", "entity").distinct()
    place = distinct.withColumn("n", F.row_number().over(Window.partitionBy("entity").orderBy("atomic_id")))
    later = place.withColumn("block", F.explode(F.array(F.floor(F.col("n") / bucket), F.floor(F.col("n") / bucket) - 1)))
    earlier = place.withColumn("block", F.floor(F.col("n") / bucket))
    pairs = later.alias("r").join(earlier.alias("l"), ["entity", "block"]).filter((F.col("l.n") < F.col("r.n")) & (F.col("r.n") - F.col("l.n") <= bucket) & (F.col("l.document_id") != F.col("r.document_id")))
    return pairs.groupBy(F.col("l.atomic_id").alias("left_id"), F.col("r.atomic_id").alias("right_id")).agg(F.min("entity").alias("shared"))


def shared_entity_classes(mentions: DataFrame) -> DataFrame:
    """(entity, document_id, representative, atomic_id): the events of each document that mention an entity of several.

    Two events are a pair if they have a row of one entity and different documents:
    all pairs without any window, in as many rows as there are mentions. Counts and
    minima are combined before the shuffle.
    """
    distinct = mentions.filter("entity IS NOT NULL AND document_id IS NOT NULL").select("atomic_id", "document_id", "entity").distinct()
    classes = distinct.groupBy("entity", "document_id").agg(F.min("atomic_id").alias("representative"))
    several = classes.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("entity")
    return distinct.join(classes, ["entity", "document_id"]).join(several, "entity").select("entity", "document_id", "representative", "atomic_id")


def adjudicate(pairs: DataFrame, days: int = 30) -> DataFrame:
    """decision, confidence and reason of pairs of atomic events, by rules in order.

    ``pairs`` has l_/r_ fingerprint, document_id, at, and shared (null: no shared entity).
    """
    close = F.coalesce(F.abs(F.unix_micros(F.col("l_at").cast("timestamp")) - F.unix_micros(F.col("r_at").cast("timestamp"))) <= days * 86_400_000_000, F.lit(False))
    verdict = lambda d, c, r: F.struct(F.lit(d).alias("decision"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    rule = (
        F.when(F.col("l_fingerprint") == F.col("r_fingerprint"), verdict("same_event", 0.95, "identical_atomic_fingerprint"))
        .when(F.col("l_document_id") == F.col("r_document_id"), verdict("different_event", 0.9, "same_document"))
        .when(F.col("shared").isNotNull() & close, verdict("related_event", 0.7, "shared_entity_and_time"))
        .otherwise(verdict("different_event", 0.6, "no_supporting_signal"))
    )
    return pairs.select("left_id", "right_id", rule.alias("v")).select("left_id", "right_id", "v.decision", "v.confidence", "v.reason")


def fan_out(documents: DataFrame, output: str, schema: str) -> DataFrame:
    """One row per atomic event of a model's JSON answer, with its fingerprint; unreadable answers give none.

    ``schema`` must hold events array<struct<type,subject,action,object,time_text>>.
    """
    events = documents.select("document_id", F.posexplode(F.from_json(output, schema)["events"]).alias("position", "e"))
    parts = ["type", "subject", "action", "object", "time_text"]
    plain = [F.coalesce(F.lower(F.trim(F.regexp_replace(F.col(f"e.{p}"), r"(?U)\s+", " "))), F.lit("")) for p in parts]
    return events.select("document_id", "position", *(F.col(f"e.{p}").alias(p) for p in parts), F.sha2(F.concat(*plain), 256).alias("fingerprint"))


def merge_claims(claims: DataFrame, by: list[str]) -> DataFrame:
    """Claims of equal type and value as one: representative text, documents, mean confidence to three places."""
    return claims.groupBy(*by, "claim_type", "value").agg(
        F.max_by("text", F.struct("confidence", -F.col("document_id"))).alias("text"),
        F.array_sort(F.collect_set("document_id")).alias("documents"),
        F.round(F.avg("confidence"), 3).alias("confidence"),
    )


def contradictions(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, claim_type, left_value, right_value): opposite values of one type, found by an equi-join on the opposite."""
    table = F.create_map(*(F.lit(x) for a, b in OPPOSITES for x in (a, b, b, a)), F.lit("true"), F.lit("false"), F.lit("false"), F.lit("true"))
    plain = values.select(*by, "claim_type", F.lower("value").alias("value")).distinct().withColumn("opposite", F.try_element_at(table, F.col("value")))
    left, right = plain.filter("opposite IS NOT NULL").alias("l"), plain.alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*by, "claim_type")] + [F.col("l.opposite") == F.col("r.value"), F.col("l.value") < F.col("r.value")]
    return left.join(right, same).select(*(F.col(f"l.{c}").alias(c) for c in (*by, "claim_type")), F.col("l.value").alias("left_value"), F.col("r.value").alias("right_value"))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    """-1 for unequal lengths, empty vectors and norms that aren't positive."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    usable = (F.size(left) == F.size(right)) & (F.size(left) > 0) & (norm(left) > 0) & (norm(right) > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot / (norm(left) * norm(right))).otherwise(-1.0)


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``cosine`` of each row of ``a`` and ``b``, float64 of one length: summed in the same order, so equal to the last bit."""
    sums = np.zeros((3, len(a)))
    with np.errstate(all="ignore"):
        for x, y in zip(a.T, b.T):
            sums += np.stack([x * y, x * x, y * y])
        left, right = np.sqrt(sums[1]), np.sqrt(sums[2])
        # as in the engine, NaN is larger than any number
        return np.where(~(left <= 0) & ~(right <= 0), sums[0] / (left * right), -1.0)


#: What a cosine of unit vectors may be off by, and more than rounding to six places moves it.
SLACK = 1e-5


def nearest_in(left: list, right: list, allowed: np.ndarray, rank: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, cosine): of the allowed pairs of vectors, all that can be among the ``k`` best of left[i] at the threshold or more.

    Products of unit vectors leave out what is further from that than ``SLACK``; the
    rest is computed as ``cosine`` does. Of equal cosines the ``k`` smallest ranks are kept.
    """
    sizes = [np.array([len(v) for v in side], np.int64) for side in (left, right)]
    near, groups = np.full(allowed.shape, -1.0), {}
    for size in set(sizes[0].tolist()) & set(sizes[1].tolist()) - {0}:
        rows = [np.nonzero(s == size)[0] for s in sizes]
        values = [np.stack([side[n] for n in r]).astype(np.float64) for side, r in zip((left, right), rows)]
        with np.errstate(all="ignore"):
            norms = [np.sqrt((v * v).sum(axis=1)) for v in values]
            # NaN, which nothing leaves out, where the norm is too small or large for the bound
            units = [np.where(((n > 1e-100) & (n < 1e100))[:, None], v / n[:, None], np.nan) for v, n in zip(values, norms)]
            near[np.ix_(*rows)] = units[0] @ units[1].T
        groups[size] = (*rows, *values)
    kept = allowed & ~(near < threshold - SLACK)
    many = np.nonzero(kept.sum(axis=1) > k)[0]
    if len(many):
        sure = np.where(kept[many] & ~np.isnan(near[many]), near[many], -np.inf)
        least = np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k]
        kept[many] &= ~(near[many] < least[:, None] - SLACK)
    i, j = np.nonzero(kept)
    exact = np.full(len(i), -1.0)
    for size, (x, y, a, b) in groups.items():
        own = np.nonzero((sizes[0][i] == size) & (sizes[1][j] == size))[0]
        for start in range(0, len(own), 65536):
            part = own[start : start + 65536]
            exact[part] = _cosines(a[np.searchsorted(x, i[part])], b[np.searchsorted(y, j[part])])
    order = np.lexsort((rank[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | ~((exact[1:] == exact[:-1]) | (np.isnan(exact[1:]) & np.isnan(exact[:-1])))
    place = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0)) if len(i) else i
    return i[place < k], j[place < k], exact[place < k]


def _blocks(rows: DataFrame, name: str, block: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the number of their block of about ``block`` rows of one space and bucket, and the blocks there are."""
    parts = rows.groupBy("space", "bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    placed = rows.join(parts, ["space", "bucket"]).withColumn(name, F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    return placed, parts.select("space", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias(name))


def _scored_in_blocks(looking: DataFrame, bucketed: DataFrame, span: int, k: int, threshold: float, block: int) -> DataFrame:
    """(seed_id, id, cosine) of each block of seeds and block of the pool: what can be among the ``k`` best of a seed, computed over arrays."""
    usable = "id IS NOT NULL AND t IS NOT NULL AND space IS NOT NULL"
    # a vector with a null is as unlike everything as an empty one
    plain = F.when(F.coalesce(F.exists("vector", lambda x: x.isNull()), F.lit(True)), F.array().cast("array<double>")).otherwise(F.col("vector").cast("array<double>"))
    (seeds, here), (pool, there) = (_blocks(side.filter(usable).select("id", "space", "bucket", "t", plain.alias("vector")), n, block) for side, n in ((looking, "x"), (bucketed, "y")))
    keys = ["space", "bucket", "x", "y"]

    def compared(seeds: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.rename(columns=lambda c: c.removeprefix("p_"))
        ids = [side["id"].to_numpy() for side in (seeds, pool)]
        known = np.unique(np.concatenate(ids))
        rank, t = [np.searchsorted(known, x) for x in ids], [side["t"].to_numpy(np.int64) for side in (seeds, pool)]
        vectors, found = [list(side["vector"]) for side in (seeds, pool)], []
        for start in range(0, len(seeds) if len(pool) else 0, 256):
            here = slice(start, start + 256)
            allowed = (rank[1][None, :] < rank[0][here, None]) & (np.abs(t[0][here, None] - t[1][None, :]) <= span)
            i, j, value = nearest_in(vectors[0][here], vectors[1], allowed, rank[1], k, threshold)
            found.append(pd.DataFrame({"seed_id": ids[0][here][i], "id": ids[1][j], "cosine": value}))
        return pd.concat(found) if found else pd.DataFrame({"seed_id": ids[0][:0], "id": ids[1][:0], "cosine": np.empty(0)})

    kinds = [dict(side.dtypes)["id"] for side in (looking, bucketed)]
    # other names: both sides may come from one table
    other = pool.join(here, ["space", "bucket"]).select(*(F.col(c).alias(f"p_{c}") for c in (*keys, "id", "t", "vector")))
    met = seeds.join(there, ["space", "bucket"]).groupBy(*keys).cogroup(other.groupBy(*(f"p_{c}" for c in keys)))
    found = met.applyInPandas(compared, f"seed_id {kinds[0]}, id {kinds[1]}, cosine double")
    # NaN comes back from pandas as null
    return found.withColumn("cosine", F.coalesce("cosine", F.lit(float("nan"))))


def recall_in_window(seeds: DataFrame, pool: DataFrame, days: int = 30, k: int = 10, threshold: float = 0.82, newest: int | None = None, block: int = 4000) -> DataFrame:
    """(seed_id, id, similarity): the k most similar earlier vectors within ``days`` of each seed, then the threshold.

    Both sides have id, space, at, vector. A band join: each pool row sits in one
    bucket of ``days`` days, a seed looks into three; so only vectors near in time
    are compared, in blocks of about ``block`` rows a side. Top-k comes before the threshold. Null times never match. ``newest``
    compares each seed with so many of the largest ids only (the feature of a bounded pool).
    """
    span = days * 86_400_000_000
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    bucketed = pool.withColumn("t", micros).withColumn("bucket", F.floor(F.col("t") / span))
    looking = seeds.withColumn("t", micros).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("t") / span) - 1, F.floor(F.col("t") / span) + 1)))
    if newest is None:
        scored = _scored_in_blocks(looking, bucketed, span, k, threshold, block).select("seed_id", "id", F.round("cosine", 6).alias("similarity"))
    else:
        pairs = looking.alias("s").join(bucketed.alias("p"), ["space", "bucket"]).filter((F.col("p.id") < F.col("s.id")) & (F.abs(F.col("s.t") - F.col("p.t")) <= span))
        latest = Window.partitionBy("s.id").orderBy(F.col("p.id").desc())
        pairs = pairs.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= newest)
        scored = pairs.select(F.col("s.id").alias("seed_id"), F.col("p.id").alias("id"), F.round(cosine(F.col("s.vector"), F.col("p.vector")), 6).alias("similarity"))
    best = Window.partitionBy("seed_id").orderBy(F.col("similarity").desc(), "id")
    return scored.withColumn("n", F.row_number().over(best)).filter((F.col("n") <= k) & (F.col("similarity") >= threshold)).drop("n")
