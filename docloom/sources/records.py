"""Record-level scans: files that feeds were saved to become one schema of change records.

Fetching itself (HTTP, rate limits, browsers) is no data-processing concern and is
left out; every scan here reads files with a fixed schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import concatenated_sha256

RECORD = "native_id string, title string, body string, url string, published_at string, content_hash string, operation string"

_ENTRY = T.StructType().add("id", "string").add("guid", "string").add("title", "string").add("summary", "string").add("description", "string").add("link", "string").add("published", "string").add("pubDate", "string").add("updated", "string")


def _record(native: Column, title: Column, body: Column, url: Column, at: Column) -> list[Column]:
    return [
        native.alias("native_id"), title.alias("title"), body.alias("body"), url.alias("url"), at.alias("published_at"),
        concatenated_sha256(native, title, body).alias("content_hash"), F.lit("upsert").alias("operation"),
    ]


def scan_feed(spark: SparkSession, path: str, entry: str = "item") -> DataFrame:
    """RSS items or Atom entries; the id is guid, id or link, the time published else updated."""
    rows = spark.read.format("xml").option("rowTag", entry).schema(_ENTRY).load(path)
    at = F.coalesce("published", "pubDate", "updated")
    return rows.select(*_record(F.coalesce("guid", "id", "link"), F.col("title"), F.coalesce("summary", "description"), F.col("link"), at))


def scan_sitemap(spark: SparkSession, path: str, allowed: str = ".*", overlap_hours: int = 72, watermark: Column | None = None, most: int | None = None) -> DataFrame:
    """(url, lastmod) of a sitemap, without queries, newest first; with a watermark only what is at most ``overlap_hours`` older."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    found = rows.select(F.regexp_replace(F.trim("loc"), r"[?#].*$", "").alias("url"), F.try_to_timestamp("lastmod").alias("lastmod")).filter(F.col("url").rlike(allowed))
    if watermark is not None:
        found = found.filter(F.col("lastmod").isNull() | (F.col("lastmod") >= watermark - F.make_interval(hours=F.lit(overlap_hours))))
    found = found.groupBy("url").agg(F.max("lastmod").alias("lastmod"))
    return found.orderBy(F.col("lastmod").desc_nulls_last(), "url").limit(most) if most else found


def scan_json_list(spark: SparkSession, path: str, list_key: str, item: T.StructType | str, id_field: str, nested: str | None = None) -> DataFrame:
    """The items of saved JSON pages: a list under ``list_key``, each perhaps wrapped in ``nested``.

    ``item`` is a struct type or its fields as ``name: type, ...``; items without an id are dropped.
    """
    inner = item.simpleString() if isinstance(item, T.StructType) else f"STRUCT<{item}>"
    element = f"STRUCT<`{nested}`: {inner}>" if nested else inner
    pages = spark.read.option("multiLine", "true").schema(f"`{list_key}` ARRAY<{element}>").json(path)
    items = pages.select(F.explode(list_key).alias("i")).select(f"i.{nested}.*" if nested else "i.*")
    return items.filter(F.col(id_field).isNotNull())


def scan_jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A JSONL dataset without blank and # lines; rows that lack a required key go to ``_bad``.

    ``_bad`` holds the raw line of an unreadable or incomplete row, else null.
    """
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\s*[^#\s]"))
    rows = lines.select("value", F.from_json("value", schema).alias("r"))
    whole = F.col("r").isNotNull()
    for key in required:
        whole = whole & F.col(f"r.{key}").isNotNull()
    return rows.select("r.*", F.when(~whole, F.col("value")).alias("_bad"))


def scan_pages(spark: SparkSession, path: str, known_hash: str | None = None) -> DataFrame:
    """Saved pages as content-addressed blobs (path, digest, content); unchanged ones are skipped."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("digest"), "content")
    return rows.filter(F.col("digest") != known_hash) if known_hash else rows


def changed_only(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records whose (native_id, content_hash) isn't known yet."""
    return records.dropDuplicates(["native_id", "content_hash"]).join(known.select("native_id", "content_hash"), ["native_id", "content_hash"], "left_anti")


def snapshot_changes(snapshot: DataFrame, active: DataFrame) -> DataFrame:
    """A full snapshot as changes: everything in it, and a withdrawal of each active id that it lacks."""
    gone = active.select("native_id").distinct().join(snapshot.select("native_id"), "native_id", "left_anti").withColumn("operation", F.lit("withdraw"))
    return snapshot.unionByName(gone, allowMissingColumns=True)


def ledger_changes(changes: DataFrame, active: DataFrame) -> DataFrame:
    """A change ledger without removals of what isn't active."""
    removal = F.lower("operation") == "remove"
    known = active.select(F.col("native_id").alias("k")).distinct()
    joined = changes.join(known, changes.native_id == known.k, "left")
    return joined.filter(~F.coalesce(removal, F.lit(False)) | F.col("k").isNotNull()).drop("k")


def id_year(native_id: Column, first: int) -> Column:
    """Whether a CVE id is of ``first`` or a later year; ids without a year are not."""
    return F.coalesce(F.regexp_extract(native_id, r"(?i)^CVE-(\d{4})-", 1).try_cast("int") >= first, F.lit(False))


def catch_up_windows(spark: SparkSession, start: str, end: str, days: int = 7, overlap_minutes: int = 15) -> DataFrame:
    """(since, until): consecutive windows from start to end, each reaching back by the overlap for late data."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    begins = spark.range(1).select(F.explode(F.sequence(first, last, F.make_interval(days=F.lit(days)))).alias("b")).filter(F.col("b") < last)
    return begins.select((F.col("b") - F.make_interval(mins=F.lit(overlap_minutes))).alias("since"), F.least(F.col("b") + F.make_interval(days=F.lit(days)), last).alias("until"))


def bounded_windows(counts: DataFrame, target: int) -> DataFrame:
    """Admission: the minutes' counts (at, n) cut into windows that hold at most ``target`` rows, unless one minute alone has more."""
    from pyspark.sql import Window

    day = F.to_date("at")
    order = Window.partitionBy("day").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("day", day).withColumn("part", F.floor(F.coalesce(F.sum("n").over(order), F.lit(0)) / target))
    return before.groupBy("day", "part").agg(F.min("at").alias("since"), F.max("at").alias("until"), F.sum("n").alias("rows"))
