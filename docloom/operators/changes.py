"""Applying a change feed of inserts, updates and deletes to a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: The operations that remove a record; all others set it.
REMOVALS = ("withdraw", "remove", "delete")


def is_removal(operation: Column, removals: Sequence[str] = REMOVALS) -> Column:
    """Never null: a missing operation sets the record. Case and spacing don't matter."""
    plain = F.lower(F.regexp_replace(operation, r"(?U)\s+", ""))
    return F.coalesce(plain.isin(*removals), F.lit(False))


def sha256_hex(digest: Column) -> Column:
    """64 lower-case hex digits of a digest however it is spelled; null if there are none.

    Prefixes that name the algorithm (``sha256:``) and white space are dropped.
    """
    found = F.regexp_extract(F.lower(strip(digest)), r"(?:^|[^0-9a-f])([0-9a-f]{64})$", 1)
    return F.when(found != "", found)


def apply_changes(
    changes: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    removed: Column,
    base: DataFrame | None = None,
) -> DataFrame:
    """The table that stands after all ``changes`` have been applied to ``base``.

    Of every key the last change counts, by the columns ``order`` one after the
    other; a null sorts before every value, so a change without a number is older
    than all numbered ones. Repeated and late changes therefore need no special
    case: applying a feed twice, or in any row order, gives the same table. Keys
    with a null part concern no record and are left out. ``base`` (same columns, or
    fewer: the missing ones become null) counts as older than every change.

    The rank-1 window is planned with a group limit below the exchange, so each
    task ships at most one row a key: a key with a third of all changes costs no
    more than any other. Ties in all of ``order`` are one change received twice;
    pass a unique last column for a defined row.

    An empty feed gives ``base``, or no rows.
    """
    marks = {"__base": F.lit(1), "__gone": removed}
    feed = changes.withColumns(marks)
    if base is not None:
        feed = feed.unionByName(base.withColumns({"__base": F.lit(0), "__gone": F.lit(False)}), allowMissingColumns=True)
    for key in keys:
        feed = feed.filter(F.col(key).isNotNull())
    latest = Window.partitionBy(*keys).orderBy(F.col("__base").desc(), *(F.col(c).desc_nulls_last() for c in order))
    return (
        feed.withColumn("__rank", F.row_number().over(latest))
        .filter((F.col("__rank") == 1) & ~F.col("__gone"))
        .drop("__rank", "__base", "__gone")
    )


def current_records(raw_items: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(endpoint_id, native_id, content_hash) of the records that exist in the end.

    native_id is compared without surrounding white space, by case; a blank one
    concerns no record. A record whose last change has no digest has a null one.
    """
    changes = raw_items.select(
        "endpoint_id",
        strip(F.col("native_id")).alias("native_id"),
        sha256_hex(F.col("content_hash")).alias("content_hash"),
        is_removal(F.col("operation")).alias("gone"),
        "ledger_seq",
        "fetched_at",
        "id",
    ).filter(F.col("native_id") != "")
    out = apply_changes(changes, ("endpoint_id", "native_id"), ("ledger_seq", "fetched_at", "id"), F.col("gone"), base)
    return out.select("endpoint_id", "native_id", "content_hash")
