"""Mixed timestamp spellings and zones, normalised through a dictionary of distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import epoch_micros, zone_abbreviations
from ..functions.text import strip
from ..session import cut

KEYS = ("spelling", "policy_timezone", "policy_date_order")


def spelled_times(items: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(table_name, record_id, spelling, zone, order) of all items with a non-blank time.

    ``items`` has table_name, record_id, endpoint_id and published_at. The endpoint
    registry has one row per configured feed and is kept by hand, so it is broadcast;
    an item of an unknown endpoint keeps null conventions and only its absolute times count.
    """
    known = endpoints.select(F.col("id").alias("endpoint_id"), "policy_timezone", "policy_date_order").dropDuplicates(["endpoint_id"])
    return (
        items.withColumn("spelling", strip(F.col("published_at")))
        .filter(F.col("spelling") != "")
        .join(F.broadcast(known), "endpoint_id", "left")
        .select("table_name", "record_id", *KEYS)
    )


def parse_dictionary(spellings: DataFrame) -> DataFrame:
    """Every distinct (spelling, zone, order) once, with its instant; unreadable ones keep a null.

    The null is kept on purpose: an incremental run must know that the spelling was tried.
    """
    zones = zone_abbreviations(spellings.sparkSession)
    distinct = spellings.select(*KEYS).distinct().join(F.broadcast(zones), "policy_timezone", "left")
    return epoch_micros(distinct, "spelling", "policy_timezone", "policy_date_order", "offsets").select(*KEYS, "epoch_us")


def extend_dictionary(path: str, spellings: DataFrame) -> DataFrame:
    """Parse only what the dictionary stored at ``path`` lacks, append it, and return the whole."""
    spark = spellings.sparkSession
    fresh = spellings.select(*KEYS).distinct()
    try:
        stored = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    else:
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"d.{k}")) for k in KEYS]
        fresh = fresh.alias("n").join(stored.alias("d"), same, "left_anti")
    parse_dictionary(fresh).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def attach_instants(times: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The instants of the dictionary joined back to the rows; rows without one are left out."""
    readable = dictionary.filter(F.col("epoch_us").isNotNull())
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}")) for k in KEYS]
    return times.alias("t").join(readable.alias("d"), same).select("t.table_name", "t.record_id", "d.epoch_us")


def normalised_instants(items: DataFrame, endpoints: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """(table_name, record_id, epoch_us): the UTC instant of each item that names one.

    Raw strings are deduplicated with the zone and date order they are read in, each
    is parsed once, and the instants are joined back to the rows. With
    ``dictionary_path`` the dictionary is kept there and only grows by what is new.
    Rows with a null, blank, unreadable or impossible time are left out; repeated
    ids stay repeated rows; empty tables give no rows.
    """
    times = spelled_times(items, endpoints)
    # materialised: a filter on the instants would otherwise be pushed down as a second copy of the whole parser
    dictionary = extend_dictionary(dictionary_path, times) if dictionary_path else cut(parse_dictionary(times))
    return attach_instants(times, dictionary)
