"""Structured Streaming over change feeds: latest state, deduplication, windows, endpoint health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import apply_changes
from ..sources.sinks import VersionedTable


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A directory of Parquet files as a stream; the checkpoint's offsets stand for the cursor of a feed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def apply_stream(changes: DataFrame, table_path: str, checkpoint: str, keys: list[str], order: list[str], removed: F.Column):
    """Keep a versioned table at the state after all changes, batch by batch.

    The table keeps removed records as marked rows with their order, so that a
    change that arrives late can't bring back what a later one removed; a batch that
    is delivered again changes nothing.
    """

    def merge(batch: DataFrame, _: int) -> None:
        table = VersionedTable(batch.sparkSession, table_path)
        stored, marked = table.read(), batch.withColumn("removed", removed)
        both = marked if stored is None else stored.unionByName(marked, allowMissingColumns=True)
        table.publish(apply_changes(both, keys, order, F.lit(False)))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(changes: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    """Each key once among what arrives within ``delay``, with bounded state."""
    return changes.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, at: str, by: list[str], size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows, final once the watermark passes."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return rows.withWatermark(at, delay).groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), *by, "n", "value")


def endpoint_health(runs: DataFrame, threshold: int = 5, degraded: int = 3) -> DataFrame:
    """(endpoint_id, failures, health) after each batch of fetch runs (endpoint_id, at, ok): a stateful count of failures in a row.

    active, degraded from ``degraded`` failures, open from ``threshold``; a success closes it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures = state.get[0] if state.exists else 0
        whole = pd.concat(list(frames)).sort_values("at")
        for ok in whole.ok:
            failures = 0 if ok else failures + 1
        state.update((failures,))
        health = "open" if failures >= threshold else "degraded" if failures >= degraded else "active"
        yield pd.DataFrame({"endpoint_id": [key[0]], "failures": [failures], "health": [health]})

    return runs.groupBy("endpoint_id").applyInPandasWithState(run, "endpoint_id string, failures int, health string", "failures int", "update", "NoTimeout")
