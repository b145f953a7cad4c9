"""Queries over the raw change feed: current records (p3) and instants (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..operators.changes import current_records
from ..operators.instants import normalised_instants
from ..session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_records(table(spark, sf_dir, "raw_items"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    def items(name: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col("id").alias("record_id"), "endpoint_id", "published_at")

    return normalised_instants(items("raw_items").unionByName(items("normalized_documents")), table(spark, sf_dir, "source_endpoints"))


QUERIES = {"p3_found": p3_found, "p5_found": p5_found}

SQL = {
    "p3_found": f"""
WITH c AS (
  SELECT endpoint_id, trim(native_id, '{WHITE_SPACE}') AS native_id, ledger_seq, fetched_at, id,
         nullif(regexp_extract(lower(trim(content_hash, '{WHITE_SPACE}')), '(?:^|[^0-9a-f])([0-9a-f]{{64}})$', 1), '') AS content_hash,
         coalesce(regexp_replace(lower(operation), '\\s+', '', 'g') IN ('withdraw', 'remove', 'delete'), false) AS gone
  FROM raw_items WHERE trim(native_id, '{WHITE_SPACE}') <> ''
), r AS (
  SELECT *, row_number() OVER (PARTITION BY endpoint_id, native_id
    ORDER BY ledger_seq DESC NULLS LAST, fetched_at DESC NULLS LAST, id DESC) AS n FROM c
)
SELECT endpoint_id, native_id, content_hash FROM r WHERE n = 1 AND NOT gone AND endpoint_id IS NOT NULL""",
}
