"""Sinks: exports, manifests and versioned tables without MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export(df: DataFrame, path: str, form: str) -> None:
    """jsonl, csv (lists joined by ;, other nested values as JSON) or parquet."""
    if form == "jsonl":
        df.write.mode("overwrite").json(path)
    elif form == "csv":
        flat = []
        for f in df.schema:
            if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
                flat.append(F.concat_ws(";", f.name).alias(f.name))
            elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
                flat.append(F.to_json(f.name).alias(f.name))
            else:
                flat.append(F.col(f.name))
        df.select(*flat).write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    elif form == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def script_safe_json(value: F.Column) -> F.Column:
    """JSON that can stand in an HTML script element."""
    out = F.to_json(value)
    for mark, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


class VersionedTable:
    """A table as numbered Parquet versions; readers see the newest that was published.

    A version is written whole and then published by its success mark, so a lost
    executor or driver leaves the version before in place. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def versions(self) -> list[int]:
        if not self._files.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at(self.path))]
        numbers = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
        return sorted(n for n in numbers if self._files.exists(self._at(f"{self.path}/v={n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The newest version not after ``version``; null if there is none."""
        known = [v for v in self.versions() if version is None or v <= version]
        return self.spark.read.parquet(f"{self.path}/v={known[-1]}") if known else None

    def publish(self, df: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        return version

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        """Publish the table with ``rows`` in the place of what has their keys; the newest version stays readable."""
        stored = self.read()
        kept = rows if stored is None else stored.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
        return self.publish(kept)
