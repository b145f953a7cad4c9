"""Append-only tables of bucketed, sorted runs that are merged by size."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sinks import VersionedTable


class BucketedRuns:
    """A table kept as runs: each is bucketed by one column and sorted within its buckets.

    A search joins the few rows it looks for with every run on that column. The runs
    are read bucket by bucket and are never shuffled, whatever their size; only what
    is looked for is. A new run is appended; then the last runs are merged while one
    is less than twice as large as the next, so there are about log2 of all rows runs
    and a row is rewritten as often. Which runs count is a small versioned manifest,
    published after the data is written: a failed write leaves the former runs. One
    writer at a time. With ``ranked`` a run also keeps each row's rank by that column
    within its value of the bucketing column, so that a value's first rows can be read
    without sorting.
    """

    #: Rows that a bucket of a run holds on average.
    BUCKET_ROWS = 2_000_000

    def __init__(self, spark: SparkSession, path: str, by: str, order: tuple[str, ...] = (), ranked: str | None = None) -> None:
        self.spark, self.path, self.by, self.order, self.ranked = spark, path.rstrip("/"), by, order, ranked
        self.manifest = VersionedTable(spark, f"{self.path}/manifest")

    def entries(self) -> list:
        """(run, rows, buckets, columns) of the runs that count, oldest first."""
        known = self.manifest.read()
        # one row per run: about the logarithm of the table's rows
        return [] if known is None else sorted(known.collect(), key=lambda r: r.run)

    def _open(self, entry) -> DataFrame:
        """The run as a bucketed table; another session names it again by its path."""
        where = f"{self.path}/run={entry.run}"
        name = f"docloom_{hashlib.md5(where.encode()).hexdigest()}"
        if not self.spark.catalog.tableExists(name):
            order = f" SORTED BY ({', '.join((self.by, *self.order))})"
            self.spark.sql(f"CREATE TABLE {name} ({entry.columns}) USING parquet CLUSTERED BY ({self.by}){order} INTO {entry.buckets} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [self._open(e) for e in self.entries()]

    def _plain(self, entry) -> DataFrame:
        """The run without its buckets: a union of bucketed scans would be taken as bucketed even where the scans no longer are."""
        return self.spark.read.schema(entry.columns).parquet(f"{self.path}/run={entry.run}")

    def rows(self) -> DataFrame | None:
        """All runs as one table; null before the first."""
        out = None
        for entry in self.entries():
            out = self._plain(entry) if out is None else out.unionByName(self._plain(entry))
        return out

    def _write(self, rows: DataFrame, run: int, n: int) -> tuple:
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / self.BUCKET_ROWS))
        where = f"{self.path}/run={run}"
        name = f"docloom_{hashlib.md5(where.encode()).hexdigest()}"
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        # one task a bucket, so each bucket is one sorted file
        placed = rows.repartition(buckets, self.by)
        if self.ranked:
            placed = placed.withColumn("rank", F.row_number().over(Window.partitionBy(self.by).orderBy(self.ranked)))
        placed.write.mode("overwrite").bucketBy(buckets, self.by).sortBy(self.by, *self.order).option("path", where).saveAsTable(name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
        return run, n, buckets, columns

    def append(self, rows: DataFrame, n: int) -> None:
        """Add a run of ``n`` rows; no rows add nothing."""
        if not n:
            return
        kept = [tuple(e) for e in self.entries()]
        number = max((e[0] for e in kept), default=-1) + 1
        kept.append(self._write(rows, number, n))
        spent = []
        while len(kept) > 1 and kept[-2][1] < 2 * kept[-1][1]:
            last, before = kept.pop(), kept.pop()
            number += 1
            pair = [self._plain(self._entry(e)) for e in (before, last)]
            kept.append(self._write(pair[0].unionByName(pair[1]), number, before[1] + last[1]))
            spent += [before, last]
        self.manifest.publish(self.spark.createDataFrame(kept, self._SCHEMA).coalesce(1))
        for e in spent:
            self._remove(e[0])

    _SCHEMA = "run int, rows bigint, buckets int, columns string"

    @staticmethod
    def _entry(values: tuple):
        from pyspark.sql import Row

        return Row(run=values[0], rows=values[1], buckets=values[2], columns=values[3])

    def _remove(self, run: int) -> None:
        where = f"{self.path}/run={run}"
        self.spark.sql(f"DROP TABLE IF EXISTS docloom_{hashlib.md5(where.encode()).hexdigest()}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self) -> None:
        for e in self.entries():
            self._remove(e.run)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def look_up(wanted: DataFrame, runs: list[DataFrame], on: str, columns: list[F.Column], test: F.Column | None = None) -> DataFrame | None:
    """``columns`` of the rows w (wanted) and r (a run) that agree in ``on`` and pass ``test``, over all runs; null without runs."""
    out = None
    for run in runs:
        met = wanted.alias("w").join(run.alias("r"), F.col(f"w.{on}") == F.col(f"r.{on}"))
        found = (met if test is None else met.filter(test)).select(*columns)
        out = found if out is None else out.unionByName(found)
    return out
