"""Bucketed runs: appending, merging by size, looking up without a shuffle of the runs."""

from pyspark.sql import functions as F

from docloom.sources.runs import BucketedRuns, look_up


def test_runs_are_merged_and_looked_up(spark, tmp_path):
    made = BucketedRuns(spark, str(tmp_path / "t"), "k", ("v",), "v")
    assert made.rows() is None and look_up(spark.range(1), [], "id", []) is None
    for i, n in enumerate((100, 10, 9, 4, 0)):
        made.append(spark.range(n).select((F.col("id") % 5).alias("k"), (F.col("id") + 1000 * i).alias("v")), n)
    again = BucketedRuns(spark, str(tmp_path / "t"), "k", ("v",), "v")
    assert [e.rows for e in again.entries()] == [100, 19, 4] and again.rows().count() == 123
    first = again.runs()[0].filter("k = 3").orderBy("rank").limit(2).collect()
    assert [(r.v, r["rank"]) for r in first] == [(3, 1), (8, 2)]
    wanted = spark.createDataFrame([(3,), (77,)], "k long")
    found = look_up(wanted, again.runs(), "k", [F.col("r.v").alias("v")], F.col("r.rank") == 1)
    assert sorted(r.v for r in found.collect()) == [3, 1003, 3003]  # ranks are those of the merged run
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = look_up(wanted, again.runs()[:1], "k", [F.col("r.v")])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # only what is looked for moves
    again.drop()
    assert not (tmp_path / "t").exists()


def test_a_write_that_failed_leaves_the_runs(spark, tmp_path):
    made = BucketedRuns(spark, str(tmp_path / "t"), "k")
    made.append(spark.range(8).select(F.col("id").alias("k")), 8)
    broken = spark.range(4).select(F.expr("CAST(raise_error('lost') AS BIGINT)").alias("k"))
    try:
        made.append(broken, 4)
    except Exception:
        pass
    assert made.rows().count() == 8
    made.append(spark.range(3).select(F.col("id").alias("k")), 3)
    assert made.rows().count() == 11
