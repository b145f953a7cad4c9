"""Change feeds: order, repetition, lateness, dirty spellings, extra columns, hypothesis against a plain fold."""

from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators.changes import apply_changes, current_records, sha256_hex

SCHEMA = "id long, endpoint_id string, native_id string, content_hash string, operation string, ledger_seq long, fetched_at timestamp"
T0 = datetime(2025, 1, 1)


def records(spark, rows):
    return {(r.endpoint_id, r.native_id): r.content_hash for r in current_records(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_order_removal_and_spelling(spark):
    h = "a" * 64
    rows = [
        (1, "e", " x ", "SHA256:" + h.upper(), "insert", 1, T0),
        (2, "e", "x", "b" * 64, " DE lete ", 2, T0),
        (3, "e", "x　", h, None, 3, T0),  # set again after the removal
        (4, "e", "X", h, "upsert", 1, T0),  # case distinguishes
        (5, "e", "y", h, "update", 5, T0),
        (6, "e", "y", None, "REMOVE", 5, T0),  # corrected under the old number: the later id counts
        (7, "e", None, h, "upsert", 9, T0),
        (8, "e", "  ", h, "upsert", 9, T0),
        (9, None, "z", h, "upsert", 1, T0),
        (10, "e", "n", h, "noop", None, T0),  # a change without a number is older than numbered ones
        (11, "e", "n", "not a digest", "noop", 0, T0),
    ]
    assert records(spark, rows) == {("e", "x"): h, ("e", "X"): h, ("e", "n"): None}


def test_empty_feed_and_base(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert current_records(empty).count() == 0
    base = spark.createDataFrame([("e", "x", "c" * 64)], "endpoint_id string, native_id string, content_hash string")
    assert [tuple(r) for r in current_records(empty, base).collect()] == [("e", "x", "c" * 64)]
    gone = spark.createDataFrame([(1, "e", "x", None, "delete", None, T0)], SCHEMA)
    assert current_records(gone, base).count() == 0


def test_extra_columns_survive(spark):
    rows = spark.createDataFrame([(1, "k", 5, "extra", True)], "id long, key string, seq long, rank string, gone boolean")
    out = apply_changes(rows, ["key"], ["seq", "id"], F.lit(False))
    assert out.columns == ["id", "key", "seq", "rank", "gone"] and out.count() == 1


def test_digest(spark):
    df = spark.createDataFrame([("A" * 64,), (" sha256:" + "b" * 64 + "\n",), ("c" * 63,), ("d" * 65,), (None,), ("",)], "h string")
    got = [r[0] for r in df.select(sha256_hex(F.col("h"))).collect()]
    assert got == ["a" * 64, "b" * 64, None, None, None, None]


change = st.tuples(st.sampled_from("ab"), st.sampled_from(["upsert", "delete"]), st.one_of(st.none(), st.integers(0, 4)), st.integers(0, 2))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(change, max_size=12), st.randoms())
def test_any_arrival_order_gives_the_fold(spark, changes, random):
    rows = [(i, "e", k, f"{i:064x}", op, seq, datetime(2025, 1, 1 + day)) for i, (k, op, seq, day) in enumerate(changes)]
    want = {}
    for r in sorted(rows, key=lambda r: (r[5] is not None, r[5] or 0, r[6], r[0])):
        want.pop(("e", r[2]), None)
        if r[4] != "delete":
            want["e", r[2]] = r[3]
    random.shuffle(rows)
    assert records(spark, rows + rows[:3]) == want
