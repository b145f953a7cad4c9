"""Times as written against expected instants; the dictionary grows only by what is new."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators.instants import extend_dictionary, normalised_instants, spelled_times

ENDPOINTS = [("ny", "America/New_York", "mdy"), ("be", "Europe/Berlin", "dmy"), ("sh", "Asia/Shanghai", "ymd"), ("in", "Asia/Kolkata", "dmy"), ("bad", "Nowhere/City", "dmy")]


def us(*args, micro=0):
    return int(datetime(*args, tzinfo=UTC).timestamp()) * 1_000_000 + micro


CASES = [
    ("be", "2024-02-11T17:49:34+01:00", us(2024, 2, 11, 16, 49, 34)),
    ("be", "2024-02-05T05:45:36,923", us(2024, 2, 5, 4, 45, 36, micro=923000)),
    ("be", "1707960654.495731", us(2024, 2, 15, 1, 30, 54, micro=495731)),
    ("be", "1707013333140", us(2024, 2, 4, 2, 22, 13, micro=140000)),
    ("be", "1706971137404153", us(2024, 2, 3, 14, 38, 57, micro=404153)),
    ("be", "20240203T205503Z", us(2024, 2, 3, 20, 55, 3)),
    ("be", "2024-02-11T04:15:37.103351999Z", us(2024, 2, 11, 4, 15, 37, micro=103351)),
    ("be", "2024-02-12T23:23:02+01:00[Europe/Madrid]", us(2024, 2, 12, 22, 23, 2)),
    ("ny", "2024-02-12 10:00[Asia/Tokyo]", us(2024, 2, 12, 1)),
    ("be", "Tue, 13 Feb 2024 01:51:16 +0100", us(2024, 2, 13, 0, 51, 16)),
    ("sh", "Tue, 4 Jun 2024 05:10:27 UTC", us(2024, 6, 4, 5, 10, 27)),
    ("ny", "Apr 24, 2024 1:41 p.m.", us(2024, 4, 24, 17, 41)),
    ("ny", "Apr 24, 2024 12:05 AM", us(2024, 4, 24, 4, 5)),
    ("ny", "3/14/2024 1:48 PM", us(2024, 3, 14, 17, 48)),
    ("be", "3/4/2024 1:48 PM", us(2024, 4, 3, 11, 48)),
    ("be", "27.10.2024 03:38:55", us(2024, 10, 27, 2, 38, 55)),
    ("be", "28. Oktober 2024, 02:28 Uhr", us(2024, 10, 28, 1, 28)),
    ("be", "1 novembre 2024 à 13h05", us(2024, 11, 1, 12, 5)),
    ("be", "22 de febrero de 2024 05:17", us(2024, 2, 22, 4, 17)),
    ("sh", "2024年6月29日 12:08", us(2024, 6, 29, 4, 8)),
    ("sh", "2024-02-20 01:56:17 CST", us(2024, 2, 19, 17, 56, 17)),
    ("in", "2024-02-20 01:56:17 IST", us(2024, 2, 19, 20, 26, 17)),
    ("ny", "2024-11-03 01:30:00 EST", us(2024, 11, 3, 6, 30)),
    ("ny", "2024-11-03 01:30:00", us(2024, 11, 3, 5, 30)),  # happened twice: the earlier
    ("ny", "2024-03-10 02:30:00", us(2024, 3, 10, 7, 30)),  # skipped: as if the clock hadn't changed
    ("be", " \t2024-02-01\n", us(2024, 1, 31, 23)),
    ("be", "2024-02-30", None),
    ("be", "31/31/2025 09:00", None),
    ("be", "2024-02-01 25:00", None),
    ("be", "13:00 PM", None),
    ("be", "gestern", None),
    ("be", "2024|01|01", None),
    ("be", "2024-01-01 10:00[Mars/Olympus]", None),
    ("bad", "2024-01-01 10:00", None),
    ("bad", "2024-01-01 10:00Z", us(2024, 1, 1, 10)),
    ("unknown", "2024-01-01T10:00+02", us(2024, 1, 1, 8)),
    ("unknown", "2024-01-01 10:00", None),
    ("be", "", None),
    ("be", None, None),
]


@pytest.fixture(scope="module")
def endpoints(spark):
    return spark.createDataFrame(ENDPOINTS, "id string, policy_timezone string, policy_date_order string")


def items(spark, rows):
    return spark.createDataFrame([("t", i, e, s) for i, (e, s, *_) in enumerate(rows)], "table_name string, record_id long, endpoint_id string, published_at string")


def test_spellings(spark, endpoints):
    got = {r.record_id: r.epoch_us for r in normalised_instants(items(spark, CASES), endpoints).collect()}
    wrong = [(c, got.get(i)) for i, c in enumerate(CASES) if got.get(i) != c[2]]
    assert not wrong


def test_session_zone_does_not_matter(spark, endpoints):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        test_spellings(spark, endpoints)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dictionary_grows_incrementally(spark, endpoints, tmp_path):
    path = str(tmp_path / "dictionary")
    first = spelled_times(items(spark, CASES[:5]), endpoints)
    assert extend_dictionary(path, first).count() == 5
    again = spelled_times(items(spark, CASES[:5] + CASES[3:8]), endpoints)
    stored = extend_dictionary(path, again)
    assert stored.count() == 8
    assert stored.groupBy("spelling", "policy_timezone", "policy_date_order").count().filter(F.col("count") > 1).isEmpty()
    kept = normalised_instants(items(spark, CASES), endpoints, path)
    assert kept.count() == sum(c[2] is not None for c in CASES)


def test_empty(spark, endpoints):
    assert normalised_instants(items(spark, CASES[:1]).limit(0), endpoints).isEmpty()
