"""The lines that p7 removes are those of the mined sequences; cleaned bodies equal their SQL."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from docloom.llm import queries, repeated_lines

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
def test_cleaned_bodies_equal_their_sql(spark):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want = dict(con.sql(queries.SQL["p7_clean"]).fetchall())
    assert {r.id: r.body_text for r in queries.p7_clean(spark, SF).collect()} == want


def test_lines_of_all_frequent_sequences_are_the_lines_removed(spark):
    furniture = ["Share this", "All rights reserved 2024", "Read more", "By staff 7"]
    rows = []
    for i in range(40):
        lines = [f"own text {chr(97 + i % 26)}{chr(97 + i // 26)}", *[x for j, x in enumerate(furniture) if (i + j) % 4], f"end {chr(97 + i % 26)} {'x' * i}"]
        rows.append((i, "e1" if i % 3 else "e2", "\n".join(lines)))
    docs = spark.createDataFrame(rows, "id long, endpoint_id string, body_text string")
    mined = repeated_lines.frequent_sequences(docs)
    assert mined.agg(F.max("length")).head()[0] >= 3
    patterns = {}
    for r in mined.collect():
        patterns.setdefault(r.endpoint_id, []).append(r.pattern)
    want = set()
    for r in repeated_lines.line_ids(docs).collect():
        for pattern in patterns.get(r.endpoint_id, []):
            places, at = [], 0
            for line in pattern:  # does the document hold the sequence, gaps allowed?
                if line not in r.lines[at:]:
                    break
                at = r.lines.index(line, at) + 1
                places.append(line)
            if len(places) == len(pattern):
                want |= {(r.id, n) for n, line in enumerate(r.lines) if line in pattern}
    assert {tuple(r) for r in repeated_lines.repeated_lines(docs).collect()} == want
