"""Groups against union-find, survivors against the stated order, currency reasoning, repeated lines."""

import random
from datetime import datetime

from docloom.llm import groups, repeated_lines, survivors

DAY = datetime(2025, 1, 1)


def groups_of(spark, links):
    df = spark.createDataFrame([(a, b, "v") for a, b in links], "document_id long, near_dup_of long, member string")
    return {r.member: r.group_id for r in groups.consolidate(df, "document_id", "near_dup_of").collect()}


def test_random_graphs_and_long_chains(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    links += [(1000 + i, 1001 + i) for i in range(60)]  # a chain
    links += [(5000, 5001 + i) for i in range(200)]  # a star
    links += [(7, None), (8, 8), (9000, None), (9001, 9001), (None, 9002), (None, None)] + links[:20] + [(b, a) for a, b in links[:20]]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        ends = [x for x in (a, b) if x is not None]
        roots = sorted(find(x) for x in ends)
        if len(ends) == 2:
            root[roots[1]] = roots[0]
    assert groups_of(spark, links) == {x: find(x) for x in root}


def test_no_links(spark):
    df = spark.createDataFrame([], "document_id long, near_dup_of long")
    assert groups.consolidate(df, "document_id", "near_dup_of").isEmpty()


COLUMNS = "id long, dedupe_component_id long, trust_tier string, parse_quality double, published_at timestamp, fetched_at timestamp, title string, body string, s string, t string"


def best(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS)
    return {r[0]: tuple(r[1:]) for r in survivors.best_representatives(df).collect()}


def test_order_of_members(spark):
    d = lambda n: datetime(2025, 1, n)
    rows = [
        (1, 1, "B", 0.9, d(5), d(6), " ", "b"), (2, 1, " a\t", 0.1, None, None, None, "　"), (3, 1, "A", float("nan"), d(9), d(1), "t", None),
        (4, 2, "?", 1.5, d(5), d(4), None, None), (5, 2, None, 0.0, d(3), None, "", ""), (6, 2, "D", None, d(3), d(3), "x", ""),
        (7, 3, "C", 0.5, d(1), d(2), "a", "a"), (8, 3, "C", 0.5, d(2), d(2), "a", "a"), (9, 3, "C", 0.5, d(2), d(3), "a", "a"),
        (10, None, "A", 1.0, d(1), d(1), "a", "a"), (11, 4, "A", 1.0, d(9), d(1), "", None),
        (12, 5, "A", float("inf"), None, None, "k", "k"), (12, 5, "A", float("inf"), None, None, "k", "k"),
    ]
    assert best(spark, rows) == {1: (2, 3, 1, 1), 2: (5, 6, 0, 5), 3: (8, 8, 8, 8), 4: (11, 0, 0, 0), 5: (12, 12, 12, 0)}
    assert best(spark, rows[:1])[1] == (1, 0, 1, 1)


def test_currency_reasoning(spark):
    rows = []
    for g in range(5):  # draft -> final -> retired, with times
        rows += [(g, "draft", datetime(2025, 1, 1)), (g, "final", datetime(2025, 1, 2)), (g, "retired", datetime(2025, 1, 3))]
    rows += [(10, "draft", datetime(2025, 1, 1)), (10, "final", None), (11, "retired", datetime(2025, 1, 1)), (11, "draft", None), (12, "final", None), (12, "draft", None), (13, None, None), (None, "x", DAY)]
    df = spark.createDataFrame(rows, "group_key long, value string, time timestamp")
    order = {(r.earlier, r.later) for r in survivors.learn_precedence(df).collect()}
    assert order == {("draft", "final"), ("final", "retired")}
    got = {r.group_key: (r.value, r.by) for r in survivors.current_values(df).collect()}
    assert got == {**{g: ("retired", "time") for g in range(5)}, 10: ("final", "precedence"), 11: ("retired", "time"), 12: ("final", "precedence")}
    assert survivors.current_values(df.limit(0)).isEmpty()


def page(*lines):
    return "\n".join(lines)


def test_repeated_lines(spark):
    rows = [(i, "e", page(f"unique {i} word{chr(97 + i)}", "Share  THIS 12", f"  share this {i}", "", "footer")) for i in range(10)]
    rows += [(20, "e", None), (21, "e", " \n "), (22, "f", page("Share this 1", "Share this 2")), (23, None, page("only")), (24, "e", page("rare", "rare", "rare", "rare"))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, endpoint_id string, body_text string, lines string")
    got = {(r.document_id, r.line_no) for r in repeated_lines.repeated_lines(df).collect()}
    assert got == {(i, n) for i in range(10) for n in (1, 2, 4)}
    clean = {r.id: r.body_text for r in repeated_lines.without_repeated_lines(df).collect()}
    assert clean[3] == "unique 3 wordd\n" and clean[20] is None and clean[21] == " \n " and clean[22] == page("Share this 1", "Share this 2")
    sequences = {(r.length, r.documents): len(r.pattern) for r in repeated_lines.frequent_sequences(df, 3).collect()}
    assert sequences == {(1, 10): 1, (2, 10): 2, (3, 10): 3}
    assert repeated_lines.repeated_lines(df.limit(0)).isEmpty()


def test_eight_percent_counts_documents_with_bodies(spark):
    rows = [(i, "e", "word " + "abcdefghij"[i % 10] * (i // 10 + 1)) for i in range(46)] + [(100 + i, "e", "same") for i in range(4)] + [(200 + i, "e", " ") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, endpoint_id string, body_text string")
    assert {r.document_id for r in repeated_lines.repeated_lines(df).collect()} == {100, 101, 102, 103}  # 4 of 50
    more = df.unionByName(spark.createDataFrame([(300, "e", "one more")], df.schema))
    assert repeated_lines.repeated_lines(more).isEmpty()  # 4 of 51


def test_sequences_are_mined_to_their_full_length(spark):
    rows = [(i, "e", page(f"own {'x' * (i + 1)}", "one", "two", f"gap {'y' * (i + 1)}", "three", "four", "five")) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, endpoint_id string, body_text string")
    lengths = [r.length for r in repeated_lines.frequent_sequences(df).collect()]
    assert {n: lengths.count(n) for n in lengths} == {1: 5, 2: 10, 3: 10, 4: 5, 5: 1}
    assert repeated_lines.frequent_sequences(df.limit(0)).isEmpty()


def test_precedence_is_transitive_and_loses_only_the_weakest_edge_of_a_cycle(spark):
    seen = {("a", "b"): 5, ("b", "c"): 4, ("c", "a"): 3, ("c", "d"): 6, ("d", "c"): 5}
    rows, g = [], 0
    for (x, y), n in seen.items():
        for _ in range(n):
            rows += [(g, x, datetime(2025, 1, 1)), (g, y, datetime(2025, 1, 2))]
            g += 1
    rows += [(100, "a", DAY), (100, "c", None), (101, "a", DAY), (101, "d", None), (101, "b", None), (102, "c", DAY), (102, "a", None), (103, "d", None), (103, "b", None)]
    df = spark.createDataFrame(rows, "group_key long, value string, time timestamp")
    assert {(r.earlier, r.later) for r in survivors.learn_precedence(df).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    got = {r.group_key: (r.value, r.by) for r in survivors.current_values(df).collect() if r.group_key >= 100}
    assert got == {100: ("c", "precedence"), 101: ("d", "precedence"), 102: ("c", "time"), 103: ("d", "precedence")}
