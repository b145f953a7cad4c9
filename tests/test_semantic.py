"""Candidates of a shared entity: classes lose no pair, however many events an entity has."""

import random
from datetime import datetime, timedelta

from docloom.operators import semantic


def test_entity_classes_hold_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, 1 if i < 150 else rng.randrange(40), "hot") for i in range(400)] + [(500, 7, "alone"), (501, 7, "alone"), (502, 8, None)]
    df = spark.createDataFrame(rows + rows[:9], "atomic_id long, document_id long, entity string")
    got = semantic.shared_entity_classes(df).collect()
    pairs = {(a.atomic_id, b.atomic_id) for a in got for b in got if a.atomic_id < b.atomic_id and a.entity == b.entity and a.document_id != b.document_id}
    assert pairs == {(a, b) for a, d, e in rows for b, f, g in rows if a < b and e is not None and e == g and d != f}
    assert len(got) == 400 and all(r.representative == min(x.atomic_id for x in got if (x.entity, x.document_id) == (r.entity, r.document_id)) for r in got)


def test_recall_in_blocks_is_that_of_single_pairs(spark):
    rng = random.Random(7)
    topics = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan")] * 4, [float("inf"), 1.0, 1.0, 1.0], [1e-30] * 4, [3e38] * 4, [1.0, 2.0]]
    vectors = [rng.choice(odd) if rng.random() < 0.1 else [x + rng.gauss(0, 0.3) for x in rng.choice(topics)] if rng.random() < 0.6 else topics[0] for _ in range(400)]
    rows = [(i, rng.choice("ab"), None if rng.random() < 0.05 else datetime(2026, 7, 1) + timedelta(days=rng.randrange(90)), v) for i, v in enumerate(vectors)]
    pool = spark.createDataFrame(rows, "id long, space string, at timestamp, vector array<float>")
    for k, threshold in ((10, 0.82), (3, -1.0)):
        got, want = (semantic.recall_in_window(pool.filter("id % 3 = 0"), pool, k=k, threshold=threshold, **how).collect() for how in ({"block": 50}, {"newest": 10**6}))
        assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 300
    plan = semantic.recall_in_window(pool, pool)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "zip_with" not in plan
