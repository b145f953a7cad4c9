"""Vector neighbours and near-duplicate history against brute force."""

import random

import numpy as np
import pytest

from docloom.llm import forest, history, neighbours

SCHEMA = "id long, execution_version string, dimensions int, vector array<float>, space string, bits long"


def vectors(rng, n=600, d=24):
    centres = rng.normal(size=(n // 6, d))
    out = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, d)) * 0.15
    return (out * rng.uniform(0.01, 100, (n, 1))).astype(np.float32)


def brute(ids, x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    found = {}
    for i in range(len(ids)):
        order = np.lexsort((ids, -np.round(s[i], 9)))[:k]
        found[ids[i]] = [int(ids[j]) for j in order if s[i, j] >= least]
    return found


def test_recall_and_exact_order(spark):
    rng = np.random.default_rng(3)
    x = vectors(rng)
    ids = np.arange(1000, 1000 + len(x))
    rows = [(int(i), "v", x.shape[1], v.tolist(), "clash", 1) for i, v in zip(ids, x)]
    got = {}
    for r in neighbours.most_similar(spark.createDataFrame(rows, SCHEMA), 10, 0.9).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.other_id)
    want = brute(ids, x, 10, 0.9)
    pairs = {(a, b) for a, bs in want.items() for b in bs}
    assert len(pairs & {(a, b) for a, bs in got.items() for b in bs}) >= 0.95 * len(pairs)


def test_dense_topics_keep_their_recall_and_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=32) / 32**0.5
    x = np.concatenate([centre + rng.normal(size=(4000, 32)) * 0.06, rng.normal(size=(1500, 32))]).astype(np.float32)  # one topic holds most vectors
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), "v", 32, v.tolist(), "clash", 1) for i, v in zip(ids, x)], SCHEMA)
    found = lambda: {(r.id, r.other_id) for r in neighbours.most_similar(df, 10, 0.9).collect()}
    got = found()
    want = {(int(a), b) for a, bs in brute(ids, x, 10, 0.9).items() for b in bs}
    assert len(want) > 30_000 and len(got & want) >= 0.97 * len(want)
    monkeypatch.setattr(neighbours, "BLOCK", 300)  # ranges in many blocks
    assert len(found() ^ got) <= 2  # rounding of equal cosines


def test_prefixes_find_their_cosine_and_trees_grow():
    for cosine in (0.9, 0.95, 0.99):
        bits = neighbours.prefix_bits(cosine, 16)
        missed = lambda n: (1 - (1 - np.arccos(cosine) / np.pi) ** n) ** 16  # noqa: B023, E731
        assert missed(bits) <= 0.02 < missed(bits + 1)
    assert neighbours.prefix_bits(1.0, 16) == 64 and neighbours.trees_for(50_000, 0.9) == 16
    assert [neighbours.trees_for(10**n, 0.9) for n in (6, 7, 8)] == [32, 64, 64]


def test_copies_unusable_and_ties(spark):
    v = [1.0, 2.0, 0.0]
    rows = [(i, "v", 3, v, None, 0) for i in range(1, 31)]  # one class holds most rows
    rows += [(40, "v", 3, [-0.0, 1.0, 0.0], None, 0), (41, "v", 3, [0.0, 2.0, 0.0], None, 0), (42, "w", 3, v, None, 0)]
    rows += [(50, "v", 3, None, None, 0), (51, "v", 4, v, None, 0), (52, "v", 3, [0.0, 0.0, 0.0], None, 0), (53, "v", 3, [float("nan"), 1.0, 1.0], None, 0)]
    rows += [(54, "v", 3, [float("inf"), 1.0, 1.0], None, 0), (55, "v", 3, [None, 1.0, 1.0], None, 0), (56, None, 3, [3e38, 3e38, 3e38], None, 0), (57, None, 3, [1e-30, 1e-30, 1e-30], None, 0)]
    found = neighbours.most_similar(spark.createDataFrame(rows, SCHEMA), 10, 0.9).collect()
    near = {}
    for r in found:
        near.setdefault(r.id, []).append(r.other_id)
    assert near[1] == list(range(2, 12)) and near[30] == list(range(1, 11))
    assert near[40] == [41] and near[56] == [57]
    assert set(near) == {*range(1, 31), 40, 41, 56, 57}
    assert neighbours.similar_pairs(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_the_prefix_widens_until_the_recall_is_reached():
    assert forest.prefix_length(0.95, 64, 0.98) == forest.DEPTH and forest.prefix_length(0.5, 64, 0.98) == forest.ROOT
    for s in (0.5, 0.6, 0.7, 0.8):
        x = forest.prefix_length(s, 64, 0.98)
        assert 1 - (1 - s**x) ** 64 >= 0.98 and (x == forest.DEPTH or 1 - (1 - s ** (x + 1)) ** 64 < 0.98)


def test_min_hash_values_agree_with_the_overlap(monkeypatch):
    rng = random.Random(1)
    apart = []
    for _ in range(60):
        a = "".join(rng.choice("abcdefghij") for _ in range(rng.choice([250, 900, 4000])))
        c = rng.randrange(len(a))
        b = a[:c] + "".join(rng.choice("klmnop") for _ in range(len(a) - c))
        x, y = (forest.distinct_runs(t, 8) for t in (a, b))
        least = forest.minima([a, b], 8)
        apart.append(np.mean(least[0] == least[1]) - len(np.intersect1d(x, y)) / len(np.union1d(x, y)))
    assert abs(np.mean(apart)) < 0.02 and np.std(apart) < 0.05
    texts = ["a" * 30, "a" * 50, "a" * 7 + "b", "x" + a, a]
    whole = forest.minima(texts, 8)
    assert (whole[0] == whole[1]).all() and not (whole[0] == whole[2]).any()
    monkeypatch.setattr(forest, "BLOCK", 100)  # long texts in pieces: the same values
    assert (forest.minima(texts, 8) == whole).all()
    assert len(forest.distinct_runs("short", 8)) == 0


def fold(rows):
    """The statement, word for word."""
    from docloom.functions import urls  # noqa: F401

    def letters(t):
        return "".join(c for c in (t or "").lower() if c.isalnum())

    accepted, out = [], []
    for doc, batch, url, body in sorted(rows, key=lambda r: (r[1], r[0])):
        t = letters(body)
        s = {t[i : i + 8] for i in range(len(t) - 7)} if len(t) >= 200 else set()
        hits = [a for a, u, o in accepted if (url and u == url) or (s and o and len(s & o) * 2 >= len(s | o))]
        if batch and hits:
            out.append((min(hits), doc))
        else:
            accepted.append((doc, url, s))
    return sorted(out)


def documents(spark, rows):
    data = [(d, b, u, t, "x", 1) for d, b, u, t in rows]
    return spark.createDataFrame(data, "id long, batch_no int, canonical_url string, body_text string, text_key string, class int")


def found(df):
    return sorted((r.kept_id, r.repeat_id) for r in history.repeats(df).collect())


def words(rng, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_follow_the_fold(spark, seed):
    rng = random.Random(seed)
    base = [words(rng) for _ in range(12)]
    rows = []
    for i in range(120):
        t = rng.choice(base)
        cut = rng.choice([0, 0, 60, 120, 200])
        body = t[cut:] + words(rng, cut // 7)
        url = rng.choice([None, f"https://h/{rng.randrange(40)}"])
        rows.append((1000 - i if seed == 2 else i, rng.choice([0, 0, 1, 2, 3]), url, rng.choice([body, body.upper(), None, "", "  "])))
    assert found(documents(spark, rows)) == fold(rows)


def test_hot_group_of_similar_texts_links_to_its_first(spark):
    rng = random.Random(5)
    text = words(rng, 80)
    rows = [(i, int(i >= 150), None, text + words(rng, 3)) for i in range(300)]  # every text differs
    got = found(documents(spark, rows))
    assert [b for _, b in got] == list(range(150, 300)) and {a for a, _ in got} == {0}


def test_similar_later_texts_need_few_links(spark, monkeypatch):
    rng = random.Random(6)
    text = words(rng, 80)
    compared = []
    plain = history.verified

    def counted(pairs, left, right):
        compared.append(pairs.count())
        return plain(pairs, left, right)

    monkeypatch.setattr(history, "verified", counted)
    rows = [(i, 1 + i % 3, None, text + words(rng, 3)) for i in range(600)]  # all texts differ, none is of the history
    made = []
    for n in (200, 600):
        assert found(documents(spark, rows[:n])) == fold(rows[:n])
        made.append(sum(compared))
        compared.clear()
    assert made[1] <= 4 * made[0]  # three times the texts; nine times as many pairs


def test_a_long_chain_is_settled(spark):
    rng = random.Random(7)
    blocks = ["".join(rng.choice("abcdefgh") for _ in range(70)) for _ in range(504)]
    rows = [(i, 1, None, "".join(blocks[i : i + 4])) for i in range(500)]  # each overlaps only with the ones beside it
    got = found(documents(spark, rows))
    assert got == [(i - 1, i) for i in range(1, 500, 2)]


def test_batches_one_by_one_are_as_all_at_once_and_sign_nothing_twice(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    base = [words(rng) for _ in range(15)]
    rows = []
    for i in range(160):
        body = rng.choice(base)[rng.choice([0, 0, 60, 120]) :] + words(rng, rng.choice([0, 5, 20]))
        rows.append((i, i // 40, rng.choice([None, f"https://h/{rng.randrange(60)}"]), body))
    seen = []
    plain = history.signed

    def counted(texts, *more):
        seen.append(sorted(r[0] for r in texts.select("letters").collect()))
        return plain(texts, *more)

    monkeypatch.setattr(history, "signed", counted)
    kept = history.History(spark, str(tmp_path / "h"))
    kept.start(documents(spark, [r for r in rows if r[1] == 0]))
    got = []
    for n in (1, 2, 3):
        kept = history.History(spark, str(tmp_path / "h"))  # opened again by its path
        got += [(r.kept_id, r.repeat_id) for r in kept.absorb(documents(spark, [r for r in rows if r[1] == n])).collect()]
    assert sorted(got) == fold(rows)
    for n, texts in enumerate(seen):
        own = documents(spark, [r for r in rows if r[1] == n])
        assert texts == sorted(r[0] for r in history.text_classes(history.comparable(own)).select("letters").collect())
    assert len(kept.forest.entries()) <= 2  # merged by size
    kept.drop()


def test_heads_do_not_hide_the_rest(spark, monkeypatch):
    monkeypatch.setattr(history, "HEADS", 2)
    test_repeats_follow_the_fold(spark, 1)


def test_urls(spark):
    same = ["https://H.example/a?x=1", "HTTPS://h.EXAMPLE/a/?utm_source=z&x=1#f", "https://h.example/a?ref=q&x=1&UTM_campaign=1"]
    rows = [(i, i, u, None) for i, u in enumerate(same)]
    rows += [(10, 1, "https://h.example/", None), (11, 2, "https://h.example", None), (12, 3, None, None), (13, 3, "not a url", None), (14, 4, "https://h.example/A?x=1", None)]
    assert found(documents(spark, rows)) == [(0, 1), (0, 2)]
    assert history.repeats(documents(spark, rows).limit(0)).isEmpty()
