"""Deduplication cases, text functions, components against union-find, order invariance."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from docloom.functions import signatures, text, urls
from docloom.functions.similarity import _within, common_length, fold_title, folded_similarities, folded_similarity, indel_ratio, similar_in
from docloom.operators import dedupe, events
from docloom.operators.graph import connected_components

DOC = "id long, endpoint_id string, source_id string, source_family string, trust_tier string, title string, body string, canonical_url string, published_at timestamp, fetched_at timestamp, identifiers map<string,array<string>>, tech_directions array<string>, event_type string, parse_quality double"
T0 = datetime(2026, 7, 30)
LONG = "A long enough title about prompt injection in agent frameworks"


def doc(i, title="Short", url=None, body=None, tier="B", ids=None, at=T0, quality=0.8):
    return (i, f"e{i}", f"s{i}", None, tier, title, body, url or f"https://example.com/{i}", at, T0, ids or {}, [], "news", quality)


def decide(spark, *docs):
    rows = dedupe.deduplicate(spark.createDataFrame(list(docs), DOC)).collect()
    return {r.document_id: (r.near_dup_of, r.duplicate_kind, r.duplicate_score) for r in rows}


def test_folding_and_similarity():
    assert fold_title("Ｃｌａｕｄｅ：Agent-Security!") == "claude agent security"
    assert indel_ratio("", "") == 100.0 and common_length("abcbdab", "bdcaba") == 4
    assert folded_similarity("b a", "a b") == 100.0 and folded_similarity("", "a") == 0.0


def test_kinds(spark):
    body = "word " * 60
    got = decide(
        spark,
        doc(1, url="https://Example.com/x/", tier="C"), doc(2, url="https://example.com/x#frag", tier="A"),
        doc(3, LONG), doc(4, LONG.upper()), doc(5, LONG + " new", at=T0 + timedelta(days=3)),
        doc(6, "Some other heading here", body=body), doc(7, "Some other heading hero", body=body), doc(8, "Nothing alike", body=body, quality=float("nan")),
        doc(9, url="https://example.com/c", ids={"cve": ["CVE-2026-1111"]}), doc(10, url="https://example.com/c", ids={"cve": ["cve-2026-2222"]}),
    )
    assert got[1] == (2, "exact_url", 1.0) and got[2][0] is None
    assert got[5][0] is None and {got[i][:2] for i in (3, 4)} == {(5, "near_title")} and got[3][2] >= 0.94  # the longest title is the master
    assert got[7] == (6, "exact_content", 1.0) and got[8][0] is None
    assert got[9][0] is None and got[10][0] is None


def test_title_edges_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        ids = rng.choice([{}, {}, {"cve": ["CVE-2026-1111"]}, {"cve": ["CVE-2026-2222"]}, {"cve": ["CVE-2026-1111", "CVE-2026-3333"]}])
        at = rng.choice([None, *[T0 + timedelta(days=rng.randrange(0, 400))] * 12])
        rows.append(doc(i, LONG + str(rng.randrange(4)), ids=ids, at=at))
    docs = dedupe.prepared(spark.createDataFrame(rows, DOC))
    got = {r.node: r.component for r in connected_components(dedupe.exact_title_edges(docs)).collect()}
    flat = docs.select("id", "compact", "ids", "at").collect()
    root = {r.id: r.id for r in flat}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in flat:
        for b in flat:
            near = a["at"] is None or b["at"] is None or abs(a["at"] - b["at"]) <= timedelta(days=30)
            if a.id < b.id and a.compact == b.compact and near and not (a.ids and b.ids and not set(a.ids) & set(b.ids)):
                x, y = sorted((find(a.id), find(b.id)))
                root[y] = x
    want = {i: find(i) for i in root}
    alone = {i for i, c in want.items() if sum(v == c for v in want.values()) == 1}
    assert got == {i: c for i, c in want.items() if i not in alone}


def test_order_does_not_matter_and_empty(spark):
    docs = [doc(i, LONG + " x" * (i % 3), at=None if i % 5 == 0 else T0) for i in range(12)]
    shuffled = docs[:]
    random.Random(1).shuffle(shuffled)
    assert decide(spark, *docs) == decide(spark, *shuffled)
    assert dedupe.deduplicate(spark.createDataFrame([], DOC)).isEmpty()


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(1, None), (5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_event_keys_and_scores(spark):
    rows = [doc(1, ids={"cve": ["CVE-2026-1234", "bad", "CVE-2026-" + "9" * 500]}, tier="A"), doc(2, ids={"cve": ["cve-2026-1234"]}), doc(3, url="https://arxiv.org/abs/2607.26998v3"), doc(4, url="https://github.com/O/R/releases/tag/v1.0"), doc(5)]
    docs = spark.createDataFrame(rows, DOC)
    decisions = docs.select(F.col("id").alias("document_id"), F.lit(None).cast("long").alias("near_dup_of"), F.lit(None).cast("string").alias("duplicate_kind"))
    members = events.memberships(docs, decisions, F.lit(False))
    got = {r.fingerprint: r for r in events.event_drafts(docs, members).collect()}
    assert set(got) == {"cve:CVE-2026-1234", "arxiv:2607.26998", "github_release:o@r@v1.0", "document:5"}
    assert got["cve:CVE-2026-1234"].score == 40 + 25 + 7 + 12 and got["cve:CVE-2026-1234"].documents == 2
    assert got["document:5"].score == 28 + 5 + 0 + 12 and got["arxiv:2607.26998"].event_type == "research"


def test_many_keys_stay_with_their_documents(spark):
    docs = spark.createDataFrame([doc(i, ids={"cve": [f"CVE-2026-{1000 + i}"]}) for i in range(22)], DOC)
    decisions = docs.select(F.col("id").alias("document_id"), F.lit(0).cast("long").alias("near_dup_of"), F.lit("x").alias("duplicate_kind"))
    assert events.memberships(docs, decisions, F.lit(False)).count() == 22


def test_text_functions(spark):
    df = spark.createDataFrame([("https://H.example:80/a/?utm_source=x&b=1&ref=z#f", " \t"), (None, None), ("HTTP://H.example", "x" * 400)], "u string, b string")
    rows = df.select(urls.url_key(F.col("u")), urls.canonical_url(F.col("u")), text.clean_summary(F.col("b")), text.blank(F.col("b"))).collect()
    assert tuple(rows[0]) == ("https://h.example:80/a?utm_source=x&b=1&ref=z", "https://H.example:80/a/?b=1", "", True)
    assert tuple(rows[1]) == (None, None, "", True)
    assert rows[2][0] == "http://h.example/" and rows[2][2] == "x" * 300 + "…"
    aliases = spark.createDataFrame([("小agent大",), ("an Agent!",), ("agents",), (None,)], "t string")
    assert [r[0] for r in aliases.select(F.col("t").rlike(text.alias_pattern("agent"))).collect()] == [False, True, False, None]


def test_signatures(spark):
    import hashlib

    number = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:16], 16)
    rows = [("Prompt injection in 智能体框架 and more things", "zzzz " * 99 + "\n beyond"), (None, None), ("short", "words enough here"), ("Ｆｕｌｌ ＷＩＤＴＨ straße letters all in here", None)]
    got = signatures.with_signature(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, body string"), "title", "body").orderBy("id").collect()
    assert got[0].tokens == ["beyond", "injection", "more", "prompt", "things", "zzzz", "体框", "智能", "框架", "能体"]
    assert got[0].blocking == ["injection", "more", "prompt", "things", "体框", "智能", "框架", "能体", "beyond", "zzzz"]
    for r in got:
        ones = [sum(number(t) >> b & 1 for t in r.tokens) for b in range(64)]
        want = f"{sum(1 << b for b in range(64) if 2 * ones[b] >= len(r.tokens)):016x}" if r.tokens else None
        assert r.simhash == want
        assert r.minhash == [f"{min(number(f'{s}:{t}') for t in r.tokens):016x}" for s in range(16) if r.tokens]
    assert got[1].tokens == [] and got[1].simhash is None and got[2].blocking == [] and got[3].tokens == ["full", "here", "letters", "strasse", "width"]


def test_stable_ids_are_the_greedy_assignment(spark):
    from docloom.operators.graph import stable_ids

    rng = random.Random(3)
    new = {i: rng.randrange(12) for i in range(80)}
    old = {i: 100 + rng.randrange(8) for i in range(70)}
    overlap = {}
    for i in old:
        overlap[new[i], old[i]] = overlap.get((new[i], old[i]), 0) + 1
    want, used = {}, set()
    for n, f, c in sorted((-n, f, c) for (c, f), n in overlap.items()):
        if c not in want and f not in used:
            want[c] = f
            used.add(f)
    for c in sorted(set(new.values()) - set(want)):
        want[c] = max([*old.values(), *want.values()]) + 1
    members, former = spark.createDataFrame(list(new.items()), "node long, component long"), spark.createDataFrame(list(old.items()), "node long, former_id long")
    assert {r.component: r.stable_id for r in stable_ids(members, former).collect()} == want
    assert sorted(r.stable_id for r in stable_ids(members, former.limit(0)).collect()) == list(range(1, 13))


def test_similar_titles_equal_all_pairs_and_need_no_key(spark):
    rng = random.Random(8)
    words = ["agent", "prompt", "injection", "ab", "智能体框架", "x", "rat", "vault", "zebra", "of", "gateway", "leak"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(4, 30))) for _ in range(150)]
    for t in titles[:100]:
        own = t.split()
        rng.shuffle(own)
        changed = list(t)
        changed[rng.randrange(len(changed))] = "q"
        titles += [" ".join(own), "".join(changed)]
    titles += [f"an it of to us {n} we by in" for n in ("a", "b", "c")]  # no word of four characters: no blocking key
    titles += [f"the same long heading about model number {n}" for n in range(130)]  # every key in more than 100 titles
    flat = sorted({fold_title(t) for t in titles})
    want = {(i, j): folded_similarity(flat[i], flat[j]) for i in range(len(flat)) for j in range(i + 1, len(flat))}
    df = spark.createDataFrame(list(enumerate(flat)), "id long, folded string")
    for block in (1000, 40):
        got = {(r.a, r.b): r.similarity for r in dedupe.similar_titles(df, 82, block).collect()}
        assert got == {k: v for k, v in want.items() if v >= 82}
    assert dedupe.similar_titles(df.limit(0), 82).isEmpty()


def test_content_edges_equal_all_pairs(spark):
    rng = random.Random(6)
    body = ["word " * 60, "other " * 60]
    heads = ["Some other heading here", "Some other heading hero", "Nothing alike at all", "Some other heading her"]
    rows = []
    for i in range(90):
        ids = rng.choice([{}, {}, {"cve": ["CVE-2026-1111"]}, {"cve": ["CVE-2026-2222"]}])
        at = rng.choice([None, *[T0 + timedelta(days=rng.randrange(0, 900))] * 30])
        rows.append(doc(i, rng.choice(heads), body=rng.choice(body), ids=ids, at=at))
    docs = dedupe.prepared(spark.createDataFrame(rows, DOC))
    flat = docs.select("id", "content", "folded", "ids", "at").collect()
    edges = []
    for a in flat:
        for b in flat:
            near = a["at"] is None or b["at"] is None or abs(a["at"] - b["at"]) <= timedelta(days=30)
            alike = folded_similarity(a.folded, b.folded) >= 80
            if a.id < b.id and a.content == b.content and near and alike and not (a.ids and b.ids and not set(a.ids) & set(b.ids)):
                edges.append((a.id, b.id))
    want = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(connected_components(dedupe.exact_content_edges(docs)).collect()) == sorted(want)


def test_fuzzy_titles_need_their_plain_ratio(spark):
    left, right = "alpha bravo charlie delta echo foxtrot", "foxtrot echo delta charlie bravo alpha"
    docs = dedupe.prepared(spark.createDataFrame([doc(1, left), doc(2, right), doc(3, left + "s")], DOC))
    assert [tuple(r) for r in dedupe.fuzzy_title_edges(docs).collect()] == [(3, 1)]


def test_exact_pairs_need_no_shared_token(spark):
    rows = [doc(1, "One two three four five six", at=T0), doc(2, "ONE, two three four five six", at=T0 + timedelta(days=90)), doc(3, "Else", url="https://example.com/1/")]
    rows += [doc(100 + i, "The same title in many rows", at=T0 + timedelta(days=i)) for i in range(130)]
    docs = dedupe.prepared(spark.createDataFrame(rows, DOC))
    got = {tuple(r) for r in dedupe.exact_pairs(docs).collect()}
    assert {p for p in got if p[0] < 100} == {(1, 2), (1, 3)}
    assert {(100 + i, 101 + i) for i in range(129)} <= got and len(got) < 1000


def test_reviews_override_neither_scope_nor_conflict(spark):
    docs = spark.createDataFrame([doc(1, "One thing", ids={"cve": ["CVE-2026-1111"]}), doc(2, "Another", ids={"cve": ["CVE-2026-2222"]}), doc(3, "A third"), doc(4, "Fourth"), doc(5, "Fifth")], DOC)
    approved = spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "a long, b long")
    scope = F.when(F.col("id") == 5, "vuln").otherwise("general")
    got = {r.document_id: (r.near_dup_of, r.duplicate_kind) for r in dedupe.deduplicate(docs, scope, approved).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (3, "review_approved"), 5: (None, None)}


def test_the_review_rule_is_stricter(spark):
    rows = [(["CVE-2026-1111", "GHSA-AAAA-BBBB-CCCC"], ["CVE-2026-2222", "GHSA-AAAA-BBBB-CCCC"]), (["CVE-2026-1111"], ["GHSA-AAAA-BBBB-CCCC"]), (["CVE-2026-1111"], ["CVE-2026-1111"]), ([], ["CVE-2026-1111"])]
    df = spark.createDataFrame(rows, "l array<string>, r array<string>")
    got = df.select(dedupe.review_conflict(F.col("l"), F.col("r")), dedupe.identities_conflict(F.col("l"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("conflict:cve", False), ("conflict:vulnerability", True), (None, False), (None, False)]


def test_fulltext_makes_what_depended_on_it_due(spark):
    docs = spark.createDataFrame([(1, "short", "v1", "x"), (2, "same", "v1", "x"), (3, None, "v1", "x"), (4, "kept", "v1", "x")], "id int, body string, version string, other string")
    texts = spark.createDataFrame([(1, "long"), (2, "same"), (3, "new"), (4, None), (9, "nobody")], "id int, body string")
    got = events.with_fulltext(docs, texts, "id", "body", ["version"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "long", None, "x"), (2, "same", "v1", "x"), (3, "new", None, "x"), (4, "kept", "v1", "x")]


def test_event_keys_of_all_identities(spark):
    ids = {"ghsa": ["ghsa-aaaa-bbbb-cccc"], "cnvd": ["CNVD-2026-00001"], "cve": ["CVE-2026-1234"]}
    docs = spark.createDataFrame([doc(1, ids=ids)], DOC)
    keys = docs.select(events.strong_keys(F.col("identifiers"), F.col("canonical_url"), F.lit(True))).head()[0]
    assert keys == ["cve-nvd:CVE-2026-1234", "ghsa:GHSA-AAAA-BBBB-CCCC", "cnvd:CNVD-2026-00001"]


def test_candidates_of_large_tables_are_never_sent_to_the_driver(spark, tmp_path):
    rows = [(i, T0, [f"sim:0:{i % 3}"], [f"held by {n}" for n in (100, 101) if i < n]) for i in range(102)] + [(200, None, ["min:1:x"], []), (201, T0 + timedelta(days=99), ["min:1:x"], [])]
    spark.createDataFrame(rows, "id long, at timestamp, bands array<string>, blocking array<string>").write.parquet(path := str(tmp_path / "signed"))
    pairs = dedupe.candidate_pairs(spark.read.parquet(path))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = {(r.a, r.b): (r.bands, r.lexical) for r in pairs.collect()}
    # the token of 101 documents gives nothing, that of 100 is one lexical token, which alone is no candidate
    expected = {(a, b): (1, int(b < 100)) for a in range(102) for b in range(a + 1, 102) if a % 3 == b % 3} | {(200, 201): (1, 0)}
    assert found == expected


def test_exact_pairs_of_large_tables_are_never_sent_to_the_driver(spark, tmp_path, monkeypatch):
    rows = [(i, [], T0, f"u{i // 2}", "", None) for i in range(20)]
    spark.createDataFrame(rows, "id long, ids array<string>, at timestamp, url string, folded string, content string").write.parquet(path := str(tmp_path / "docs"))
    # the edges of hot values join with a row per hot value, which may be sent
    monkeypatch.setattr(dedupe, "_linked", lambda rows, key: rows.select(F.col("id").alias("a"), F.col("id").alias("b")).filter("false"))
    pairs = dedupe.exact_pairs(spark.read.parquet(path))
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert {(r.a, r.b) for r in pairs.collect()} == {(i, i + 1) for i in range(0, 20, 2)}


def test_similarities_over_arrays_are_those_of_single_titles():
    random.seed(3)
    words = ["ab", "a", "漏洞", "𠀀x", "prompt", "injection", "z" * 130, "é"]
    titles = ["", *(" ".join(random.choices(words, k=random.randint(1, 9))) for _ in range(300))]
    x, y = random.choices(titles, k=2000), random.choices(titles, k=2000)
    assert folded_similarities(x, y, 64) == [folded_similarity(a, b) for a, b in zip(x, y)]


def test_filters_of_similar_titles_lose_nothing():
    rng = random.Random(4)
    words = ["agent", "prompt", "injection", "ab", "智能体框架", "x", "𠀀y", "vault", "of", "leak", "n" * 70]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 20))) for _ in range(120)] + ["", "a" * 700, "a" * 690 + "b", "ab" * 1200, "ab" * 1150, "ba" * 1200]
    changed = ["".join(c if rng.random() > 0.12 else "q" for c in " ".join(rng.sample(t.split(), len(t.split())))) for t in titles]
    changed = [fold_title(t) for t in changed]
    single = {(i, j): folded_similarity(x, y) for i, x in enumerate(titles) for j, y in enumerate(changed + titles)}
    for score in (60, 82, 94):
        i, j = similar_in(titles, changed + titles, score, tile=50)
        assert {p for p, s in single.items() if s >= score} == {p for p in zip(i.tolist(), j.tolist()) if single[p] >= score} and len(i) < len(single) / 2
    plain = [(i, j) for i in range(120) for j in range(120)]
    outside = np.array([len(titles[i]) + len(titles[j]) - 2 * common_length(titles[i], titles[j]) for i, j in plain])
    most = np.array([rng.randrange(1 + (len(titles[i]) + len(titles[j])) // 2) for i, j in plain])
    assert (_within(titles, titles, *np.array(plain).T, most, chunk=1000, stride=5) == (outside <= most)).all()
