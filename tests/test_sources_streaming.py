"""Scans, parsers, sinks and streams over small files."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from docloom.sources import parsers, records, sinks
from docloom.streaming import feeds


def test_feed_and_sitemap_scans(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><guid>g1</guid><title>T</title><description>D</description><link>https://x/1</link><pubDate>p</pubDate></item><item><link>https://x/2</link><title>U</title></item></channel></rss>")
    rows = {r.native_id: r for r in records.scan_feed(spark, str(tmp_path / "f.xml")).collect()}
    assert rows["g1"].published_at == "p" and rows["https://x/2"].body is None and len(rows["g1"].content_hash) == 64
    (tmp_path / "s.xml").write_text("<urlset>" + "".join(f"<url><loc> https://x/blog/{i}?q=1 </loc><lastmod>2025-01-0{i}</lastmod></url>" for i in range(1, 6)) + "<url><loc>https://x/about</loc></url></urlset>")
    found = records.scan_sitemap(spark, str(tmp_path / "s.xml"), "/blog/", 24, F.lit("2025-01-04").cast("timestamp"), 2).collect()
    assert [r.url for r in found] == ["https://x/blog/5", "https://x/blog/4"]


def test_json_scans(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"items": [{"cve": {"id": "CVE-2025-1", "n": 1}}, {"cve": {"n": 2}}]}))
    assert [r.id for r in records.scan_json_list(spark, str(tmp_path / "p.json"), "items", "id: string, n: int", "id", "cve").collect()] == ["CVE-2025-1"]
    (tmp_path / "d.jsonl").write_text('# note\n\n{"a": 1, "b": "x"}\n{"a": 2}\nbroken\n')
    rows = records.scan_jsonl(spark, str(tmp_path / "d.jsonl"), "a int, b string", ("a", "b")).collect()
    assert [r._bad is None for r in rows] == [True, False, False]


def test_change_scans(spark):
    new = spark.createDataFrame([("a", "1", "upsert"), ("a", "1", "upsert"), ("b", "2", "Remove"), ("c", "3", None)], "native_id string, content_hash string, operation string")
    known = spark.createDataFrame([("a", "1"), ("z", "9")], "native_id string, content_hash string")
    assert {r.native_id for r in records.changed_only(new, known).collect()} == {"b", "c"}
    assert [r.native_id for r in records.snapshot_changes(new, known).filter("operation = 'withdraw'").collect()] == ["z"]
    assert {r.native_id for r in records.ledger_changes(new, known).collect()} == {"a", "c"}
    years = spark.createDataFrame([("CVE-2024-1",), ("cve-2019-1",), ("x",), (None,)], "n string")
    assert [r[0] for r in years.select(records.id_year(F.col("n"), 2020)).collect()] == [True, False, False, False]
    windows = records.catch_up_windows(spark, "2025-01-01", "2025-01-16").collect()
    assert len(windows) == 3 and windows[-1].until == datetime(2025, 1, 16)


def test_parsers(spark):
    nvd = {
        "id": "CVE-2025-7", "published": "2025-01-01", "vulnStatus": "Rejected", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "About CVE-2024-9999 in things"}],
        "weaknesses": [{"description": [{"lang": "en", "value": "cwe-79"}, {"lang": "en", "value": "NVD-CWE-Other"}]}],
        "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 7.5}}], "cvssMetricV2": [{"cvssData": {"baseScore": 5.0}}]},
        "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:Acme:Tool:1"}, {"criteria": "cpe:2.3:a:acme:tool:2"}]}]}],
    }
    rows = parsers.parse_nvd(spark.createDataFrame([(json.dumps(nvd),), ("broken",)], "raw_text string")).collect()
    r = rows[0]
    assert (r.cvss, r.cwe, r.products, r.vendors, r.record_status, r.identifiers) == (7.5, ["CWE-79"], ["tool"], ["acme"], "rejected", {"cve": ["CVE-2025-7"]})
    rss = spark.createDataFrame([("Title\n\nBody CVE-2025-1234 " + "x" * 90, "https://x/?ref=a", "p"), ("Only", None, None)], "raw_text string, url string, published_at string")
    a, b = parsers.parse_rss(rss).collect()
    assert a.title == "Title" and a.identifiers == {"cve": ["CVE-2025-1234"]} and a.parse_quality == 1.0 and b.body is None and b.parse_quality == 0.4
    pages = spark.createDataFrame([("<html><title>T &amp; U</title><nav>x</nav><p>One</p><p>Two<script>z</script></p><time datetime='2025-01-01'></time></html>", "https://x/"), (None, None)], "html string, url string")
    page, none = parsers.parse_article(pages).collect()
    assert (page.title, page.body, page.published_at) == ("T & U", "One\nTwo", "2025-01-01") and none.title is None
    html = spark.createDataFrame([("a<p>b<br>c &lt;d&gt;<p><p><p>e",)], "h string")
    assert html.select(parsers.parse_comment_html(F.col("h"))).head()[0] == "a\n\nb\nc <d>\n\ne"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], {"k": [1]}, 'say "x"\n</script>')], "id long, tags array<string>, m map<string,array<int>>, t string")
    sinks.export(df, str(tmp_path / "c"), "csv")
    back = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(str(tmp_path / "c")).head()
    assert (back.tags, back.m, back.t) == ("a;b", '{"k":[1]}', 'say "x"\n</script>')
    sinks.export(df, str(tmp_path / "j"), "jsonl")
    assert spark.read.json(str(tmp_path / "j")).head().tags == ["a", "b"]
    assert "<" not in df.select(sinks.script_safe_json(F.struct("t"))).head()[0]
    table = sinks.VersionedTable(spark, str(tmp_path / "v"))
    assert table.read() is None
    table.upsert(df.select("id", "t"), ["id"])
    table.upsert(df.select(F.lit(2).cast("long").alias("id"), F.lit("n").alias("t")), ["id"])
    assert table.versions() == [1, 2] and table.read().count() == 2 and table.read(1).count() == 1


def test_streams(spark, tmp_path):
    schema = "key string, seq long, op string"
    batches = [[("a", 1, "set"), ("b", 1, "set")], [("a", 3, "delete"), ("b", 2, "set")], [("a", 2, "set"), ("b", 2, "set")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = feeds.read_stream(spark, str(tmp_path / "in/*"), schema, 1)
    feeds.apply_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ["key"], ["seq"], F.col("op") == "delete").awaitTermination(120)
    state = {r.key: (r.seq, r.removed) for r in sinks.VersionedTable(spark, str(tmp_path / "t")).read().collect()}
    assert state == {"a": (3, True), "b": (2, False)}


def test_stream_windows_and_health(spark, tmp_path):
    rows = [("e1", datetime(2025, 1, 1, 0, i), i % 7 == 6, 1.0) for i in range(6)] + [("e2", datetime(2025, 1, 1, 0, 1), True, 2.0)]
    schema = "endpoint_id string, at timestamp, ok boolean, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "runs"))
    stream = feeds.read_stream(spark, str(tmp_path / "runs"), schema)
    for name, df, mode in (("counts", feeds.windowed_counts(stream, "at", ["endpoint_id"], "5 minutes"), "complete"), ("distinct", feeds.distinct_stream(stream, "at", ["endpoint_id"], "1 hour"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).head()[0] == 7 and spark.table("distinct").count() == 2
    feeds.endpoint_health(stream).writeStream.format("memory").queryName("health").outputMode("update").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.endpoint_id, r.failures, r.health) for r in spark.table("health").collect()} == {("e1", 6, "open"), ("e2", 0, "active")}
