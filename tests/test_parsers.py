"""Parsers of single kinds of records, by cases."""

import json

import pytest

from docloom.sources.parsers import PARSERS, parse


def one(spark, kind, *records):
    rows = spark.createDataFrame([(r if isinstance(r, str) or r is None else json.dumps(r), None, None) for r in records], "raw_text string, url string, published_at string")
    return parse(rows, kind).collect()


def test_kev(spark):
    r, bad = one(spark, "kev", {"cveID": "cve-2026-1234", "vendorProject": "Acme ", "product": "Box", "vulnerabilityName": "Overflow", "dateAdded": "2026-01-02", "shortDescription": "Bad CVE-2020-9999.", "requiredAction": "Patch"}, "not json")
    assert (r.title, r.body, r.canonical_url) == ("CVE-2026-1234: Overflow", "Bad CVE-2020-9999.\n\nPatch", "https://nvd.nist.gov/vuln/detail/CVE-2026-1234")
    assert r.identifiers == {"cve": ["CVE-2026-1234"]} and r.vendors == ["acme"] and r.products == ["box"] and r.parse_quality == 1.0
    assert bad.body is None and bad.identifiers == {} and bad.vendors == []


def test_papers_and_releases(spark):
    r, empty = one(spark, "arxiv", {"id": "http://arxiv.org/abs/2601.00001v2", "title": "T", "summary": "x" * 100, "updated": "2026-01-01", "authors": ["A", "B"]}, None)
    assert r.authors == ["A", "B"] and r.categories == [] and r.published_at == "2026-01-01" and r.parse_quality == 1.0
    assert empty.title is None and empty.authors == []
    named, tagged, bare = one(spark, "github", {"id": "7", "tag_name": "v1", "name": "One", "body": "b"}, {"id": "7", "tag_name": "v1", "name": " "}, {"id": "7"})
    assert [x.title for x in (named, tagged, bare)] == ["One", "v1", "7"] and named.tag == "v1" and bare.tag is None


def test_translations_and_site_articles(spark):
    other, same, only = one(spark, "translated", {"title": "A", "title_zh": "甲", "summary": "s"}, {"title": "A", "title_zh": "A"}, {"title_zh": "甲"})
    assert [(x.title, x.title_zh) for x in (other, same, only)] == [("A", "甲"), ("A", None), ("甲", None)]
    dated, changed = one(spark, "sitemap", {"title": "A", "body": "b", "url": "https://h/a?utm_source=x#f", "published_at": "2026-01-01", "lastmod": "2026-02-01"}, {"title": "A", "published_at": "", "lastmod": "2026-02-01"})
    assert (dated.published_at, dated.canonical_url, changed.published_at) == ("2026-01-01", "https://h/a", "2026-02-01")


def test_registry(spark):
    assert len(PARSERS) == 8
    with pytest.raises(ValueError, match="unknown kind"):
        parse(spark.range(1), "nothing")
