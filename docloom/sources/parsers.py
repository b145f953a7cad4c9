"""Parsers: raw record -> document projection (title, body, identifiers, quality), as column expressions."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity import html_entities
from ..functions.text import IDENTIFIERS_IN_TEXT, identifiers_in, null_if_blank, parse_quality
from ..functions.urls import canonical_url

#: Shortest body that counts for the quality score, by parser.
LEAST_BODY = {"rss": 80, "nvd": 20, "kev": 10, "arxiv": 100, "github": 1, "article": 400}
#: A CVE record's status in the projection.
NVD_STATUS = {"Rejected": "rejected", "Awaiting Analysis": "unknown", "Received": "unknown", "Undergoing Analysis": "unknown"}

NVD = (
    "id string, published string, vulnStatus string, descriptions array<struct<lang:string,value:string>>,"
    " weaknesses array<struct<description:array<struct<lang:string,value:string>>>>,"
    " metrics struct<" + ",".join(f"cvssMetricV{v}:array<struct<cvssData:struct<baseScore:double>>>" for v in ("40", "31", "30", "2")) + ">,"
    " configurations array<struct<nodes:array<struct<cpeMatch:array<struct<criteria:string>>>>>>"
)


def projection(rows: DataFrame, title: Column, body: Column, url: Column, at: Column, least: int, *more: Column) -> DataFrame:
    """The common document columns of every parser."""
    text = F.concat_ws("\n", title, body)
    kinds = F.create_map(*(x for k in IDENTIFIERS_IN_TEXT for x in (F.lit(k), identifiers_in(text, k))))
    return rows.select(
        title.alias("title"), null_if_blank(body).alias("body"), canonical_url(url).alias("canonical_url"), at.alias("published_at"),
        F.map_filter(kinds, lambda _, v: F.size(v) > 0).alias("identifiers"), parse_quality(title, at, body, least).alias("parse_quality"), *more,
    )


def parse_rss(rows: DataFrame) -> DataFrame:
    """raw_text up to the first blank line is the title, the rest the body."""
    raw = F.col("raw_text")
    body = F.when(F.instr(raw, "\n\n") > 0, F.substring(raw, F.instr(raw, "\n\n") + 2, F.length(raw)))
    return projection(rows, F.trim(F.substring_index(raw, "\n\n", 1)), body, F.col("url"), F.col("published_at"), LEAST_BODY["rss"])


def parse_nvd(rows: DataFrame) -> DataFrame:
    """A CVE record's JSON: first English description, weaknesses, first score by metric version, products and vendors in their order."""
    r = F.from_json("raw_text", NVD)
    rows = rows.withColumn("r", r)
    first = lambda values: F.get(values, F.lit(0))
    english = F.filter(F.col("r.descriptions"), lambda d: d["lang"] == "en")
    weaknesses = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("r.weaknesses", lambda w: F.transform(w["description"], lambda d: F.upper(d["value"])))), lambda v: v.rlike("^CWE-[0-9]+$"))))
    score = F.coalesce(*(first(F.col(f"r.metrics.cvssMetricV{v}"))["cvssData"]["baseScore"] for v in ("40", "31", "30", "2")))
    criteria = F.flatten(F.flatten(F.transform("r.configurations", lambda c: F.transform(c["nodes"], lambda n: F.transform(n["cpeMatch"], lambda m: m["criteria"])))))
    piece = lambda i: F.array_distinct(F.transform(criteria, lambda c: F.lower(F.get(F.split(c, ":"), F.lit(i)))))
    status = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NVD_STATUS.items() for x in kv)), F.col("r.vulnStatus")), F.lit("published"))
    out = projection(
        rows, F.col("r.id"), first(english)["value"], F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), F.col("r.id")), F.col("r.published"), LEAST_BODY["nvd"],
        F.coalesce(weaknesses, F.array().cast("array<string>")).alias("cwe"), score.alias("cvss"), F.coalesce(piece(4), F.array().cast("array<string>")).alias("products"),
        F.coalesce(piece(3), F.array().cast("array<string>")).alias("vendors"), status.alias("record_status"), F.upper("r.id").alias("__id"),
    )
    # identity is only the record's own id, whatever its text mentions
    return out.withColumn("identifiers", F.create_map(F.lit("cve"), F.array("__id"))).drop("__id")


def parse_comment_html(html: Column) -> Column:
    """Character references resolved, breaks and paragraphs as line ends, tags dropped, three and more line ends as two."""
    broken = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"(?i)<p[^>]*>", "\n\n")
    return F.trim(F.regexp_replace(html_entities(F.regexp_replace(broken, "<[^>]+>", "")), r"\n{3,}", "\n\n"))


class _Article(HTMLParser):
    """Title, main text and date of a page."""

    SKIP = frozenset(("script", "style", "nav", "header", "footer", "aside", "form", "noscript"))
    BLOCK = frozenset(("p", "div", "br", "li", "h1", "h2", "h3", "h4", "tr", "section", "article"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.date, self.parts, self.hidden, self.in_title = "", None, [], 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        if tag == "title":
            self.in_title = True
        elif tag in self.SKIP:
            self.hidden += 1
        elif tag == "meta" and (named.get("property") or named.get("name")) in ("article:published_time", "date"):
            self.date = named.get("content")
        elif tag == "time" and not self.date:
            self.date = named.get("datetime")
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP and self.hidden:
            self.hidden -= 1
        if tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.parts.append(data)


_ARTICLE = T.StructType().add("title", T.StringType()).add("body", T.StringType()).add("date", T.StringType())


@F.pandas_udf(_ARTICLE)
def article(html: pd.Series) -> pd.DataFrame:
    """Title, body and date of each page; null and empty pages have none."""
    rows = []
    for page in html:
        found = _Article()
        found.feed(page or "")
        lines = (" ".join(line.split()) for line in "".join(found.parts).split("\n"))
        rows.append((" ".join(found.title.split()) or None, "\n".join(x for x in lines if x) or None, found.date))
    return pd.DataFrame(rows, columns=["title", "body", "date"])


def parse_article(rows: DataFrame) -> DataFrame:
    """Whole pages: ``html`` and ``url``."""
    rows = rows.withColumn("a", article("html"))
    return projection(rows, F.col("a.title"), F.col("a.body"), F.col("url"), F.col("a.date"), LEAST_BODY["article"])


KEV = "cveID string, vendorProject string, product string, vulnerabilityName string, dateAdded string, shortDescription string, requiredAction string"
PAPER = "id string, title string, summary string, published string, updated string, authors array<string>, categories array<string>"
RELEASE = "id string, tag_name string, name string, body string, html_url string, published_at string"
TRANSLATED = "id string, title string, title_zh string, summary string, url string, published_at string"
SITE_ARTICLE = "title string, body string, url string, published_at string, lastmod string"


def _read(rows: DataFrame, schema: str) -> DataFrame:
    return rows.withColumn("r", F.from_json("raw_text", schema))


def parse_kev(rows: DataFrame) -> DataFrame:
    """A record of exploited vulnerabilities: description and required action are the body, its own id the only identity."""
    rows = _read(rows, KEV)
    body = F.concat_ws("\n\n", null_if_blank(F.col("r.shortDescription")), null_if_blank(F.col("r.requiredAction")))
    title = F.concat_ws(": ", F.upper("r.cveID"), null_if_blank(F.col("r.vulnerabilityName")))
    lower = lambda c: F.array_compact(F.array(null_if_blank(F.lower(F.trim(c)))))
    out = projection(rows, title, body, F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), F.upper("r.cveID")), F.col("r.dateAdded"), LEAST_BODY["kev"], lower("r.vendorProject").alias("vendors"), lower("r.product").alias("products"), F.upper("r.cveID").alias("__id"))
    return out.withColumn("identifiers", F.when(F.col("__id").isNotNull(), F.create_map(F.lit("cve"), F.array("__id"))).otherwise(F.col("identifiers"))).drop("__id")


def parse_paper(rows: DataFrame) -> DataFrame:
    """A paper's record with its authors and categories."""
    rows = _read(rows, PAPER)
    lists = [F.coalesce(F.col(f"r.{c}"), F.array().cast("array<string>")).alias(c) for c in ("authors", "categories")]
    return projection(rows, F.col("r.title"), F.col("r.summary"), F.col("r.id"), F.coalesce("r.published", "r.updated"), LEAST_BODY["arxiv"], *lists)


def parse_release(rows: DataFrame) -> DataFrame:
    """A release: its name, else its tag, else its id."""
    rows = _read(rows, RELEASE)
    title = F.coalesce(*(null_if_blank(F.trim(F.col(f"r.{c}"))) for c in ("name", "tag_name", "id")))
    return projection(rows, title, F.col("r.body"), F.col("r.html_url"), F.col("r.published_at"), LEAST_BODY["github"], F.col("r.tag_name").alias("tag"))


def parse_translated(rows: DataFrame) -> DataFrame:
    """An item of a translated feed; title_zh only where it differs from the title."""
    rows = _read(rows, TRANSLATED)
    title = F.coalesce(null_if_blank(F.col("r.title")), F.col("r.title_zh"))
    other = F.when(~F.col("r.title_zh").eqNullSafe(title), null_if_blank(F.col("r.title_zh")))
    return projection(rows, title, F.col("r.summary"), F.col("r.url"), F.col("r.published_at"), LEAST_BODY["rss"], other.alias("title_zh"))


def parse_site_article(rows: DataFrame) -> DataFrame:
    """An article fetched by a site map; dated by its last change where it has no date."""
    rows = _read(rows, SITE_ARTICLE)
    return projection(rows, F.col("r.title"), F.col("r.body"), F.col("r.url"), F.coalesce(null_if_blank(F.col("r.published_at")), F.col("r.lastmod")), LEAST_BODY["article"])


#: The parser of each kind of record.
PARSERS = {
    "rss": parse_rss, "nvd": parse_nvd, "kev": parse_kev, "arxiv": parse_paper, "github": parse_release,
    "translated": parse_translated, "sitemap": parse_site_article, "web": parse_article,
}


def parse(rows: DataFrame, kind: str) -> DataFrame:
    """The projection of raw records of one kind; an unknown kind is an error."""
    if kind not in PARSERS:
        raise ValueError(f"unknown kind {kind!r}, known are {', '.join(sorted(PARSERS))}")
    return PARSERS[kind](rows)
