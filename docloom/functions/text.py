"""Text as column expressions: JVM-side, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The White_Space characters of Unicode, as a DuckDB/SQL string for trim().
WHITE_SPACE = "".join(
    chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)


def strip(text: Column) -> Column:
    """``text`` without surrounding Unicode white space; null stays null."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Stripped, every run of Unicode white space as one space."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def blank(text: Column) -> Column:
    """True where ``text`` is null, empty or only Unicode white space; never null."""
    return ~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def null_if_blank(text: Column) -> Column:
    return F.when(~blank(text), text)


def strip_markup(text: Column) -> Column:
    """Without tags and http(s) addresses, white space squeezed; null gives ''."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    return squeeze(F.regexp_replace(plain, r"https?://\S+", " "))


def summary(body: Column, title: Column, limit: int = 600) -> Column:
    """The squeezed body's first ``limit`` characters; null if blank or nothing but the title."""
    flat = squeeze(body)
    return F.when((flat != "") & ~flat.eqNullSafe(strip(title)), F.rtrim(F.substring(flat, 1, limit)))


def clean_summary(text: Column, limit: int = 300, separators: tuple[str, ...] = ("。", "！", "？", ". ", "! ", "? ")) -> Column:
    """At most ``limit`` characters of the text without tags, cut after a sentence where one ends late enough.

    The first separator, in the order given, whose last place is beyond character 50
    decides; else the cut text with an ellipsis. Null gives ''.
    """
    plain = strip(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""))
    head = F.substring(plain, 1, limit)
    cut = F.concat(F.rtrim(head), F.lit("…"))
    for mark in reversed(separators):
        behind = F.instr(F.reverse(head), mark[::-1])
        place = F.char_length(head) - behind - len(mark) + 1  # from 0
        cut = F.when((behind > 0) & (place > 50), F.rtrim(F.substring(head, F.lit(1), (place + len(mark)).cast("int")))).otherwise(cut)
    return F.when(F.char_length(plain) <= limit, plain).otherwise(cut)


def escape_like(text: Column) -> Column:
    r"""``\``, ``%`` and ``_`` escaped for LIKE."""
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


def contains_ignoring_case(haystack: Column, needle: str) -> Column:
    """Escaped case-insensitive substring test; null never matches."""
    pattern = "".join("\\" + c if c in "\\%_" else c for c in needle)
    return F.coalesce(haystack.ilike(f"%{pattern}%"), F.lit(False))


#: Identifier kinds and how they are written, as found in texts and as accepted as identities.
IDENTIFIERS_IN_TEXT = {
    "cve": r"CVE-\d{4}-\d{4,7}",
    "ghsa": r"GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}",
    "cnvd": r"CNVD-\d{4}-\d{4,6}",
    "cwe": r"CWE-\d{1,5}",
}
IDENTITIES = {
    "cve": r"^CVE-[0-9]{4}-[0-9]{4,19}$",
    "ghsa": r"^GHSA-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}$",
    "cnvd": r"^CNVD-[0-9]{4}-[0-9]+$",
}


def identifiers_in(text: Column, kind: str) -> Column:
    """Sorted distinct upper-case identifiers of one kind; an empty array for null."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?i)\b{IDENTIFIERS_IN_TEXT[kind]}\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(hits, F.upper)))


def identity_values(identifiers: Column, kind: str) -> Column:
    """Upper-case values of a map's kind that are well-formed identities; an empty array where there are none."""
    raw = F.coalesce(F.try_element_at(identifiers, F.lit(kind)), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, F.upper), lambda v: v.rlike(IDENTITIES[kind]))))


def parse_quality(title: Column, date: Column, body: Column, least: int = 80) -> Column:
    """.4 for a title, .2 for a date, .4 for a body of at least ``least`` characters."""
    has_body = F.coalesce(F.char_length(strip(body)) >= least, F.lit(False))
    score = F.when(~blank(title), 0.4).otherwise(0.0) + F.when(date.isNotNull(), 0.2).otherwise(0.0) + F.when(has_body, 0.4).otherwise(0.0)
    return F.round(score, 3)


def locate_evidence(quote: Column, title: Column, body: Column) -> Column:
    """struct(field, start, end): where a quote stands word for word, title first; from 0, end exclusive."""
    in_title, in_body = F.position(quote, title), F.position(quote, body)
    found = lambda field, place: F.struct(F.lit(field).alias("field"), (place - 1).alias("start"), (place - 1 + F.char_length(quote)).alias("end"))
    nowhere = F.struct(F.lit("unknown").alias("field"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    usable = F.coalesce(quote != "", F.lit(False))
    return F.when(usable & (in_title > 0), found("title", in_title)).when(usable & (in_body > 0), found("body", in_body)).otherwise(nowhere)


def concatenated_sha256(*parts: Column) -> Column:
    """SHA-256 over the parts one after the other, without a separator; null parts are empty."""
    return F.sha2(F.concat(*(F.coalesce(p, F.lit("")) for p in parts)), 256)


def alias_pattern(alias: str) -> str:
    """How an alias is looked for: CJK ones anywhere, others as whole words, Unicode-aware."""
    import re

    if re.search("[㐀-鿿]", alias):
        return "(?i)" + _quote(alias)
    return rf"(?iU)(?<![\w-]){_quote(alias)}(?![\w-])"


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c.isascii() and c != " " else c for c in text)
