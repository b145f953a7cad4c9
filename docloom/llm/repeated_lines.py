"""Lines and line sequences repeated across one source's documents: PrefixSpan over line ids."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank
from ..session import cut

#: A line's identifier: 64 bits of its normal form, null for a blank line.
_LINE_ID = r"""transform(split(body_text, '\n', -1), l -> CASE WHEN l RLIKE '(?U)\\S' THEN
  xxhash64(regexp_replace(trim(regexp_replace(lower(l), '(?U)\\s+', ' ')), '[0-9]+', '0')) END)"""


def line_ids(documents: DataFrame) -> DataFrame:
    """(id, endpoint_id, lines): the line identifiers of each document with a body that isn't blank.

    Lines are split at line feeds and agree after lower-casing, trimming, squeezing
    Unicode white space and writing each run of digits 0-9 as one 0.
    """
    return documents.filter(~blank(F.col("body_text"))).select("id", "endpoint_id", F.expr(_LINE_ID).alias("lines"))


def frequent_lines(lines: DataFrame, min_documents: int = 4, min_share: float = 0.08) -> DataFrame:
    """(endpoint_id, line, documents, needed): PrefixSpan's patterns of length one.

    Each document sends each of its different lines once and counts are combined
    before the shuffle, so a line of a third of all documents is one row per task.
    """
    # per mille, so that the share is compared in whole numbers
    enough = F.ceil(F.greatest(F.lit(min_documents), F.col("total") * F.lit(round(min_share * 1000)) / 1000))
    totals = lines.groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("total")).select("endpoint_id", enough.alias("needed"))
    counts = (
        lines.select("endpoint_id", F.explode(F.array_distinct("lines")).alias("line"))
        .filter("line IS NOT NULL")
        .groupBy("endpoint_id", "line")
        .agg(F.count(F.lit(1)).alias("documents"))
        .filter(F.col("documents") >= min_documents)
    )
    same = F.col("c.endpoint_id").eqNullSafe(F.col("t.endpoint_id"))
    return counts.alias("c").join(totals.alias("t"), same).filter("documents >= needed").select("c.endpoint_id", "line", "documents", "needed")


def _with_frequent(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """Each document beside the frequent lines of its source.

    A source has at most (mean different lines per document) / min_share of them,
    so the list is short whatever the number of documents.
    """
    lists = frequent.groupBy("endpoint_id").agg(F.collect_list("line").alias("frequent"))
    same = F.col("d.endpoint_id").eqNullSafe(F.col("f.endpoint_id"))
    return lines.alias("d").join(lists.alias("f"), same).select("d.*", "f.frequent")


def repeated_lines(documents: DataFrame, min_documents: int = 4, min_share: float = 0.08) -> DataFrame:
    """(document_id, line_no): every occurrence of a frequent sequence, single lines included.

    A sequence is frequent if at least ``min_documents`` and ``min_share`` of the
    source's documents with a non-blank body hold it. No line of a frequent sequence
    is rarer than the sequence, so the occurrences of all frequent sequences are
    exactly those of the frequent lines; longer patterns are what
    ``frequent_sequences`` reports. Null and blank bodies have no lines and don't
    count as documents; documents without a source form one source; a row that
    repeats counts as one more document. No documents give no rows.
    """
    lines = line_ids(documents)
    marked = _with_frequent(lines, frequent_lines(lines, min_documents, min_share))
    return (
        marked.select(F.col("id").alias("document_id"), "frequent", F.posexplode("lines").alias("line_no", "line"))
        .filter(F.expr("array_contains(frequent, line)"))
        .select("document_id", "line_no")
    )


def without_repeated_lines(documents: DataFrame, min_documents: int = 4, min_share: float = 0.08) -> DataFrame:
    """(id, body_text): the bodies without their repeated lines; null and blank bodies as they are."""
    lines = line_ids(documents)
    marked = frequent_lines(lines, min_documents, min_share).groupBy("endpoint_id").agg(F.collect_list("line").alias("frequent"))
    same = F.col("d.endpoint_id").eqNullSafe(F.col("f.endpoint_id"))
    body = F.expr(r"array_join(filter(split(body_text, '\n', -1), (l, i) -> NOT coalesce(array_contains(frequent, lines[i]), false)), '\n')")
    kept = documents.select("id", "endpoint_id", "body_text", F.expr(_LINE_ID).alias("lines"))
    return kept.alias("d").join(marked.alias("f"), same, "left").select(
        "id", F.when(F.col("frequent").isNull() | F.col("body_text").isNull(), F.col("body_text")).otherwise(body).alias("body_text")
    )


def frequent_sequences(documents: DataFrame, max_length: int | None = None, min_documents: int = 4, min_share: float = 0.08) -> DataFrame:
    """(endpoint_id, pattern array<long>, length, documents): PrefixSpan, one level a round.

    Patterns are ordered sequences of line ids, gaps allowed. Only frequent lines can
    extend a frequent pattern, so the sequence database is first reduced to them. The
    projected database of a level holds, per pattern and document, the position of the
    earliest end of the pattern; each document extends it by its different later lines
    (short arrays) and supports are combined before the shuffle. Levels are mined until
    one is empty; ``max_length`` ends earlier where only shorter patterns are wanted.
    """
    lines = line_ids(documents)
    frequent = cut(frequent_lines(lines, min_documents, min_share))
    needed = frequent.groupBy("endpoint_id").agg(F.max("needed").alias("needed"))
    reduced = _with_frequent(lines, frequent).select("id", "endpoint_id", F.expr("filter(lines, l -> array_contains(frequent, l))").alias("lines"))
    found = frequent.select("endpoint_id", F.array("line").alias("pattern"), F.lit(1).alias("length"), "documents")
    # a projection: the pattern and what follows its earliest end
    grown = reduced.select("endpoint_id", F.array().cast("array<bigint>").alias("pattern"), F.col("lines").alias("rest"))
    levels = [found]
    for length in count(1) if max_length is None else range(1, max_length + 1):
        grown = grown.select("endpoint_id", "pattern", "rest", F.explode(F.array_distinct("rest")).alias("line")).select(
            "endpoint_id",
            F.concat("pattern", F.array("line")).alias("pattern"),
            F.expr("slice(rest, cast(array_position(rest, line) AS int) + 1, size(rest))").alias("rest"),
        )
        if length == 1:
            continue
        counts = grown.groupBy("endpoint_id", "pattern").agg(F.count(F.lit(1)).alias("documents"))
        same = F.col("c.endpoint_id").eqNullSafe(F.col("n.endpoint_id"))
        level = cut(counts.alias("c").join(needed.alias("n"), same).filter("documents >= needed").select("c.endpoint_id", "pattern", F.lit(length).alias("length"), "documents"))
        if level.isEmpty():
            break
        levels.append(level)
        keep = level.select(F.col("endpoint_id").alias("e"), F.col("pattern").alias("p"))
        grown = grown.join(keep, F.col("endpoint_id").eqNullSafe(F.col("e")) & (F.col("pattern") == F.col("p")), "left_semi")
        if length % 4 == 0:
            grown = cut(grown)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out
