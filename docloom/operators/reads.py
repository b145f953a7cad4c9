"""Read queries: filters, star joins, feeds, search, pages, rankings and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case

#: Record states that hide a document.
HIDDEN = ("rejected", "withdrawn")


def current(documents: DataFrame, status: str = "record_status") -> DataFrame:
    """Documents that aren't rejected or withdrawn; a null state hides too, as NOT IN does."""
    return documents.filter(~F.col(status).isin(*HIDDEN))


def in_scope(endpoint: Column, connector: Column, scope: str) -> Column:
    """all, vuln or general."""
    vulnerability = F.coalesce(connector == "vuln", F.lit(False))
    return {"all": F.lit(True), "vuln": vulnerability, "general": ~vulnerability}[scope] & endpoint.isNotNull()


def with_endpoint(documents: DataFrame, endpoints: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """The star join to the endpoint registry, a hand-kept list of feeds and so broadcast."""
    known = endpoints.select(F.col("id").alias("endpoint_id"), *columns).dropDuplicates(["endpoint_id"])
    return documents.join(F.broadcast(known), "endpoint_id", how)


def feed_page(documents: DataFrame, at: str, key: str, limit: int, before: tuple | None = None) -> DataFrame:
    """A page of the newest documents and the cursor of the next, by keyset.

    The cursor is (time, id), so ties on the time are neither repeated nor skipped.
    One row more than ``limit`` tells that there is a next page. The sort is a top-k
    per task: only limit + 1 rows of each leave it.
    """
    rows = documents
    if before:
        moment, last = F.lit(before[0]).cast(documents.schema[at].dataType), F.lit(before[1])
        rows = rows.filter((F.col(at) < moment) | ((F.col(at) == moment) & (F.col(key) < last)))
    return rows.orderBy(F.col(at).desc_nulls_last(), F.col(key).desc()).limit(limit + 1)


def search(documents: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Documents with the words in one of the columns, ignoring case; fewer than two characters find nothing."""
    if len(words) < 2:
        return documents.limit(0)
    hit = F.lit(False)
    for c in columns:
        hit = hit | contains_ignoring_case(F.col(c), words)
    return documents.filter(hit)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each group; the group limit below the exchange keeps hot groups small."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= n)


def overlapping(events: DataFrame, first: str, last: str, since: Column, until: Column) -> DataFrame:
    """Events whose span [first, last] meets [since, until], ends included."""
    return events.filter((F.col(last) >= since) & (F.col(first) <= until))


def round_robin(rows: DataFrame, by: str, key: str, n: int, seed: str = "") -> DataFrame:
    """A sample that draws one row of each group in turn, in an order both hashed and reproducible."""
    turn = F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key))
    # no group gives more than n rows: the limit is planned below the exchange
    return rows.withColumn("turn", turn).filter(F.col("turn") <= n).orderBy("turn", F.col(by).asc_nulls_first(), key).limit(n)


def label_by_aliases(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The labels whose aliases occur, in the vocabulary's order."""
    from ..functions.text import alias_pattern

    labels = [F.when(text.rlike("|".join(alias_pattern(a) for a in aliases)), F.lit(label)) for label, aliases in vocabulary.items()]
    return F.array_compact(F.array(*labels))


def first_matching(text: Column, rules: dict[str, list[str]], default: str) -> Column:
    """The first rule one of whose keywords occurs, else the default."""
    from ..functions.text import alias_pattern

    out = F.lit(default)
    for label, words in reversed(rules.items()):
        out = F.when(text.rlike("|".join(alias_pattern(w) for w in words)), label).otherwise(out)
    return out


def binary_metrics(pairs: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row of tp, fp, fn, tn, precision, recall and wrong-merge rate to four places; 0 where nothing is divided."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = pairs.agg(count(predicted & actual).alias("tp"), count(predicted & ~actual).alias("fp"), count(~predicted & actual).alias("fn"), count(~predicted & ~actual).alias("tn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 4))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("wrong_merge_rate"))


def version_due(stored: Column, current: Column | str) -> Column:
    """Whether a row was never handled or by another version; never null."""
    wanted = F.lit(current) if isinstance(current, str) else current
    return ~stored.eqNullSafe(wanted)


def is_noise(title: Column, topic: Column, words: tuple[str, ...]) -> Column:
    """Whether a title without a topic holds one of the words, in any case; never null."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(title), F.lit(w.lower()))
    return F.coalesce((F.coalesce(topic, F.lit("")) == "") & hit, F.lit(False))


def is_followed(score: Column, texts: list[Column], follow: tuple[str, ...], least: float) -> Column:
    """Whether a score reaches ``least`` (an unreadable one is 0) and one of the words occurs in the texts; all rows without words to follow."""
    if not follow:
        return F.lit(True)
    hay = F.lower(F.concat_ws(" ", *texts))
    hit = F.lit(False)
    for w in follow:
        hit = hit | F.contains(hay, F.lit(w.lower()))
    return (F.coalesce(score.try_cast("double"), F.lit(0.0)) >= least) & F.coalesce(hit, F.lit(False))


def first_of_each(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, whose rank among all it keeps."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def set_fingerprint(rows: DataFrame, by: list[str], member: Column) -> DataFrame:
    """(by, fingerprint, members): SHA-256 over the sorted different SHA-256 of each group's members.

    The members of a group are one value here; use sums of hashes (``result_fingerprints``) where groups aren't small.
    """
    digests = rows.select(*by, F.sha2(member, 256).alias("d")).distinct()
    return digests.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("members"))
