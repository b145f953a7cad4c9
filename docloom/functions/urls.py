"""URL keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: scheme, authority, path, query of an absolute URL
ABSOLUTE = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, ABSOLUTE, n)


def tracking_free(query: Column) -> Column:
    """A query string without utm_* and ref parameters, in any case, and without empty ones."""
    return F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^(utm_[^=]*|ref)(=|$)")), "&")


def document_url_key(url: Column) -> Column:
    """Equal for URLs that differ only in the case of scheme and host, fragment,
    trailing slash and tracking parameters. Null for URLs without a path, for what
    isn't an absolute URL and for null."""
    clean = F.trim(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""))
    path = F.regexp_replace(_part(clean, 3), "/+$", "")
    query = tracking_free(_part(clean, 4))
    key = F.concat(F.lower(_part(clean, 1)), F.lit("://"), F.lower(_part(clean, 2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(path != "", key)


def canonical_url(url: Column) -> Column:
    """Without utm_* and ref parameters and without the fragment; everything else as it is."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = tracking_free(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    return F.when(url.isNotNull(), F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def url_key(url: Column) -> Column:
    """The key of equal addresses: lower-case scheme and host, no trailing slash (an empty
    path is /), the query as it is, no fragment. http and https differ. Null gives null."""
    clean = F.regexp_replace(url, r"(?U)^\s+|\s+$", "")
    path = F.regexp_replace(_part(clean, 3), "/+$", "")
    query = _part(clean, 4)
    whole = F.concat(F.lower(_part(clean, 1)), F.lit("://"), F.lower(_part(clean, 2)), F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(clean.rlike(ABSOLUTE), whole).otherwise(clean)
