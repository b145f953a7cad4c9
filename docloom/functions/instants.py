"""Parsing of times as sources write them, as JVM column expressions.

Every accepted spelling is first rewritten to one line of fields
``year|month|day|time|half|zone|region`` and only then computed with, so a new spelling is one more row of ``SPELLINGS``.
"""

from __future__ import annotations

import zoneinfo
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Month names of the languages the sources write in, lower case, without a final point.
MONTHS = {
    1: "jan january januar jänner jän janvier janv enero ene janeiro gennaio",
    2: "feb february februar février févr fév febrero fevereiro febbraio",
    3: "mar march märz mär mrz mars marzo março",
    4: "apr april avril avr abril abr aprile",
    5: "may mai mayo maio maggio",
    6: "jun june juni juin junio junho giugno",
    7: "jul july juli juillet juil julio julho luglio",
    8: "aug august août aout agosto ago",
    9: "sep sept september septembre septiembre setiembre setembro settembre",
    10: "oct october oktober okt octobre octubre outubro ottobre",
    11: "nov november novembre noviembre novembro",
    12: "dec december dezember dez décembre déc diciembre dic dezembro dicembre",
}

#: Hours from UTC of zone abbreviations where the endpoint's own zone doesn't know them.
ABBREVIATIONS = {
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
    "AST": -4, "ADT": -3, "NST": -3.5, "NDT": -2.5, "BRT": -3, "BRST": -2, "ART": -3, "WET": 0, "WEST": 1, "BST": 1, "CET": 1,
    "CEST": 2, "MEZ": 1, "MESZ": 2, "EET": 2, "EEST": 3, "MSK": 3, "IST": 5.5, "PKT": 5, "ICT": 7, "HKT": 8, "SGT": 8, "PHT": 8,
    "AWST": 8, "JST": 9, "KST": 9, "ACST": 9.5, "ACDT": 10.5, "AEST": 10, "AEDT": 11, "NZST": 12, "NZDT": 13,
}

_CLOCK = r"(?:(?:,?[Tt\s]+|,\s*)(?:à |um |at |a las )?(\d{1,2})[:hH](\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?\s?[Mm]\.?)?(?:\s*Uhr)?)?"
_ZONE = r"\s*((?:UTC|GMT)?[+\-−]\d{2}(?::?\d{2})?|[A-Za-z]{1,5})?(?:\[([A-Za-z0-9_+\-/]+)\])?$"
_WEEKDAY = r"^(?:[\p{L}]{2,10}\.?,?\s+)?"
_MONTH = r"([\p{L}]{3,10})\.?"

#: (pattern, its fields; Y first, M the month as digits, N its name, 123 three numbers in the endpoint's order)
SPELLINGS = (
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _CLOCK + _ZONE, "YMD"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?(\b)?" + _ZONE, "YMD"),
    (_WEEKDAY + r"(\d{1,2})(?:\.|er|st|nd|rd|th)?[\s-](?:de )?" + _MONTH + r"[\s-](?:de )?(\d{4})" + _CLOCK + _ZONE, "DNY"),
    (_WEEKDAY + _MONTH + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _CLOCK + _ZONE, "NDY"),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _CLOCK + _ZONE, "123"),
    (r"^(\d{4})\s?年\s?(\d{1,2})\s?月\s?(\d{1,2})\s?日" + _CLOCK.replace(r"(?:,?[Tt\s]+|,\s*)", r"\s*").replace("[:hH]", "[:：时時]") + _ZONE, "YMD"),
)
_PLACES = {"YMD": "$1|$2|$3", "DNY": "$3|$2|$1", "NDY": "$3|$1|$2"}


def zone_abbreviations(spark: SparkSession) -> DataFrame:
    """(policy_timezone, offsets map<string,int>): what an abbreviation means in each IANA zone, in seconds.

    Read off the time-zone database in the winter and summer of the last decades;
    a few hundred rows whatever the data. The later meaning of an abbreviation wins.
    """
    rows = []
    for name in sorted(zoneinfo.available_timezones()):
        zone, known = zoneinfo.ZoneInfo(name), {}
        for year in range(1990, 2031):
            for month in (1, 4, 7, 10):
                there = datetime(year, month, 1, tzinfo=UTC).astimezone(zone)
                if there.tzname().isalpha():
                    known[there.tzname()] = int(there.utcoffset().total_seconds())
        rows.append((name, known))
    return spark.createDataFrame(rows, "policy_timezone string, offsets map<string,int>")


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", r"\x27") + "'"


def epoch_micros(df: DataFrame, text: str, zone: str, date_order: str, offsets: str, out: str = "epoch_us") -> DataFrame:
    """Add ``out``: the UTC instant that ``text`` names, in microseconds since 1970, or null.

    ``zone`` (IANA), ``date_order`` (dmy, mdy, ymd) and ``offsets`` (abbreviation to
    seconds) are the columns that hold the writer's conventions. Absent parts of the
    time are zero, what is finer than a microsecond is cut off. Local times that
    happened twice are the earlier of the two; skipped ones count with the offset
    before the change. Bare numbers are seconds below 1e11, milliseconds below 1e14,
    microseconds below 1e17. Null, blank and impossible times give null, as does a
    local time whose zone is unknown.
    """
    fields = "__s"  # what one pattern has rewritten no later one matches
    for pattern, places in SPELLINGS:
        date = f"'{_PLACES[places]}'" if places in _PLACES else f"CASE {date_order} WHEN 'mdy' THEN '$3|$1|$2' ELSE '$3|$2|$1' END"
        fields = f"regexp_replace({fields}, {_quoted(pattern)}, {date} || '|$4:$5:$6.$7|$8|$9|$10')"
    months = {w: m for m, words in MONTHS.items() for w in words.split()} | {f"{m:0{n}}": m for m in range(1, 13) for n in (1, 2)}
    names = ", ".join(f"'{w}', '{m}'" for w, m in months.items())
    regions = ", ".join(f"'{z}'" for z in sorted(zoneinfo.available_timezones()))
    known = ", ".join(f"'{a}', {int(h * 3600)}" for a, h in ABBREVIATIONS.items())
    df = df.withColumn("__s", F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", ""))
    df = df.withColumn("__f", F.expr(fields))
    df = df.withColumn("__f", F.expr("CASE WHEN __f RLIKE '^[0-9]{4}([|][^|]*){6}$' THEN split(__f, '[|]', -1) END"))
    df = df.withColumns(
        {
            # the local time as though it were UTC; the cast checks the calendar and cuts off what is finer than a microsecond
            "__wall": F.expr(
                f"unix_micros(try_cast(concat(__f[0], '-', map({names})[lower(__f[1])], '-', __f[2], ' ', rtrim('.', substr(regexp_replace(':' || __f[3], ':(?=[:.])', ':0'), 2)), 'Z') AS timestamp))"
            ),
            "__half": F.expr("lower(__f[4])"),
            "__zone": F.expr("upper(replace(__f[5], '−', '-'))"),
            "__number": F.expr(
                "CASE WHEN __s RLIKE '^[+-]?[0-9]{1,17}([.][0-9]+)?$' THEN try_cast(regexp_extract(__s, '^([^.]+([.][0-9]{1,9})?)', 1) AS decimal(38, 9)) END"
            ),
        }
    )
    df = df.withColumns(
        {
            "__hour": F.expr("pmod(__wall, 86400000000L) div 3600000000L"),
            "__sign": F.expr("regexp_replace(__zone, '^(UTC|GMT)?([+-])([0-9]{2}):?([0-9]{2})?$', '$2$3|$4')"),
        }
    )
    df = df.withColumns(
        {
            "__local": F.expr(
                "CASE WHEN __half = '' THEN __wall WHEN __hour BETWEEN 1 AND 12 THEN __wall + 3600000000L *"
                " (CASE WHEN __half = 'p' AND __hour < 12 THEN 12 WHEN __half = 'a' AND __hour = 12 THEN -12 ELSE 0 END) END"
            ),
            "__offset": F.expr(
                "CASE WHEN contains(__sign, '|') THEN CASE WHEN substr(__sign, 2, 2) <= '18' AND substr(__sign, 5) < '60' THEN"
                " (try_cast(substr(__sign, 1, 3) AS int) * 3600 + coalesce(try_cast(substr(__sign, 1, 1) || nullif(substr(__sign, 5), '') AS int), 0) * 60) END"
                f" WHEN __zone IN ('Z', 'UTC', 'GMT', 'UT') THEN 0 ELSE coalesce({offsets}[__zone], map({known})[__zone]) END"
            ),
        }
    )
    return df.withColumn(
        out,
        F.expr(
            "CASE WHEN __number IS NOT NULL THEN bigint(__number *"
            " CASE WHEN abs(__number) < 100000000000 THEN 1000000 WHEN abs(__number) < 100000000000000 THEN 1000 ELSE 1 END)"
            " WHEN __zone != '' THEN __local - __offset * 1000000L"
            f" ELSE unix_micros(to_utc_timestamp(timestamp_micros(__local), CASE WHEN __f[6] IN ({regions}) THEN __f[6]"
            f" WHEN __f[6] = '' AND {offsets} IS NOT NULL THEN {zone} END)) END"
        ),
    ).drop("__s", "__f", "__wall", "__half", "__zone", "__number", "__hour", "__sign", "__local", "__offset")
