"""Date and time rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse_ws

# Strftime directives used by the report formats and their
# Spark datetime-pattern equivalents.
STRFTIME_TO_SPARK = {
    "%m": "M", "%d": "d", "%y": "yy", "%Y": "yyyy", "%H": "H", "%M": "mm", "%S": "ss",
}

# Texts that the source parser reads as "no time" (NaT) rather
# than as an unparseable value.
NAT_TEXTS = ["", "nan", "NaN", "NAN", "NaT", "nat", "NAT"]


def spark_pattern(strftime_fmt: str) -> str:
    return re.sub(r"%[a-zA-Z]", lambda m: STRFTIME_TO_SPARK[m.group(0)], strftime_fmt)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c, strftime_fmt: str) -> Column:
    """Report time with a fallback chain, as TIMESTAMP_NTZ.

    1. the given format; 2. for two-digit-year formats, the same with a
    four-digit year; 3. unparseable text without any digit -> 2000-01-01,
    with a digit -> 1970-01-01 (both sentinels, removed later by
    ``sentinel_filter``). NULL and NaT texts stay NULL. Whitespace runs are
    collapsed first.
    """
    txt = collapse_ws(_c(c))
    tries = [_parse_ntz(txt, spark_pattern(strftime_fmt))]
    if "%y" in strftime_fmt:
        tries.append(_parse_ntz(txt, spark_pattern(strftime_fmt.replace("%y", "%Y"))))
        # two-digit years 69..99 belong to the 1900s (POSIX pivot); Spark reads 20yy
        tries[0] = F.when(F.year(tries[0]) >= 2069, tries[0] - F.expr("INTERVAL 100 YEARS")).otherwise(tries[0])
    parsed = F.coalesce(*tries)
    sentinel = F.when(txt.rlike(r"\d"), F.lit("1970-01-01 00:00:00")).otherwise(F.lit("2000-01-01 00:00:00"))
    return (F.when(txt.isNull() | txt.isin(NAT_TEXTS), F.lit(None).cast("timestamp_ntz"))
            .otherwise(F.coalesce(parsed, sentinel.cast("timestamp_ntz"))))


def _parse_ntz(txt: Column, pattern: str) -> Column:
    """Wall-clock text -> TIMESTAMP_NTZ without any session time zone: the text
    is parsed with an explicit +0000 offset, and its epoch microseconds are
    added to the NTZ epoch (a local-zone round trip would shift times that
    fall in a daylight-saving gap). Unparseable text gives NULL."""
    inst = F.try_to_timestamp(F.concat(txt, F.lit(" +0000")), F.lit(pattern + " xx"))
    return F.timestamp_add("MICROSECOND", F.unix_micros(inst),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def minutes_between(start, end) -> Column:
    """Exact minutes from ``start`` to ``end`` as double (no time zone involved)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(60_000_000.0)
