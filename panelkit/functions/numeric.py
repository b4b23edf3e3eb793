"""Numeric parsing rules (ANSI-safe: try_cast / try_divide, NaN turned into NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_double(c) -> Column:
    """Text to double; bad text and NaN become NULL."""
    return nan_to_null(_c(c).try_cast("double"))


def strip_commas_double(c) -> Column:
    """``1,234`` -> 1234.0."""
    return to_double(F.regexp_replace(_c(c), ",", ""))


def census_number(c) -> Column:
    """Census text: a lone ``-`` is missing; otherwise drop ``+ , -`` then parse
    (``250,000+`` -> 250000.0)."""
    c = _c(c)
    return F.when(c == "-", F.lit(None).cast("double")).otherwise(
        to_double(F.regexp_replace(c, r"[+,\-]", "")))


def hemisphere(c) -> Column:
    """``121.5W`` -> -121.5, ``38.1N`` -> 38.1 (S and W are negative)."""
    c = F.upper(_c(c))
    sign = F.when(c.rlike("[SW]$"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * to_double(F.regexp_replace(c, "[NSEW]", ""))


def safe_ratio(num, den) -> Column:
    return F.try_divide(_c(num), _c(den))
