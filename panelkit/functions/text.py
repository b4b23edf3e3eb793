"""String rules as built-in Column expressions (no Python UDF anywhere).

Each function takes and returns a Column, so it composes inside select /
withColumn and stays in whole-stage codegen (except the higher-order LCS,
which Spark interprets but still runs in the JVM).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Regex flags: (?U) makes \s and \d Unicode-aware like Python 3's re on text
# (report text carries no-break spaces); (?d) lets '.' and '$' treat only LF as
# a line end, as Python does. The single-digit rule stays ASCII because its
# digits are cast to int.


def strip_all(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind
    (Spark's ``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def collapse_ws(c) -> Column:
    """Runs of whitespace, CR and LF become one space."""
    return F.regexp_replace(_c(c), r"(?U)[\r\n\s]+", " ")


def entity_name(c) -> Column:
    """Text before the first ``<space><4+ digits>`` run, stripped; else unchanged.

    ``SONOMA 1107*`` -> ``SONOMA``; ``BELL`` -> ``BELL``; NULL stays NULL.
    """
    c = _c(c)
    # (?d): '.' stops only at LF, as in Python and RE2 (Java's '.' also stops at CR)
    return F.when(c.rlike(r"(?U)\s\d{4,}"),
                  strip_all(F.regexp_extract(c, r"(?dU)(.*?)(?=\s\d{4,}\*?)", 1))).otherwise(c)


def max_digit(c) -> Column:
    """Largest single digit anywhere in the text, else 0 (NULL gives 0 too)."""
    digits = F.regexp_extract_all(_c(c), F.lit(r"(\d)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(digits, lambda d: d.cast("int"))), F.lit(0))


def first_5digit(c) -> Column:
    """First run of five digits ('' when there is none)."""
    return F.regexp_extract(_c(c), r"\d{5}", 0)


def name_stem(c) -> Column:
    """Sibling stem: drop a trailing ``-?digits`` and strip. (?d): '$' may sit
    before a final LF only, as in Python (Java also accepts a final CR)."""
    return strip_all(F.regexp_replace(_c(c), r"(?dU)-?\d+$", ""))


def join_key_clean(c) -> Column:
    """Key cleaning before an outer join: drop CR/LF, ``*`` and whitespace before a digit."""
    c = F.regexp_replace(_c(c), r"[\r\n]+", "")
    c = F.regexp_replace(c, r"\*", "")
    return F.regexp_replace(c, r"(?U)\s(?=\d)", "")


def match_key_left(c) -> Column:
    """Left side of the fuzzy match: drop '.', ' NO', digits; strip."""
    c = F.regexp_replace(_c(c), r"\.", "")
    c = F.regexp_replace(c, " NO", "")
    return strip_all(F.regexp_replace(c, r"(?U)\d", ""))


def match_key_right(c) -> Column:
    """Right side of the fuzzy match: drop digits and '&', then ' TAP'; strip."""
    c = F.regexp_replace(_c(c), r"(?U)[\d&]", "")
    return strip_all(F.regexp_replace(c, " TAP", ""))


def split_second(c, sep: str = ",") -> Column:
    """Second field of a delimited text (``state,county`` -> county); NULL if absent."""
    return F.try_element_at(F.split(_c(c), sep), F.lit(2))


def token_sort_key(c) -> Column:
    """Token-sort normal form: keep ASCII, non-word characters -> space, lower,
    split on whitespace, sort tokens, join with one space."""
    c = F.regexp_replace(_c(c), r"[^\x00-\x7F]", "")
    c = F.lower(F.regexp_replace(c, r"[^A-Za-z0-9_]", " "))
    toks = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(toks), " ")


def lcs_length(a, b) -> Column:
    """Longest common subsequence length of two strings, as one JVM expression.

    Dynamic programming over the characters of ``a``: the state is the DP row
    (length(b)+1 ints); each character of ``a`` folds a new row left to right.
    Empty inputs are guarded because ``sequence(1, 0)`` counts down in Spark.
    """
    a, b = _c(a), _c(b)
    lb = F.length(b)

    def step(row, ch):
        def cell(acc, j):
            up = F.element_at(row, j + 1)
            left = F.element_at(acc, j)
            diag = F.element_at(row, j)
            return F.array_append(
                acc, F.when(F.substring(b, j, 1) == ch, diag + 1).otherwise(F.greatest(up, left)))
        return F.aggregate(F.sequence(F.lit(1), lb), F.array(F.lit(0)), cell)

    dp = F.aggregate(F.split(a, ""), F.array_repeat(F.lit(0), lb + 1), step)
    return F.when((F.length(a) == 0) | (lb == 0), F.lit(0)).otherwise(F.element_at(dp, -1))


def indel_ratio(a, b) -> Column:
    """``round_half_even(100 * 2 * LCS / (len a + len b))``; 0 when either is empty."""
    a, b = _c(a), _c(b)
    la, lb = F.length(a), F.length(b)
    r = F.bround(F.lit(200.0) * lcs_length(a, b) / (la + lb), 0).cast("int")
    return F.when((la == 0) | (lb == 0), F.lit(0)).otherwise(r)


def token_sort_ratio(a, b) -> Column:
    """Fuzzy token-sort ratio (0..100) of two raw strings."""
    return indel_ratio(token_sort_key(a), token_sort_key(b))
