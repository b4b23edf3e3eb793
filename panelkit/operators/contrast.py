"""Residual contrast: who is over-represented among the worst predictions.

Shares, lifts and counts are grouped aggregations with map-side partial
sums; medians and the worst-fraction flag use the exact order-statistic
operator, so no group is ever sorted or buffered whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .rank import exact_medians, top_k_flag


def flag_worst_fraction(df: DataFrame, score: str, key: str, fraction: float = 0.1,
                        flag: str = "is_extreme") -> DataFrame:
    """Flag the ``floor(fraction * n)`` rows with the largest ``score``, ties by
    smallest ``key``; the others (true complement) are the contrast group."""
    narrow = cut_lineage(df.select(F.col(key).alias("_k"), F.col(score).alias("_s"))
                           .where(F.col("_s").isNotNull()))
    n = narrow.count()
    return top_k_flag(df, score, key, int(fraction * n), flag, narrow=narrow, n=n)


def flag_contrast_groups(df: DataFrame, score: str, key: str, fraction: float = 0.1,
                         complement: str = "rest") -> DataFrame:
    """``is_extreme`` = the worst ``floor(fraction n)`` rows; ``is_other`` = the
    contrast group: every other row (``rest``), or the ``floor((1-fraction) n)``
    rows with the smallest scores (``bottom``) -- with n not divisible by 10,
    one row may then be in neither group, as in one source variant."""
    narrow = cut_lineage(df.select(F.col(key).alias("_k"), F.col(score).alias("_s"))
                           .where(F.col("_s").isNotNull()))
    n = narrow.count()
    out = top_k_flag(df, score, key, int(fraction * n), "is_extreme", narrow=narrow, n=n)
    if complement == "rest":
        return out.withColumn("is_other", ~F.col("is_extreme") & F.col(score).isNotNull())
    if complement != "bottom":
        raise ValueError("complement must be 'rest' or 'bottom'")
    n_bottom = int((1 - fraction) * n + 1e-9)
    out = top_k_flag(out, score, key, n - n_bottom, "_not_bottom", narrow=narrow, n=n)
    return out.withColumn("is_other", ~F.col("_not_bottom") & F.col(score).isNotNull()).drop("_not_bottom")


def value_shares(df: DataFrame, col: str, flag: str) -> DataFrame:
    """Relative frequency of each value among flagged rows and among all rows,
    for values present among the flagged rows (inner merge of the two)."""
    tot = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("k")).first()
    g = df.groupBy(col).agg(F.count_if(F.col(flag)).alias("n_extreme"), F.count(F.lit(1)).alias("n_all"))
    return (g.where(F.col("n_extreme") > 0)
             .select(col, "n_extreme", "n_all",
                     F.try_divide(F.col("n_extreme").cast("double"), F.lit(float(tot["k"]))).alias("share_extreme"),
                     F.try_divide(F.col("n_all").cast("double"), F.lit(float(tot["n"]))).alias("share_all")))


def share_lift(df: DataFrame, col: str, flag: str, top: int = 25) -> DataFrame:
    """Share among flagged rows / share among all rows, largest first (ties by
    value), top ``top`` -- a feature top-k, planned as TakeOrderedAndProject."""
    s = value_shares(df, col, flag).withColumn("lift", F.try_divide(F.col("share_extreme"), F.col("share_all")))
    return s.orderBy(F.col("lift").desc(), F.col(col).asc()).limit(top)


def median_contrast(df: DataFrame, features: list[str], flag: str, round_to: int | None = 4,
                    other: str | None = None) -> DataFrame:
    """Per numeric feature: median among flagged rows, median among the others,
    and (extreme - others) / others (signed denominator kept; 0 -> NULL).
    Medians are rounded to ``round_to`` places before the ratio when given.
    ``other`` names an explicit contrast-group flag (default: not flagged)."""
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    grp = f"`{flag}`" if other is None else f"CASE WHEN `{flag}` THEN true WHEN `{other}` THEN false END"
    long = df.selectExpr(f"stack({len(features)}, {stack}) AS (feature, value)", f"{grp} AS ext")
    long = cut_lineage(long.where(F.col("value").isNotNull() & F.col("ext").isNotNull()))
    counts = {(r["feature"], r["ext"]): r["n"] for r in
              long.groupBy("feature", "ext").agg(F.count(F.lit(1)).alias("n")).collect()}
    for c in features:
        for e in (True, False):
            counts.setdefault((c, e), 0)
    med = exact_medians(long, ["feature", "ext"], "value", counts, materialize=False)
    rows = []
    for c in features:
        a, b = med[(c, True)], med[(c, False)]
        if round_to is not None:
            a = None if a is None else round(a, round_to)
            b = None if b is None else round(b, round_to)
        rows.append((c, a, b))
    spark = df.sparkSession
    out = spark.createDataFrame(rows, "feature string, extreme double, others double")
    return out.withColumn("pct_diff", F.try_divide(F.col("extreme") - F.col("others"), F.col("others")))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram: bounds from one min/max pass, then
    ``floor((x - lo) / w)`` with the top edge clamped into the last bin;
    empty bins have a count of 0."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    w = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(w)).cast("int"), F.lit(bins - 1))
    h = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    h = every.join(F.broadcast(h), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # bins rows
    return h.select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("hi"), "n")
