"""Trailing-window enrichment: daily rollup, lookback join, completeness class,
lag pivot, and donor repair of incomplete windows.

Anchors are rows with ``row_id, <entity>, anchor_date``. All work is keyed on
the *distinct* ``(entity, anchor_date)`` pairs, so many anchors of one hot
entity and day cost one lookup, and results are joined back at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .geo import nearest_within

# Completeness classes of a lookback window.
MISSING, PARTIAL, HAS_NULLS, COMPLETE = "missing", "partial", "has_nulls", "complete"


def daily_rollup(df: DataFrame, entity: str, ts: str, measures: dict[str, Column],
                 day: str = "day") -> DataFrame:
    """One row per (entity, calendar day) with the given aggregate measures.
    Partial aggregation runs map-side, so a hot entity is pre-reduced before
    the shuffle."""
    return (df.groupBy(F.col(entity), F.to_date(F.col(ts)).alias(day))
              .agg(*[m.alias(n) for n, m in measures.items()]))


def _keys(anchors: DataFrame, entity: str, anchor_date: str) -> DataFrame:
    return anchors.select(entity, anchor_date).distinct()


def window_rows(keys: DataFrame, daily: DataFrame, entity: str, anchor_date: str,
                days: int = 5, day: str = "day") -> DataFrame:
    """Daily rows with day in [anchor_date - days, anchor_date - 1], per key.

    The interval is exploded into ``days`` exact offsets so the join is a pure
    equi-join on (entity, day) -- no nested-loop range join. Day 0 is never
    included (deliberate: the source sometimes kept it)."""
    ex = (keys.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(days))))
              .withColumn(day, F.date_sub(F.col(anchor_date), F.col("offset"))))
    return ex.join(daily, [entity, day], "inner")


def lookback_join(anchors: DataFrame, daily: DataFrame, *, row_id: str, entity: str,
                  anchor_date: str, days: int = 5, day: str = "day") -> DataFrame:
    """One row per (anchor, existing day in its window) with the daily measures."""
    w = window_rows(_keys(anchors, entity, anchor_date), daily, entity, anchor_date, days, day)
    return anchors.select(row_id, entity, anchor_date).join(w, [entity, anchor_date], "inner")


def _class_col(n_days: Column, n_null: Column, days: int) -> Column:
    return (F.when(n_days == 0, F.lit(MISSING))
             .when(n_days < days, F.lit(PARTIAL))
             .when(n_null > 0, F.lit(HAS_NULLS))
             .otherwise(F.lit(COMPLETE)))


def window_profile(anchors: DataFrame, daily: DataFrame, *, entity: str, anchor_date: str,
                   value_cols: list[str], days: int = 5, day: str = "day",
                   with_lags: bool = True) -> DataFrame:
    """Per distinct (entity, anchor_date): day count, null-day count, class and
    (optionally) the ``{col}_lag{k}`` pivot.

    Plan: distinct keys -> explode the ``days`` offsets -> LEFT equi-join to
    the daily rows on (entity, day) -> one grouped aggregation. The daily
    side is already hash-partitioned on (entity, day) by its own rollup, so
    the join only shuffles the exploded keys."""
    keys = _keys(anchors, entity, anchor_date)
    ex = (keys.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(days))))
              .withColumn(day, F.date_sub(F.col(anchor_date), F.col("offset"))))
    j = ex.join(daily.withColumn("_present", F.lit(1)), [entity, day], "left")
    null_any = F.greatest(*[F.col(c).isNull() for c in value_cols]) if len(value_cols) > 1 \
        else F.col(value_cols[0]).isNull()
    present = F.col("_present").isNotNull()
    aggs = [F.count(F.col("_present")).alias("n_days"),
            F.coalesce(F.sum(F.when(present & null_any, 1).otherwise(0)),
                       F.lit(0)).cast("long").alias("n_null_days")]
    if with_lags:
        # absent day -> NULL; (entity, day) is unique in a daily rollup, so max picks the one value
        aggs += [F.max(F.when(F.col("offset") == k, F.col(c))).alias(f"{c}_lag{k}")
                 for c in value_cols for k in range(days, 0, -1)]
    prof = j.groupBy(entity, anchor_date).agg(*aggs)
    return prof.withColumn("completeness", _class_col(F.col("n_days"), F.col("n_null_days"), days))


def _with_profile(anchors: DataFrame, prof: DataFrame, entity: str, anchor_date: str) -> DataFrame:
    """Every anchor with its window's profile; one with a NULL entity or date has
    no window and is ``missing``."""
    j = anchors.join(prof, [entity, anchor_date], "left")
    return j.fillna(0, ["n_days", "n_null_days"]).fillna(MISSING, ["completeness"])


def completeness_class(anchors: DataFrame, daily: DataFrame, *, row_id: str, entity: str,
                       anchor_date: str, value_cols: list[str], days: int = 5,
                       day: str = "day") -> DataFrame:
    prof = window_profile(anchors, daily, entity=entity, anchor_date=anchor_date,
                          value_cols=value_cols, days=days, day=day, with_lags=False)
    return _with_profile(anchors.select(row_id, entity, anchor_date), prof, entity, anchor_date)


def lag_pivot(lookback: DataFrame, *, row_id: str, value_cols: list[str], days: int = 5) -> DataFrame:
    """Long window rows (row_id, offset, values) -> one wide row per row_id with
    ``{col}_lag{k}`` for k = days..1; absent days are NULL; on duplicate
    (row_id, offset) the largest value wins (deterministic)."""
    return lookback.groupBy(row_id).agg(
        *[F.max(F.when(F.col("offset") == k, F.col(c))).alias(f"{c}_lag{k}")
          for c in value_cols for k in range(days, 0, -1)])


def lag_features(anchors: DataFrame, daily: DataFrame, *, row_id: str, entity: str,
                 anchor_date: str, value_cols: list[str], days: int = 5,
                 day: str = "day") -> DataFrame:
    """Anchors joined on their key to the window class and lag columns (anchors
    with no day in the window, or with a NULL key, are kept, with class ``missing``)."""
    prof = window_profile(anchors, daily, entity=entity, anchor_date=anchor_date,
                          value_cols=value_cols, days=days, day=day)
    return _with_profile(anchors, prof, entity, anchor_date).drop("n_days", "n_null_days")


def donor_assign(classes: DataFrame, coords: DataFrame, *, row_id: str, entity: str,
                 anchor_date: str, need: list[str], cap_miles: float = 60.0) -> DataFrame:
    """Nearest ``complete`` anchor of the same anchor_date within the cap, for
    every anchor whose class is in ``need``.

    ``classes``: row_id, entity, anchor_date, completeness.
    ``coords``: entity, lat, lon. Returns row_id, donor_row_id, distance_mi
    (NULL donor = reject; so is an anchor without coordinates or date)."""
    # the search reads both sides once or more a level: the classes are worked out once
    located = cut_lineage(classes.join(coords, entity, "left"))
    left = located.where(F.col("completeness").isin(need))
    right = located.where((F.col("completeness") == COMPLETE) & F.col("lat").isNotNull()).select(
        F.col(row_id).alias("donor_row_id"), anchor_date, "lat", "lon")
    return nearest_within(left, right, left_id=row_id, right_id="donor_row_id",
                          block=[anchor_date], cap_miles=cap_miles)


def donor_copy(lookback: DataFrame, donors: DataFrame, *, row_id: str,
               value_cols: list[str]) -> DataFrame:
    """Window rows of each anchor's donor, re-keyed to the anchor and tagged
    ``approximated = true`` with ``source_row_id`` = donor."""
    d = donors.where(F.col("donor_row_id").isNotNull()).select(row_id, "donor_row_id")
    src = lookback.select(F.col(row_id).alias("donor_row_id"), "offset", *value_cols)
    return (d.join(src, "donor_row_id", "inner")
             .select(row_id, "offset", *value_cols,
                     F.col("donor_row_id").alias("source_row_id"),
                     F.lit(True).alias("approximated"), F.lit(True).alias("from_donor")))


def donor_fill(lookback: DataFrame, donors: DataFrame, *, row_id: str,
               value_cols: list[str]) -> DataFrame:
    """Own window rows with NULL measures filled from the donor's row of the same
    offset (offset alignment, not position). As in the source, the whole
    window counts as ``approximated`` and keeps itself as source;
    ``from_donor`` tells which rows actually took a donor value."""
    d = donors.where(F.col("donor_row_id").isNotNull()).select(row_id, "donor_row_id")
    own = lookback.select(row_id, "offset", *value_cols).join(d, row_id, "inner")
    src = lookback.select(F.col(row_id).alias("donor_row_id"), "offset",
                          *[F.col(c).alias(f"_d_{c}") for c in value_cols])
    j = own.join(src, ["donor_row_id", "offset"], "left")
    filled = F.greatest(*[F.col(c).isNull() & F.col(f"_d_{c}").isNotNull() for c in value_cols]) \
        if len(value_cols) > 1 else (F.col(value_cols[0]).isNull() & F.col(f"_d_{value_cols[0]}").isNotNull())
    return j.select(row_id, "offset",
                    *[F.coalesce(F.col(c), F.col(f"_d_{c}")).alias(c) for c in value_cols],
                    F.col(row_id).alias("source_row_id"), F.lit(True).alias("approximated"),
                    filled.alias("from_donor"))
