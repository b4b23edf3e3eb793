"""Exact order statistics without a global sort or a whole group in one task.

``exact_order_stats`` finds, per target, the value of a given 1-based rank
(ascending) within a group of rows. It narrows a value band by rounds:
each round takes 1001 approximate quantiles of the band per target
(``percentile_approx``, partial aggregation, bounded sketch), keeps the few
quantile steps around the wanted rank, and re-counts exactly. The band shrinks
by a factor of ~300 per round, so even 10^12 rows need about four rounds;
once a band holds at most ``exact_limit`` rows, the exact value comes from a
per-target row_number over that band only. Only a few numbers per target
ever reach the driver.

``kth_values`` does the same for keys that a double can't hold (60-bit ids,
decimals, texts, dates) by radix selection: keys become texts whose order is
the keys' order, and rounds count the rows by the next four characters after
the prefix that the band shares (65,536 counts at most).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

_STEPS = 1000


def exact_order_stats(df: DataFrame, value: str, targets: list[tuple], group_cols: list[str] | None = None,
                      exact_limit: int = 200_000, accuracy: int = 20_000, materialize: bool = True,
                      counts: dict | None = None) -> dict:
    """``targets``: list of (target_id, group_values_tuple, rank). Returns
    {target_id: value}. NULL values are ignored; a rank outside 1..n gives None.
    ``counts`` ({target_id: non-null rows of its group}), when known, lets
    small groups skip the sketch round and go straight to the exact pass."""
    spark = df.sparkSession
    group_cols = group_cols or []
    data = df.select(*group_cols, F.col(value).alias("_v")).where(F.col("_v").isNotNull())
    if materialize:
        # several passes follow: read the narrow (group, value) rows from the
        # shared checkpoint folder instead of recomputing their lineage
        data = cut_lineage(data)
    # state: target -> (lo exclusive or None, hi inclusive or None, rank within band)
    state = {t: [None, None, r, g] for t, g, r in targets}
    result = {}
    rounds = 0
    known = dict(counts or {})
    while state:
        if known and all(t in known for t in state):
            small = [t for t in state if known[t] <= exact_limit and 1 <= state[t][2] <= known[t]]
            for t in list(state):
                if not 1 <= state[t][2] <= known[t]:
                    result[t] = None
                    del state[t]
            if not state:
                break
            if small and len(small) == len(state):
                _exact_pass(spark, data, df, group_cols, {t: state[t] for t in small}, result)
                break
        known = {}
        sdf = spark.createDataFrame(
            [(t, *g, lo, hi) for t, (lo, hi, _r, g) in state.items()],
            f"_t string, {', '.join(f'{c} {dict(df.dtypes)[c]}' for c in group_cols) + ', ' if group_cols else ''}"
            "_lo double, _hi double")
        band = _band(data, sdf, group_cols)
        pcts = [i / _STEPS for i in range(_STEPS + 1)]
        stats = {r["_t"]: (r["n"], r["q"], r["lo"], r["hi"]) for r in band.groupBy("_t").agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
            F.percentile_approx("_v", pcts, accuracy).alias("q")).collect()}
        small, nxt = [], {}
        for t, (lo, hi, r, g) in state.items():
            n, q, least, most = stats.get(t, (0, None, None, None))
            if r < 1 or r > n:
                result[t] = None
            elif least == most:
                result[t] = least  # a run of equal values, of whatever length
            elif n <= exact_limit:
                small.append(t)
            else:
                i = min(_STEPS, max(0, int(r * _STEPS // n)))
                new_lo = q[i - 2] if i - 2 >= 0 else lo
                new_hi = q[min(_STEPS, i + 2)] if i + 2 <= _STEPS else hi
                nxt[t] = (new_lo, new_hi)
        if small:
            _exact_pass(spark, data, df, group_cols, {t: state[t] for t in small}, result)
        if not nxt:
            break
        # exact re-count: how many band rows fall at or below the new lower bound,
        # and how many inside the new band
        sdf3 = spark.createDataFrame(
            [(t, *state[t][3], state[t][0], state[t][1], nl, nh) for t, (nl, nh) in nxt.items()],
            f"_t string, {', '.join(f'{c} {dict(df.dtypes)[c]}' for c in group_cols) + ', ' if group_cols else ''}"
            "_lo double, _hi double, _nlo double, _nhi double")
        b3 = _band(data, sdf3, group_cols, extra=["_nlo", "_nhi"])
        below = F.col("_nlo").isNotNull() & (F.col("_v") <= F.col("_nlo"))
        strictly_below = F.col("_nlo").isNotNull() & (F.col("_v") < F.col("_nlo"))
        inside = ~below & (F.col("_nhi").isNull() | (F.col("_v") <= F.col("_nhi")))
        cnt = {r["_t"]: (r["lt"], r["b"], r["i"]) for r in b3.groupBy("_t").agg(
            F.count_if(strictly_below).alias("lt"), F.count_if(below).alias("b"),
            F.count_if(inside).alias("i")).collect()}
        new_state = {}
        rounds += 1
        if rounds > 16:
            raise RuntimeError("order statistic did not converge")
        for t, (nl, nh) in nxt.items():
            lo, hi, r, g = state[t]
            lt, b, i = cnt.get(t, (0, 0, 0))
            if nl is not None and lt < r <= b:
                result[t] = nl          # the wanted rank sits in a run of ties at nl
            elif b < r <= b + i:
                new_state[t] = [nl, nh, r - b, g]
            else:
                # the sketch missed (outside its error bound): keep the band, sharpen it
                accuracy = accuracy * 4
                new_state[t] = [lo, hi, r, g]
        state = new_state
    return result


def _exact_pass(spark, data: DataFrame, df: DataFrame, group_cols: list[str], sub: dict, result: dict) -> None:
    """Exact value of each target's rank inside its (small) band: one window
    per target over at most ``exact_limit`` rows."""
    sdf2 = spark.createDataFrame(
        [(t, *g, lo, hi, r) for t, (lo, hi, r, g) in sub.items()],
        f"_t string, {', '.join(f'{c} {dict(df.dtypes)[c]}' for c in group_cols) + ', ' if group_cols else ''}"
        "_lo double, _hi double, _r long")
    b2 = _band(data, sdf2, group_cols, extra=["_r"])
    w = Window.partitionBy("_t").orderBy("_v")
    for row in (b2.withColumn("_rn", F.row_number().over(w))
                  .where(F.col("_rn") == F.col("_r")).select("_t", "_v").collect()):
        result[row["_t"]] = row["_v"]
    for t in sub:
        result.setdefault(t, None)


def _band(data: DataFrame, sdf: DataFrame, group_cols: list[str], extra: list[str] | None = None) -> DataFrame:
    """Rows of each target's current band (lo, hi]. The target table is tiny
    (one row per target), so it is broadcast; a target without groups meets
    every row (join on a constant key)."""
    extra = extra or []
    s = sdf if group_cols else sdf.withColumn("_one", F.lit(1))
    d = data if group_cols else data.withColumn("_one", F.lit(1))
    keys = group_cols or ["_one"]
    j = d.join(F.broadcast(s), keys, "inner")
    cond = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & \
           (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    return j.where(cond).select("_t", "_v", *extra)


def ordered_text(c: Column, dtype: T.DataType) -> Column:
    """A text of hexadecimal digits that sorts like the value."""
    if isinstance(dtype, T.StringType):
        return F.hex(F.encode(c, "UTF-8"))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.DecimalType):
        digits = F.lpad(F.regexp_replace(F.abs(c).cast("string"), "[.]", ""), 40, "0")
        return F.when(c >= 0, F.concat(F.lit("1"), digits)).otherwise(F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210")))
    if isinstance(dtype, T.DateType):
        c = F.unix_date(c)
    elif isinstance(dtype, T.TimestampNTZType):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(dtype, T.TimestampType):
        c = F.unix_micros(c)
    return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")


def kth_values(df: DataFrame, key: str, ranks: list[int], exact_limit: int = 200_000) -> list:
    """The non-NULL values of the given 1-based ranks, ascending, exact for any
    orderable type (None for a rank outside 1..n). ``df`` should be stored."""
    dtype = df.schema[key].dataType
    rows = df.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull())
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        got = exact_order_stats(rows, "_k", [(str(r), (), r) for r in ranks], exact_limit=exact_limit)
        return [got.get(str(r)) for r in ranks]
    coded = rows.withColumn("_t", ordered_text(F.col("_k"), dtype))
    known: dict[str, tuple] = {}  # shared prefix -> (next characters, counts), one row per value

    def counts(prefix: str) -> list:
        if prefix not in known:
            band = coded.where(F.col("_t").startswith(prefix))
            at = F.substring("_t", len(prefix) + 1, 4)
            known[prefix] = band.groupBy(at.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("lo"), F.max("_t").alias("hi"),
                                                            F.min("_k").alias("least")).orderBy("p").collect()
        return known[prefix]

    def one(rank: int):
        prefix, left = "", rank
        while True:
            for c in counts(prefix):
                if left <= c["n"]:
                    break
                left -= c["n"]
            else:
                return None
            if left < 1 or c["lo"] == c["hi"]:
                return c["least"] if left >= 1 else None
            if c["n"] <= exact_limit:
                # a shorter key ends before the next four characters and sorts first
                inside = F.col("_t").startswith(prefix) & (F.substring("_t", len(prefix) + 1, 4) == c["p"])
                w = Window.orderBy("_k")  # at most exact_limit rows
                return coded.where(inside).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == left).first()["_k"]
            prefix = os.path.commonprefix([c["lo"], c["hi"]])

    return [one(r) for r in ranks]


def top_k_flag(df: DataFrame, score: str, key: str, k: int, flag: str = "is_extreme",
               narrow: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """Flag the ``k`` rows with the largest ``score`` (ties: smallest ``key``, of any
    orderable type), exactly, without ordering the whole table. ``narrow`` may
    hold the already materialised ``(_k, _s)`` = (key, score) rows."""
    if k <= 0:
        return df.withColumn(flag, F.lit(False))
    if narrow is None:
        narrow = cut_lineage(df.select(F.col(key).alias("_k"), F.col(score).alias("_s"))
                               .where(F.col("_s").isNotNull()))
    if isinstance(narrow.schema["_s"].dataType, (T.DoubleType, T.FloatType)):
        neg = narrow.select((-F.col("_s")).alias("_ns"))
        v = exact_order_stats(neg, "_ns", [("k", (), k)], materialize=False,
                              counts={"k": n} if n is not None else None).get("k")
        thr = None if v is None else -v
    else:
        thr = kth_values(narrow, "_s", [narrow.where(F.col("_s").isNotNull()).count() - k + 1])[0]
    if thr is None:  # fewer rows than k: everything is extreme
        return df.withColumn(flag, F.col(score).isNotNull())
    c = narrow.agg(F.count_if(F.col("_s") > F.lit(thr)).alias("above"),
                   F.count_if(F.col("_s") == F.lit(thr)).alias("ties")).first()
    m = k - c["above"]
    if m == c["ties"]:
        # the cut falls after the last tie: no key order needed
        is_top = F.col(score) >= F.lit(thr)
    else:
        kmax = kth_values(narrow.where(F.col("_s") == F.lit(thr)), "_k", [m])[0]
        is_top = (F.col(score) > F.lit(thr)) | ((F.col(score) == F.lit(thr)) & (F.col(key) <= F.lit(kmax)))
    return df.withColumn(flag, F.coalesce(is_top, F.lit(False)))


def exact_medians(df: DataFrame, group_cols: list[str], value: str, counts: dict,
                  materialize: bool = True) -> dict:
    """Median per group (mean of the two middle values when n is even), exact.
    ``counts``: {group_tuple: n non-null}. Returns {group_tuple: median}."""
    targets = []
    for g, n in counts.items():
        if not n:
            continue
        lo_r, hi_r = (n + 1) // 2, n // 2 + 1
        targets.append((f"{'|'.join(map(str, g))}|lo", g, lo_r))
        targets.append((f"{'|'.join(map(str, g))}|hi", g, hi_r))
    tcounts = {t: counts[g] for t, g, _r in targets}
    vals = exact_order_stats(df, value, targets, group_cols, materialize=materialize,
                             counts=tcounts) if targets else {}
    out = {}
    for g, n in counts.items():
        if not n:
            out[g] = None
            continue
        a = vals[f"{'|'.join(map(str, g))}|lo"]
        b = vals[f"{'|'.join(map(str, g))}|hi"]
        out[g] = a if (n % 2 == 1) else a + (b - a) * 0.5
    return out
