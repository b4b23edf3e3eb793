"""Penalised least squares with one wide category, from sums by category.

A category's 0/1 columns have no products with each other, so their block of the
moments is diagonal: given the intercept and the numeric coefficients, each
category's coefficient is a soft threshold of its own residual sum. What is left
is a convex, piecewise quadratic problem in the few numeric coefficients, solved
by Newton steps. A step needs sums over the categories: every (fold, setting) of
a search takes its step in the same pass over the table of categories' sums, so
no task and no driver holds more than a chunk of categories.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 1024  # categories a row of the chunked table
PASSES = 200


def category_sums(train: DataFrame, zfeatures: list[str], label: str, label_mean: float, category: str, size: int, fold: str) -> DataFrame:
    """(fold, category, s0, s1, ..): rows, sums of the features and of label - its mean."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in zfeatures], F.col(label).cast("double") - F.lit(label_mean)]
    return cut_lineage(train.where(F.col(category) < size).groupBy(F.col(fold).alias("fold"), F.col(category).alias("category")).agg(
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]))


def largest_product(sums: DataFrame, total: np.ndarray) -> float:
    """Largest |centred product with the label| / n over all columns of the design."""
    n, y = total[0, 0], f"s{len(total) - 1}"
    c = total[1:-1, -1] / n - total[0, 1:-1] / n * total[0, -1] / n
    own = sums.groupBy("category").agg(F.abs(F.sum(y) - F.sum("s0") * F.lit(float(total[0, -1] / n))).alias("c")).agg(F.max("c")).first()[0]
    return max(float(np.abs(c).max(initial=0)), float(own or 0) / n)


def _chunks(sums: DataFrame, names: list, q: int) -> DataFrame:
    """(chunk, data): the sums of CHUNK categories as fold x category x column."""
    def pack(t: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros((len(names), CHUNK, q))
        block[[names.index(f) for f in t["fold"]], t["category"] % CHUNK] = t[[f"s{i}" for i in range(q)]]
        return pd.DataFrame({"chunk": [int(t["category"].iloc[0]) // CHUNK], "data": [block.tobytes()]})

    return sums.groupBy(F.floor(F.col("category") / CHUNK)).applyInPandas(pack, "chunk long, data binary")


def cross_validate_category(folds: dict[int, np.ndarray], sums: DataFrame, settings: list[dict]) -> list[dict]:
    """`models.cross_validate_moments` for a design of numeric columns, whose moments by
    fold are `folds`, and a category's 0/1 columns, whose sums are `sums`."""
    from .models import _feature_sign, penalties
    spark, names = sums.sparkSession, sorted(folds)
    total, q = sum(folds.values()), len(next(iter(folds.values())))
    held = [folds[f] for f in names]
    jobs = [(f, s) for f in range(len(names)) for s in range(len(settings))]
    n = np.array([total[0, 0] - held[f][0, 0] for f, _ in jobs])
    l1, l2 = np.array([penalties(settings[s], n[j]) for j, (_, s) in enumerate(jobs)]).T
    of = np.array([f for f, _ in jobs])
    up, low = np.triu_indices(q)
    data = cut_lineage(_chunks(sums, names, q))
    chunks, cores = data.count(), spark.sparkContext.defaultParallelism
    groups = max(1, -(-2 * cores // max(chunks, 1)))
    fixed = spark.sparkContext.broadcast((n, l1, l2, of, held, total))

    def step(v: np.ndarray, live: np.ndarray) -> dict:
        """{job: (objective, squared error on the held-out fold, Newton's next point)} at the points v."""
        shared = spark.sparkContext.broadcast((v, live))

        def add(batches):
            n, l1, l2, of, held, total = fixed.value
            v, live = shared.value
            kept = {}
            for b in batches:
                for group, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    block = np.frombuffer(raw).reshape(len(held), CHUNK, q)
                    whole, own = block.sum(axis=0), live[group::groups]
                    for f in range(len(held)):
                        j = own[of[own] == f]
                        if not len(j):
                            continue
                        s, at = whole - block[f], v[j].T
                        r, d = s @ at, s[:, :1] + n[j] * l2[j]
                        over = np.abs(r) - n[j] * l1[j]
                        w = np.where((over > 0) & (d > 0), 1 / np.where(d > 0, d, 1), 0.0)
                        c, sign = np.sign(r) * over * w, np.sign(r) * w
                        out = block[f]
                        part = np.concatenate([(s[:, up] * s[:, low]).T @ w, s.T @ sign, -(over * over * w).sum(axis=0)[None] / (2 * n[j]),
                                               (out[:, :1] * c * c - 2 * c * (out @ at)).sum(axis=0)[None]])
                        for k, x in zip(j, part.T):
                            kept[k] = kept[k] + x if k in kept else x
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array([x.tobytes() for x in kept.values()], pa.binary())], ["job", "part"])

        def solve(t: pd.DataFrame) -> pd.DataFrame:
            n, l1, l2, of, held, total = fixed.value
            v, rows = shared.value[0], []
            for j, x in t.groupby("job"):
                part = sum(np.frombuffer(p) for p in x["part"])
                schur, u = np.zeros((q, q)), part[len(up):len(up) + q]
                schur[up, low] = schur[low, up] = part[:len(up)]
                m, b = total - held[of[j]], -v[j, 1:-1]
                cost = v[j] @ m @ v[j] / (2 * n[j]) + l1[j] * np.abs(b).sum() + l2[j] / 2 * b @ b + part[-2]
                sse = v[j] @ held[of[j]] @ v[j] + part[-1]
                h, pull = (m - schur) / n[j], l1[j] * u
                g, r = h[1:-1, 1:-1], h[1:-1, -1] + pull[1:-1]
                # else every row's category takes up a shift: only their penalties depend on the
                # intercept, which goes far downhill and is halved back into a bend
                free = h[0, 0] > 1e-11 * m[0, 0] / n[j]
                if free:
                    g, r = g - np.outer(h[0, 1:-1], h[0, 1:-1]) / h[0, 0], r - h[0, 1:-1] * (h[0, -1] + pull[0]) / h[0, 0]
                b = _feature_sign(g, r, b, l1[j], l2[j]) if l1[j] > 0 else np.linalg.lstsq(g + l2[j] * np.eye(q - 2), r, rcond=None)[0]
                b0 = (h[0, -1] + pull[0] - h[0, 1:-1] @ b) / h[0, 0] if free else -v[j, 0] + 4 * (m[-1, -1] / n[j]) ** 0.5 * np.sign(pull[0]) * (abs(pull[0]) > 1e-9 * l1[j])
                rows.append((int(j), float(cost), float(sse), [-float(b0), *(-b).tolist(), 1.0]))
            return pd.DataFrame(rows, columns=["job", "cost", "sse", "next"])

        crossed = data.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "data", "chunk")
        parts = crossed.repartition(2 * cores, "group", "chunk").select("group", "data").mapInArrow(add, "job long, part binary")
        got = parts.groupBy(F.pmod("job", F.lit(4 * cores))).applyInPandas(solve, "job long, cost double, sse double, next array<double>").collect()
        return {r["job"]: (r["cost"], r["sse"], r["next"]) for r in got}  # a row of numeric coefficients a setting and fold

    at, cost = np.zeros((len(jobs), q)), np.full(len(jobs), np.inf)
    at[:, -1] = 1.0
    best, error, live = at.copy(), np.zeros(len(jobs)), np.arange(len(jobs))
    for _ in range(PASSES):
        got, left = step(at, live), []
        for j in live:
            now, sse, after = got[j]
            if not np.isfinite(cost[j]) or now < cost[j] - 1e-14 * abs(cost[j]):
                best[j], cost[j], error[j] = at[j], now, sse
                at[j] = after
            else:  # no gain: settled, or the step was too long
                at[j] = (at[j] + best[j]) / 2
            if np.abs(at[j] - best[j]).max() > 1e-9 * np.abs(best[j]).max():
                left.append(j)
        live = np.array(left, int)
        if not len(live):
            break
    else:
        raise RuntimeError(f"{len(live)} fits not settled after {PASSES} passes")
    rmse = np.sqrt(np.maximum(error, 0) / np.array([held[f][0, 0] for f in of])).reshape(len(names), -1).mean(axis=0)
    return [dict(s, cv_rmse=float(e)) for s, e in zip(settings, rmse)]
