import random

import numpy as np
import pytest

from panelkit.operators.knn import knn_join
from panelkit.operators.rank import exact_medians, exact_order_stats, kth_values, top_k_flag


def test_order_stats_with_refinement(spark):
    rng = np.random.default_rng(1)
    vals = list(np.round(rng.normal(size=20000), 2)) + [0.5] * 5000
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, v double")
    srt = sorted(vals)
    got = exact_order_stats(df, "v", [(str(r), (), r) for r in (1, 999, 12500, 21000, 25000)], exact_limit=500)
    assert [got[str(r)] for r in (1, 999, 12500, 21000, 25000)] == [srt[r - 1] for r in (1, 999, 12500, 21000, 25000)]
    flagged = top_k_flag(df, "v", "id", 2600)
    sel = {r.id for r in flagged.where("is_extreme").collect()}
    exp = {i for i, _ in sorted(enumerate(vals), key=lambda t: (-t[1], t[0]))[:2600]}
    assert sel == exp


def test_medians(spark):
    rows = [(i % 2, float(v)) for i, v in enumerate([5, 1, 4, 2, 3, 9, 7, 7])]
    df = spark.createDataFrame(rows, "g int, v double")
    med = exact_medians(df, ["g"], "v", {(0,): 4, (1,): 4}, materialize=False)
    assert med[(0,)] == float(np.median([5, 4, 3, 7])) and med[(1,)] == float(np.median([1, 2, 9, 7]))


def test_knn_matches_brute_force(spark):
    rnd = random.Random(11)
    ref = [(j, round(rnd.uniform(0, 10), 1), round(rnd.uniform(0, 10), 1), float(j)) for j in range(300)]
    ref += [(1000 + j, 5.0, 5.0, 7.0) for j in range(12)]  # a hot spot of identical points
    q = [(i, round(rnd.uniform(-1, 11), 1), round(rnd.uniform(-1, 11), 1)) for i in range(80)] + [(500, 5.0, 5.0)]
    qdf = spark.createDataFrame(q, "qid long, x double, y double")
    rdf = spark.createDataFrame(ref, "rid long, x double, y double, t double")
    k = 7
    nb = knn_join(qdf, rdf, qid="qid", rid="rid", features=["x", "y"], k=k, payload=["t"])
    got = {}
    for r in nb.collect():
        got.setdefault(r.qid, []).append((r.rank, r.rid))
    for qid, x, y in q:
        exp = sorted(((x - a) ** 2 + (y - b) ** 2, rid) for rid, a, b, _ in ref)[:k]
        assert [rid for _, rid in sorted(got[qid])] == [rid for _, rid in exp]


def test_kfold_contiguous_matches_plain_kfold(spark):
    from panelkit.operators.features import kfold_contiguous
    df = spark.range(0, 1003).withColumnRenamed("id", "k")
    got = {r.k: r.fold for r in kfold_contiguous(df, "k", 5).collect()}
    sizes = [201, 201, 201, 200, 200]
    exp, i = {}, 0
    for f, sz in enumerate(sizes):
        for _ in range(sz):
            exp[i] = f
            i += 1
    assert got == exp


def test_contrast_groups_bottom_variant(spark):
    from panelkit.operators.contrast import flag_contrast_groups
    df = spark.createDataFrame([(i, float(i % 37)) for i in range(105)], "id long, s double")
    out = flag_contrast_groups(df, "s", "id", 0.1, complement="bottom").collect()
    ext = {r.id for r in out if r.is_extreme}
    oth = {r.id for r in out if r.is_other}
    order = sorted(range(105), key=lambda i: (-(i % 37), i))
    assert ext == set(order[:10]) and oth == set(order[-94:])
    assert len(ext | oth) == 104   # 105 rows: one row is in neither group


def test_knn_hot_cluster_uses_finer_levels_and_stays_exact(spark):
    rnd = random.Random(4)
    ref = [(j, rnd.uniform(0, 100), rnd.uniform(0, 100)) for j in range(150)]
    ref += [(1000 + j, 50 + rnd.uniform(0, 0.5), 50 + rnd.uniform(0, 0.5)) for j in range(1500)]  # hot spot
    q = [(i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(40)]
    q += [(500 + i, 50 + rnd.uniform(0, 0.5), 50 + rnd.uniform(0, 0.5)) for i in range(40)]
    qdf = spark.createDataFrame(q, "qid long, x double, y double")
    rdf = spark.createDataFrame(ref, "rid long, x double, y double")
    k = 3
    got = {}
    for r in knn_join(qdf, rdf, qid="qid", rid="rid", features=["x", "y"], k=k).collect():
        got.setdefault(r.qid, []).append((r.rank, r.rid))
    for qid, x, y in q:
        exp = sorted(((x - a) ** 2 + (y - b) ** 2, rid) for rid, a, b in ref)[:k]
        assert [rid for _, rid in sorted(got[qid])] == [rid for _, rid in exp]


def test_knn_many_features_exact(spark):
    rnd = random.Random(8)
    nf = 6
    ref = [(j, *[round(rnd.gauss(0, 1), 2) for _ in range(nf)]) for j in range(400)]
    q = [(i, *[round(rnd.gauss(0, 1), 2) for _ in range(nf)]) for i in range(60)]
    cols = [f"f{i}" for i in range(nf)]
    qdf = spark.createDataFrame(q, "qid long, " + ", ".join(f"{c} double" for c in cols))
    rdf = spark.createDataFrame(ref, "rid long, " + ", ".join(f"{c} double" for c in cols))
    k = 5
    got = {}
    for r in knn_join(qdf, rdf, qid="qid", rid="rid", features=cols, k=k).collect():
        got.setdefault(r.qid, []).append((r.rank, r.rid))
    for row in q:
        exp = sorted((sum((a - b) ** 2 for a, b in zip(row[1:], rr[1:])), rr[0]) for rr in ref)[:k]
        assert [rid for _, rid in sorted(got[row[0]])] == [rid for _, rid in exp]


def test_knn_duplicate_queries_each_get_neighbours(spark):
    ref = spark.createDataFrame([(j, float(j), 0.0) for j in range(20)], "rid long, x double, y double")
    q = spark.createDataFrame([(i, 3.2, 0.0) for i in range(50)] + [(99, None, 0.0)], "qid long, x double, y double")
    got = {}
    for r in knn_join(q, ref, qid="qid", rid="rid", features=["x", "y"], k=2).collect():
        got.setdefault(r.qid, []).append((r.rank, r.rid))
    assert got.pop(99) == [(None, None)]  # no location: kept, without neighbours
    assert len(got) == 50 and all(sorted(v) == [(1, 3), (2, 4)] for v in got.values())


def squared(x, y):
    total = 0.0
    for a, b in zip(x, y):  # plain additions: sum() compensates its rounding
        total += (a - b) * (a - b)
    return total


def brute_nearest(q, ref, k, group=None):
    want = {}
    for i, x, f in q:
        near = sorted((squared(x, y), j) for j, y, h in ref if group is None or f != h)[:k]
        want[i] = [(rank + 1, j) for rank, (_, j) in enumerate(near)] or [(None, None)]
    return want


def nearest_of(spark, q, ref, nf, k, **options):
    cols = [f"f{i}" for i in range(nf)]
    head = ", ".join(f"{c} double" for c in cols)
    qdf = spark.createDataFrame([(i, *x, f) for i, x, f in q], f"qid long, {head}, fold int")
    rdf = spark.createDataFrame([(j, *y, h, f"p{j}") for j, y, h in ref], f"rid long, {head}, fold int, note string")
    got = {}
    for r in knn_join(qdf, rdf, qid="qid", rid="rid", features=cols, k=k, payload=["note"], **options).collect():
        assert r.note == (None if r.rid is None else f"p{r.rid}")
        got.setdefault(r.qid, []).append((r.rank, r.rid))
    return {i: sorted(v, key=lambda t: t[0] or 0) for i, v in got.items()}


@pytest.mark.parametrize("nf,k,group", [(2, 3, "fold"), (6, 5, None), (6, 4, "fold"), (25, 7, None), (25, 50, "fold")])
def test_cells_equal_brute_force(spark, nf, k, group):
    """Clusters, ties (rounded values, repeated rows) and a hot spot."""
    rnd = random.Random(nf + k)

    def points(n, first):
        out = []
        for i in range(n):
            c = rnd.choice([0.0, 3.0, 9.0])
            out.append((first + i, [round(rnd.gauss(c, 1), 1) for _ in range(nf)], rnd.randrange(4)))
        return out + [(first + n + i, [3.0] * nf, i % 4) for i in range(30)]
    ref, q = points(500, 0), points(60, 5000)
    assert nearest_of(spark, q, ref, nf, k, **({"exclude": group} if group else {})) == brute_nearest(q, ref, k, group)


def test_cells_without_neighbours(spark):
    nan = float("nan")
    q = [(1, [1.0] * 5, 0), (2, [None] + [1.0] * 4, 0), (3, [nan] + [1.0] * 4, 0)]
    ref = [(7, [2.0] * 5, 0), (8, [None] * 5, 0), (9, [nan] * 5, 0)]
    assert nearest_of(spark, q, ref, 5, 3) == {1: [(1, 7)], 2: [(None, None)], 3: [(None, None)]}
    assert nearest_of(spark, q, [], 5, 3) == {i: [(None, None)] for i in (1, 2, 3)}
    assert nearest_of(spark, q[:1], ref, 5, 3, exclude="fold") == {1: [(None, None)]}


def test_grid_without_references(spark):
    q = [(1, [1.0, 2.0], 0)]
    assert nearest_of(spark, q, [], 2, 3) == {1: [(None, None)]}
    assert nearest_of(spark, q, [], 2, 3, block=["fold"]) == {1: [(None, None)]}


def test_rings_skip_far_cells(spark, monkeypatch):
    """Clustered points of 25 features: most rings are never visited, and no tile is large."""
    from panelkit.operators import knn_cells
    rnd = random.Random(3)
    centres = [[rnd.uniform(-50, 50) for _ in range(25)] for _ in range(30)]
    rows = [(j, *[c + rnd.gauss(0, 1) for c in centres[j % 30]]) for j in range(3000)]
    names = [f"_x{i}" for i in range(25)]
    refs = spark.createDataFrame(rows, "_r long, " + ", ".join(f"{c} double" for c in names)).cache()
    queries = refs.where("_r % 10 = 0").withColumnRenamed("_r", "_q").cache()
    visited = []
    real = knn_cells._meet
    monkeypatch.setattr(knn_cells, "TILE", 64)
    monkeypatch.setattr(knn_cells, "_meet", lambda v, t, s, *a: visited.append((v.join(t.groupBy("_unit").count(), "_unit").agg({"count": "sum"}).first()[0],
                                                                              t.groupBy("_unit", "_tile").count().agg({"count": "max"}).first()[0])) or real(v, t, s, *a))
    found = knn_cells.knn_cells_join(queries, refs, names, 5, [], False)
    assert found.count() == 1500
    assert sum(n or 0 for n, _ in visited) < 0.2 * 300 * 3000 and max(t for _, t in visited) < 128


def key_samples():
    import datetime as dt
    from decimal import Decimal
    rnd = random.Random(1)
    big = 1 << 60
    return [("long", [big + i for i in range(300)] + [-big - i for i in range(300)] + [0, -1, 1]),
            ("int", [rnd.randrange(-50, 50) for _ in range(900)]),
            ("string", ["customer#%09d" % rnd.randrange(400) for _ in range(500)] + ["", "a", "ab", "b", "Z", "é", "𝄞", "a\u0000"]),
            ("decimal(38,6)", [Decimal(rnd.randrange(-10**30, 10**30)).scaleb(-6) for _ in range(400)] + [Decimal("0.000001"), Decimal("-0.000001"), Decimal(0)]),
            ("date", [dt.date(1960, 1, 1) + dt.timedelta(days=rnd.randrange(40000)) for _ in range(400)]),
            ("timestamp_ntz", [dt.datetime(1969, 12, 31, 23, 59) + dt.timedelta(microseconds=rnd.randrange(10**9)) for _ in range(400)]),
            ("double", [rnd.gauss(0, 1) for _ in range(500)])]


@pytest.mark.parametrize("kind,values", key_samples(), ids=lambda x: x if isinstance(x, str) else "")
def test_ranks_of_any_key_type(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"k {kind}").repartition(3).cache()
    want = sorted(values, key=lambda v: v.encode() if isinstance(v, str) else v)
    ranks = [1, 2, len(values) // 3, len(values) // 2, len(values) - 1, len(values)]
    assert kth_values(df, "k", ranks, exact_limit=5) == [want[r - 1] for r in ranks]
    assert kth_values(df, "k", [0, len(values) + 1]) == [None, None]
    df.unpersist()


def test_ties_are_cut_by_keys_that_a_double_cannot_hold(spark):
    big = (1 << 59) + 1
    df = spark.createDataFrame([(big + i, 1.0, f"name {i:03d}") for i in range(40)], "id long, s double, name string")
    assert sorted(r.id - big for r in top_k_flag(df, "s", "id", 5).where("is_extreme").collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.name for r in top_k_flag(df, "s", "name", 3).where("is_extreme").collect()) == ["name 000", "name 001", "name 002"]
    assert sorted(r.id - big for r in top_k_flag(df, "id", "name", 4).where("is_extreme").collect()) == [36, 37, 38, 39]
    assert top_k_flag(df, "id", "name", 99).where("is_extreme").count() == 40


def test_contiguous_folds_of_text_and_large_keys(spark):
    from panelkit.operators.features import kfold_contiguous
    big = (1 << 59) + 1
    df = spark.createDataFrame([(big + i, f"k{i:04d}") for i in range(23)], "id long, name string")
    for key in ("id", "name"):
        got = [r.fold for r in kfold_contiguous(df, key, k=5).orderBy(key).collect()]
        assert got == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
