import numpy as np
import pyarrow as pa
import pytest

from panelkit.operators.knn_cells import _nearest


@pytest.mark.parametrize("scale", [1.0, 1e200])
def test_a_tile_gives_the_nearest_of_each_query(scale):
    """Ties by id, a radius, an excluded group; values whose squares overflow."""
    r = np.random.default_rng(1)
    y, x = r.integers(0, 4, (90, 3)) * scale, r.integers(0, 4, (40, 3)) * scale
    ref_group, group = r.integers(0, 3, 90), r.integers(0, 3, 40)
    radius = np.where(np.arange(40) % 3 == 0, 2.0 * scale, np.inf)
    cols = lambda v: {n: pa.array(v[:, i]) for i, n in enumerate("abc")}
    refs = pa.table({"_r": pa.array(np.arange(90)), "_place": pa.array(np.arange(90)), "_group": pa.array(ref_group), **cols(y)})
    queries = pa.table({"_q": pa.array(np.arange(40)), "_radius2": pa.array(radius), "_group": pa.array(group), **cols(x)})
    got = _nearest(4, ["a", "b", "c"], True, ["_r"])(refs, queries).to_pylist()
    with np.errstate(over="ignore"):
        d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    want = []
    for q in range(40):
        ok = [j for j in range(90) if ref_group[j] != group[q] and d[q, j] <= radius[q]]
        want += [(q, d[q, j], j) for j in sorted(ok, key=lambda j: (d[q, j], j))[:4]]
    assert [(g["_q"], g["d2"], g["_r"]) for g in got] == want


def test_a_search_that_skips_nothing_sends_blocks_not_a_row_for_every_ring(spark, monkeypatch):
    """Uniform points of 25 features: hardly any ring is skipped. Blocks give the exact
    neighbours, and no query row is written once for every ring."""
    from panelkit.operators import knn_cells as kc
    r = np.random.default_rng(8)
    x = r.uniform(0, 1, (900, 25)).round(2)
    x[600:650] = x[:50]  # equal places
    group = r.integers(0, 3, 900)
    names = [f"_x{i}" for i in range(25)]
    rows = [(i, int(g), *map(float, v)) for i, (g, v) in enumerate(zip(group, x))]
    refs = spark.createDataFrame(rows, "_r long, _group long, " + ", ".join(f"{c} double" for c in names)).cache()
    queries = refs.where("_r % 3 = 0").withColumnRenamed("_r", "_q").cache()
    visits = []
    real = kc._meet
    monkeypatch.setattr(kc, "MOST_BLOCK", 120)
    monkeypatch.setattr(kc, "LEAST_BLOCK", 50)
    monkeypatch.setattr(kc, "_meet", lambda v, *a: visits.append(v.count()) or real(v, *a))
    got: dict = {}
    for f in kc.knn_cells_join(queries, refs, names, 4, [], True).orderBy("_q", "rank").collect():
        got.setdefault(f["_q"], []).append(f["_r"])
    for q in range(0, 900, 3):
        d = sum((x[q, f] - x[:, f]) ** 2 for f in range(25))
        assert got[q] == sorted(np.flatnonzero(group != group[q]).tolist(), key=lambda j: (d[j], j))[:4]
    assert sum(visits) <= kc.FIRST_CELLS * kc.RINGS * 300  # 30 cells have 240 rings
