"""Vector codes, periodic runs and lattice dedup against brute force, with NULLs,
empty and long rows, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import lattice_dedup, periodic_runs, queries, vector_codes
from panelkit.llm.common import connected_components, materialise

rng = random.Random(11)
g = np.random.default_rng(11)
NAN, INF = float("nan"), float("inf")


# ---- periodic runs


def brute_runs(w, shortest=6, exponent=4):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(shortest, exponent * q):
                part = w[i:i + n]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, n, q))
            i = max(i + 1, j)
    return sorted(found, key=lambda r: (r[0], r[2]))


def some_words(n, kinds):
    return [b"w%d" % rng.randrange(kinds) for _ in range(n)]


def test_runs_equal_brute_force():
    for k in range(2500):
        w = some_words(rng.randrange(70), rng.choice([1, 2, 3, 5]))
        if k % 3 == 0 and w:
            a = rng.randrange(len(w))
            p = 1 + (len(w) - a) // rng.randrange(3, 11)
            w = w[:a] + [w[a + i % p] for i in range(len(w) - a)]
        assert periodic_runs.find_runs(w) == brute_runs(w)
        assert periodic_runs.find_runs(w, 4, 2) == brute_runs(w, 4, 2)


def test_suffix_array_and_prefixes():
    for _ in range(200):
        ids = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
        order = periodic_runs.suffix_array(np.array(ids)).tolist()
        assert order == sorted(range(len(ids)), key=lambda i: ids[i:])
        lcp = periodic_runs.common_prefixes(ids, order)
        for r in range(1, len(ids)):
            x, y = ids[order[r - 1]:], ids[order[r]:]
            assert lcp[r] == next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_very_long_runs():
    assert periodic_runs.find_runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    base = some_words(20_000, 5000)
    assert periodic_runs.find_runs(base * 5) == [(0, 100_000, 20_000)]


def contract_runs(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            v = h // 10
            a = v % n
            p = 1 + (n - a) // (3 + v % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


def test_runs_query_by_contract(spark, tmp_path):
    texts = [None, "", " \t\x0b", "one", "a " * 6, "a " * 5, "é é é  é é é é é", "x y " * 4 + "z " + "x y " * 4,
             "word " * 3000, " ".join(f"w{k}" for k in range(500))]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(150)]
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "b " * 9, "x", 1, 2), (8, "word " * 3000, "x", 1, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, collapsed string, start int, runs int").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    want = Counter((i, *contract_runs(i, t)) for i, t, *_ in rows)
    assert sum(r.n_runs > 0 for r in got) > 50
    assert Counter(tuple(r) for r in got) == want


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    size = len(rows[0][1])
    points = [[int(x * 1024 // 1) for x in v] for _, v, _ in rows]
    cuts = [(size * p // parts, size * (p + 1) // parts) for p in range(parts)]
    books = [[q[a:b] for q in points[:entries]] for a, b in cuts]

    def nearest(q, book):
        return min((sum((x - y) ** 2 for x, y in zip(q, c)), j) for j, c in enumerate(book))

    for k in range(rounds + 1):
        best = [[nearest(q[a:b], books[p]) for p, (a, b) in enumerate(cuts)] for q in points]
        if k == rounds:
            break
        for p, (a, b) in enumerate(cuts):
            own = {}
            for q, m in zip(points, best):
                own.setdefault(m[p][1], []).append(q[a:b])
            for j, qs in own.items():
                books[p][j] = [sum(x) // len(qs) for x in zip(*qs)]
    text = ",".join(str(x) for b in books for c in b for x in c)
    return best, hashlib.sha256(text.encode()).hexdigest()


def check_codes(spark, rows, bad=(), schema="vec_id long, embedding array<double>, label int, code string, n int"):
    df = spark.createDataFrame([(*r, "c", 1) for r in [*rows, *bad]], schema).repartition(3)
    got = vector_codes.vector_codes(df).collect()
    best, digest = brute_codes(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])))
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    by_label = Counter()
    for r, m in zip(ordered, best):
        by_label[r[2]] += sum(d for d, _ in m)
    want = Counter((r[0], "".join("%02x" % j for _, j in m), sum(d for d, _ in m), by_label[r[2]], digest) for r, m in zip(ordered, best))
    assert Counter(tuple(r) for r in got) == want


def test_codes_equal_brute_force(spark):
    centres = g.normal(size=(9, 16))
    rows = [(int(i), [float(x) for x in np.round(centres[i % 9] + g.normal(size=16) * 0.1, 3)], int(i) % 3 if i % 5 else None) for i in g.permutation(400)]
    rows += [(500, rows[0][1], 1), (500, rows[0][1], 1), (None, rows[3][1], None)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [None] + [0.0] * 15, 1), (-4, [NAN] + [0.0] * 15, 2), (-5, [INF] * 16, 2)]
    check_codes(spark, rows, bad)


def test_codes_of_few_rows_ties_and_odd_lengths(spark):
    check_codes(spark, [(3, [0.5] * 6, 1), (1, [-0.001, 0.25, 1.0, -2.0, 0.0, -0.0], 1), (2, [0.5] * 6, None)], bad=[(9, [1.0] * 7, 1)])


def test_codes_of_huge_components(spark):
    rows = [(i, [float(x) for x in g.normal(size=8) * 10.0 ** int(i % 3 * 6)], 0) for i in range(40)]
    check_codes(spark, rows)
    far = [(i, [1e200 * (i + 1)] * 4, 0) for i in range(300)]
    got = vector_codes.vector_codes(spark.createDataFrame(far, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == 300 and [r.error for r in got if r.vec_id == 0] == [0]
    assert any(r.error is None for r in got)


def test_codes_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(none).count() == 0
    assert vector_codes.vector_codes(none.sparkSession.createDataFrame([(1, None, 2)], none.schema)).count() == 0


def test_dual_tree_settles_whole_nodes():
    centres = g.integers(-2000, 2000, size=(32, 8))
    points = centres[g.integers(32, size=4000)] + g.integers(-20, 20, size=(4000, 8))
    tree, book = vector_codes.Tree(points, 32), centres.copy()
    choice = np.empty(len(points), np.int64)
    sums, counts, seen = vector_codes.assign(tree, book, vector_codes.entry_tree(book), choice)
    want = vector_codes.squared(points, book).argmin(axis=1)
    assert (choice == want[tree.order]).all() and (counts == np.bincount(want, minlength=32)).all()
    assert all((sums[j] == points[want == j].sum(axis=0)).all() for j in range(32))
    assert seen["whole"] > 2000 and seen["distances"] < 0.2 * points.shape[0] * 32


# ---- lattice dedup


def test_e8_decoding_is_the_nearest_point():
    x = g.normal(size=(300, 8)) * 3
    near = lattice_dedup.decode_e8(x)
    doubled = np.rint(2 * near)
    assert (doubled == 2 * near).all() and (np.abs(doubled % 2 - doubled[:, :1] % 2) == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    away = ((x - near) ** 2).sum(axis=1)
    others = ((x[:, None, :] - near[:, None, :] - lattice_dedup.NEIGHBOURS[None]) ** 2).sum(axis=2)
    assert (away <= others.min(axis=1) + 1e-9).all() and away.max() <= 1 + 1e-9


def unit_rows(n, d=64):
    x = g.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def at_cosine(x, c):
    y = unit_rows(len(x), x.shape[1])
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return c * x + np.sqrt(1 - c * c) * y


@pytest.mark.parametrize("cosine,least", [(0.9, 0.93), (0.93, 0.98), (0.96, 0.999)])
def test_meeting_probability(cosine, least):
    x = unit_rows(2000)
    y = at_cosine(x, cosine)
    met = np.zeros(len(x), bool)
    for t in range(lattice_dedup.TABLES):
        met |= (lattice_dedup.cells(x, t)[:, :, None] == lattice_dedup.cells(y, t)[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= least


def brute_links(rows, least=0.9):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    degree = Counter()
    for size in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == size]
        x = np.array([rows[k][1] for k in own], float)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(x @ x.T >= least)):
            if a < b:
                degree[own[a]] += 1
                degree[own[b]] += 1
                parent[root(own[b])] = root(own[a])
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[root(k)] = min(least_id.get(root(k), i), i)
    return Counter((i, degree[k], least_id.get(root(k)), i == least_id.get(root(k))) for k, (i, _) in enumerate(rows))


def links_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, node int, ball string").repartition(3)
    return Counter(tuple(r) for r in lattice_dedup.lattice_dedup(df, **options).collect())


def test_links_equal_brute_force(spark):
    base = unit_rows(60)
    tight = base[0] + g.normal(size=(150, 64)) * 0.004
    wide = np.concatenate([at_cosine(np.repeat(base[k:k + 1], 12, axis=0), 0.985) for k in range(1, 6)])
    chain = [base[7]]
    for _ in range(6):
        chain.append(at_cosine(chain[-1][None], 0.975)[0])
    vectors = [*base, *tight, *wide, *chain, *(3.5 * base[:4]), base[9], base[9], *(base[10] + g.normal(size=(40, 64)) * 0.02)]
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(g.permutation(len(vectors)), vectors)]
    rows += [(rows[3][0], rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (7000, None), (7001, []), (7002, [0.0] * 64), (7003, [NAN] + [1.0] * 63),
             (7004, [None] + [1.0] * 63), (7005, [INF] + [1.0] * 63), (None, None), (7006, [1.0, 2.0]), (7007, [2.0, 4.0]), (7008, [1e-200] * 2)]
    want = brute_links(rows)
    assert max(n for _, n, _, _ in want) >= 150
    assert links_of(spark, rows) == want


def test_recall_of_borderline_links(spark):
    """Pairs between 0.9 and 0.93 only: each vector has one partner."""
    x = unit_rows(800)
    y = np.concatenate([at_cosine(x[k:k + 1], c) for k, c in enumerate(np.linspace(0.9001, 0.93, len(x)))])
    rows = [(i, [float(t) for t in v]) for i, v in enumerate(np.concatenate([x, y]))]
    got = links_of(spark, rows)
    assert not got - brute_links(rows) - Counter((i, 0, i, True) for i in range(2 * len(x)))  # nothing wrong, only missing
    assert sum(n for _, n, _, _ in got) >= 0.93 * 2 * len(x)


def test_links_of_many_tiles_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(lattice_dedup, "TILE", 8)
    monkeypatch.setattr(lattice_dedup, "HOT_CELL", 4)
    base = unit_rows(3)
    vectors = np.concatenate([base[k] + g.normal(size=(60, 64)) * s for k, s in enumerate((0.01, 0.02, 0.022))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert links_of(spark, rows) == brute_links(rows)


def test_links_of_an_empty_table(spark):
    assert lattice_dedup.lattice_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_over_many_parts(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(int(a), int(b)) for a, b in g.integers(1000, 1400, size=(150, 2))] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    df = materialise(spark.createDataFrame(edges, "u long, v long").repartition(7), "edges")
    for part in (1 << 20, 60):
        got = {r.node: r.label for r in connected_components(df, "t", part).collect()}
        assert got == {x: root(x) for x in list(parent)}
