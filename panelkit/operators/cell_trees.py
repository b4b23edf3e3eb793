"""Regression trees from sums by cell.

Trees over features cut into at most 32 bins (MLlib's maxBins) see a row only
through its bins: a split needs the count and the label sum of each bin. So
Spark groups the rows by their bins once (a cell is one combination of bins),
and all trees of a search grow from the cells' sums, whatever the number of
rows. What differs by tree is kept by row: a bootstrap draws rows, and a
boosting round draws its own share of the rows; the drawn rows are then summed
by cell. Squared errors need only a cell's count, sum and sum of squares.

It pays where the cells are few against the rows, or the trees are many
(`worth_cells`); wider designs stay with MLlib on the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MOST_BINS = 32  # bins a feature, as MLlib's default
MOST_CELLS = 1 << 15  # sums of all cells fit a task of one tree and a broadcast
FEW_ROWS = 100_000  # up to here MLlib on the rows is as fast for a few trees
MANY_TREES = 1000  # so many trees grow from cells whatever the rows
BLOCK = 1 << 20  # rows held at once
TILE = 1 << 15  # random numbers drawn at once
HELD_SUMS = 1 << 20  # sums held before they are sent
TREES_A_TASK = 10


def refuse_bad(rows: DataFrame, cols: list[str]) -> int:
    """The row count; a NULL or NaN feature or label is an error, never a dropped row."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} rows have a NULL or NaN feature or label")
    return r["n"]


class Cells:
    """Cuts of each feature; a value goes right of all cuts below it."""

    def __init__(self, features: list[str], cuts: list[list[float]]):
        self.features, self.cuts = features, cuts
        self.sizes = [len(c) + 1 for c in cuts]
        self.n = int(np.prod(self.sizes, dtype=float))

    def column(self) -> Column:
        """The cell's number, 0 .. n - 1."""
        out = F.lit(0)
        for f, cuts, size in zip(self.features, self.cuts, self.sizes):
            out = out * F.lit(size) + sum((F.when(F.col(f) > F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0))
        return out.cast("int")

    def bins(self) -> np.ndarray:
        """Each cell's bins, a row per cell."""
        return np.stack(np.unravel_index(np.arange(self.n), self.sizes), axis=1)


def fit_cells(rows: DataFrame, features: list[str]) -> Cells:
    """Up to 32 distinct values: cuts half way between neighbours. More: cuts at the
    quantiles of all rows."""
    steps = [k / MOST_BINS for k in range(1, MOST_BINS)]
    few = {f: sorted(float(x[0]) for x in rows.select(f).distinct().limit(MOST_BINS + 1).collect()) for f in features}
    many = [f for f in features if len(few[f]) > MOST_BINS]
    r = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), steps, 10_000).alias(f) for f in many]).first() if many else {}
    return Cells(features, [sorted(set(r[f])) if f in many else [(a + b) / 2 for a, b in zip(few[f], few[f][1:])] for f in features])


def worth_cells(rows: DataFrame, features: list[str], label: str, trees: int = 1) -> Cells | None:
    """The cells of a design whose rows outnumber them, or that grows many trees; None
    where trees should grow on the rows."""
    n = rows.count()
    if n == 0 or n <= FEW_ROWS and trees < MANY_TREES or len(features) > 15:
        return None
    refuse_bad(rows, [*features, label])
    cells = fit_cells(rows, features)
    return cells if cells.n <= (MOST_CELLS if trees >= MANY_TREES else min(MOST_CELLS, n)) else None


def cell_sums(rows: DataFrame, cells: Cells, label: str, by: str) -> dict:
    """{value of `by`: (counts, label sums, sums of squares), each by cell}."""
    y = F.col(label).cast("double")
    got = rows.groupBy(by, cells.column().alias("_cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")).toPandas()  # at most MOST_CELLS rows a value
    out = {}
    for value, t in got.groupby(by):
        out[value] = np.zeros((3, cells.n))
        out[value][:, t["_cell"].to_numpy()] = t[["n", "s", "q"]].to_numpy(float).T
    return out


def squared_error(sums: np.ndarray, prediction: np.ndarray) -> float:
    n, s, q = sums
    return float((q - 2 * prediction * s + n * prediction * prediction).sum())


def grow(bins: np.ndarray, sizes: list[int], n: np.ndarray, s: np.ndarray, depth: int, tried: int, rng, least: float = 1, gain: float = 0.0) -> np.ndarray:
    """A tree's predictions by cell when cut at depth 0, 1, .. `depth`.

    Level by level, every node takes the cut of largest variance reduction among
    `tried` random features, with `least` rows on each side and `gain` at least.
    """
    at, out = np.zeros(len(n), int), []
    value, live = np.array([s.sum() / max(n.sum(), 1)]), np.array([True])
    for level in range(depth + 1):
        out.append(value[at])
        if level == depth or not live.any():
            break
        m = len(value)
        all_n, all_s = np.bincount(at, n, m), np.bincount(at, s, m)
        chosen = rng.random((m, len(sizes))).argsort(axis=1).argsort(axis=1) < tried
        best, feature, cut = np.full(m, -np.inf), np.zeros(m, int), np.zeros(m, int)
        sides = np.zeros((m, 2))
        for f, size in enumerate(sizes):
            if size == 1:
                continue
            place = at * size + bins[:, f]
            ln, ls = (np.bincount(place, w, m * size).reshape(m, size).cumsum(axis=1)[:, :-1] for w in (n, s))
            rn, rs = all_n[:, None] - ln, all_s[:, None] - ls
            ok = (ln >= least) & (rn >= least) & chosen[:, f, None] & live[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                g = np.where(ok, (ls * ls / ln + rs * rs / rn - (all_s * all_s / all_n)[:, None]) / all_n[:, None], -np.inf)
            k = g.argmax(axis=1)
            i = np.arange(m)
            better = g[i, k] > best
            best[better], feature[better], cut[better] = g[i, k][better], f, k[better]
            with np.errstate(divide="ignore", invalid="ignore"):
                means = np.stack([ls[i, k] / ln[i, k], rs[i, k] / rn[i, k]], axis=1)
            sides[better] = means[better]
        split = live & (best > 0) & (best >= gain)
        first = np.cumsum(1 + split) - (1 + split)  # a split node's children lie side by side
        right = split[at] & (bins[np.arange(len(at)), feature[at]] > cut[at])
        at = first[at] + right
        value = np.repeat(value, 1 + split)
        value[first[split]], value[first[split] + 1] = sides[split].T
        live = np.repeat(split, 1 + split)
    while len(out) <= depth:
        out.append(out[-1])
    return np.stack(out)


def _blocks(batches):
    """(codes, labels) of up to about BLOCK rows."""
    held, size = [], 0
    for b in batches:
        held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)))
        size += b.num_rows
        if size >= BLOCK:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _by_code(batches):
    """(code, labels) of sorted rows; a frequent code comes in several parts, one after the other."""
    for code, y in _blocks(batches):
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(code)]):
            yield int(code[a]), y[a:b]


def _dealt(rows: DataFrame, code: Column, label: str) -> DataFrame:
    """(code, label) sorted in equal tasks of neighbouring codes, so that a code's sums come
    from one or two tasks; a frequent code spans as many as it fills."""
    parts = 3 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.select(code.alias("code"), F.col(label).cast("double").alias("y"), F.rand(7).alias("r")).repartitionByRange(
        parts, "code", "r").select("code", "y").sortWithinPartitions("code")


def _summed(batches, draw, most: int):
    """(codes, counts, sums) of up to `most` codes at once: `draw`(labels) gives a code's
    part's arrays of counts and sums, which are added up over its parts."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for code, y in _by_code(batches):
        n, s = draw(y)
        if code in held:
            held[code][0][...] += n
            held[code][1][...] += s
            continue
        if len(held) >= most:
            yield np.array([*held], np.int32), np.stack([n for n, _ in held.values()]), np.stack([s for _, s in held.values()])
            held = {}
        held[code] = n, s
    if held:
        yield np.array([*held], np.int32), np.stack([n for n, _ in held.values()]), np.stack([s for _, s in held.values()])


def _tiles(rows: int, times: int):
    """(first row, after the last, first time, after the last) of about TILE numbers."""
    for a in range(0, rows, TILE):
        b = min(a + TILE, rows)
        each = max(1, TILE // (b - a))
        for t in range(0, times, each):
            yield a, b, t, min(t + each, times)


def _uniform16(rng: np.random.Generator, n: int) -> np.ndarray:
    return rng.bit_generator.random_raw(-(-n // 4)).view(np.uint16)[:n]


def _steps16(rng: np.random.Generator, probabilities: np.ndarray) -> np.ndarray:
    """How many of the 65,536 numbers lie below each probability: rounded up or down at
    random, so that on average a number lies below it exactly as often as it should."""
    return np.minimum(np.floor(65536 * probabilities + rng.random()).astype(int), 65536)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def poisson_sums(y: np.ndarray, trees: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The number and the sum of each tree's draws: a bootstrap gives every row a Poisson(1) weight."""
    n, s = np.zeros(trees), np.zeros(trees)
    for a, b, t, end in _tiles(len(y), trees):
        u, w = _uniform16(rng, (end - t) * (b - a)), np.zeros((end - t) * (b - a), np.uint8)
        steps = _steps16(rng, _POISSON)
        for step in steps[steps < 65536].astype(np.uint16):
            w += u >= step
        w = w.reshape(end - t, b - a).astype(float)
        n[t:end] += w.sum(axis=1)
        s[t:end] += w @ y[a:b]
    return n, s


def bootstrap_sums(rows: DataFrame, cells: Cells, label: str, fold: Column, trees: int, seed: int) -> DataFrame:
    """(tree, code, n, s): each tree's bootstrap of the rows, summed by fold and cell
    (code = fold * cells + cell)."""
    def run(batches):
        rng = np.random.Generator(np.random.SFC64([seed, TaskContext.get().partitionId()]))
        for codes, n, s in _summed(batches, lambda y: poisson_sums(y, trees, rng), max(1, HELD_SUMS // trees)):
            i, tree = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(tree.astype(np.int32)), pa.array(codes[i]), pa.array(n[i, tree]), pa.array(s[i, tree])],
                                             ["tree", "code", "n", "s"])

    return _dealt(rows, fold * F.lit(cells.n) + cells.column(), label).mapInArrow(run, "tree int, code int, n double, s double")


def _slices(counts: list[int]) -> list[tuple[int, int]]:
    """Trees [a, b) of a task: TREES_A_TASK at most, none across a count."""
    out = []
    for a, b in zip([0, *counts], counts):
        out += [(i, min(i + TREES_A_TASK, b)) for i in range(a, b, TREES_A_TASK)]
    return out


def forest_sums(rows: DataFrame, cells: Cells, label: str, fold: Column, jobs: list[tuple[int, int]], counts: list[int],
                depths: list[int], seed: int) -> DataFrame:
    """(job, slice, total): for each job (features tried, left-out fold or -1) the sum of
    the slice's trees' predictions, by depth and cell."""
    slices, bins, sizes, width = _slices(counts), cells.bins(), cells.sizes, cells.n

    def run(t: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((len(jobs), len(depths), width))
        for tree, x in t.groupby("tree"):
            code = x["code"].to_numpy()
            folds = int(code.max()) // width + 1
            n, s = (np.bincount(code, x[c].to_numpy(), folds * width).reshape(folds, width) for c in ("n", "s"))
            for j, (tried, out) in enumerate(jobs):
                own_n, own_s = n.sum(axis=0), s.sum(axis=0)
                if 0 <= out < folds:
                    own_n, own_s = own_n - n[out], np.where(own_n > n[out], own_s - s[out], 0.0)
                total[j] += grow(bins, sizes, own_n, own_s, max(depths), tried, np.random.default_rng([seed, int(tree), tried]))[depths]
        return pd.DataFrame({"job": np.arange(len(jobs)), "slice": int(t["slice"].iloc[0]), "total": [x.tobytes() for x in total]})

    sums = bootstrap_sums(rows, cells, label, fold, counts[-1], seed)
    named = sums.join(F.broadcast(rows.sparkSession.createDataFrame([(t, k) for k, (a, b) in enumerate(slices) for t in range(a, b)],
                                                                    "tree int, slice int")), "tree")
    return named.repartition(len(slices), "slice").groupBy("slice").applyInPandas(run, "job int, slice int, total binary")


def subset_size(strategy: str, features: int) -> int:
    """Features tried at a node, by MLlib's names, or a share of them."""
    named = {"all": features, "auto": features, "onethird": -(-features // 3), "sqrt": int(np.ceil(np.sqrt(features))),
             "log2": max(1, int(np.ceil(np.log2(features))))}
    if strategy in named:
        return named[strategy]
    return min(features, int(strategy)) if strategy.isdigit() else max(1, int(np.ceil(float(strategy) * features)))


def forest_cv_errors(part: DataFrame, held: dict, cells: Cells, label: str, fold: str, folds: list[int], strategies: list[str],
                     counts: list[int], depths: list[int], seed: int) -> dict:
    """{(strategy, fold): {(trees, depth): held-out RMSE}}: forests on the rows of
    `part` outside each fold, scored on the sums `held` of all rows of the fold."""
    number = {f: i for i, f in enumerate(folds)}
    code = sum((F.when(F.col(fold) == F.lit(f), i).otherwise(0) for f, i in number.items()), F.lit(0))
    tried = {s: subset_size(s, len(cells.features)) for s in strategies}
    jobs = sorted({(t, i) for t in tried.values() for i in number.values()})
    slices, width = _slices(counts), cells.n
    shared = part.sparkSession.sparkContext.broadcast([held[f] for f in folds])  # three sums a cell and fold

    def score(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("slice")
        job, total, rows = int(t["job"].iloc[0]), np.zeros((len(depths), width)), []
        out = shared.value[jobs[job][1]]
        for k, x in zip(t["slice"], t["total"]):
            total += np.frombuffer(x).reshape(total.shape)
            if slices[k][1] in counts:
                rows += [(job, slices[k][1], d, (max(squared_error(out, p / slices[k][1]), 0) / out[0].sum()) ** 0.5) for d, p in zip(depths, total)]
        return pd.DataFrame(rows, columns=["job", "trees", "depth", "rmse"])

    sums = forest_sums(part, cells, label, code, jobs, counts, depths, seed)
    got = sums.repartition(len(jobs), "job").groupBy("job").applyInPandas(score, "job int, trees int, depth int, rmse double").collect()
    errors: dict = {}
    for r in got:  # settings x folds rows
        errors.setdefault(jobs[r["job"]], {})[r["trees"], r["depth"]] = r["rmse"]
    return {(s, f): errors[tried[s], i] for s in strategies for f, i in number.items()}


class CellModel:
    """A fitted model as its prediction for each cell."""

    def __init__(self, cells: Cells, prediction: np.ndarray):
        self.cells, self.prediction = cells, prediction

    def cell(self) -> Column:
        """A row's cell; a NULL or NaN feature is an error."""
        bad = F.lit(False)
        for f in self.cells.features:
            bad = bad | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
        return F.when(bad, F.raise_error(F.lit("NULL or NaN feature")).cast("int")).otherwise(self.cells.column())

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds `prediction`; a NULL or NaN feature is an error."""
        table = df.sparkSession.createDataFrame(pd.DataFrame({"_cell": np.arange(self.cells.n, dtype="int32"), "prediction": self.prediction}))
        return df.withColumn("_cell", self.cell()).join(F.broadcast(table), "_cell", "left").drop("_cell")


def _circle_blocks(batches):
    """One row per bucket or BLOCK rows of it: sorted (bucket, cell, label) rows become arrays."""
    def block(bucket, part, held):
        cell, y = (pa.concat_arrays([b.column(c) for b in held]) for c in (1, 2))
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([len(cell)], pa.int64()),
                                           *[pa.array([x.tobytes()], pa.binary()) for x in (cell.to_numpy(), y.to_numpy(zero_copy_only=False),
                                                                                            y.is_valid().to_numpy(zero_copy_only=False))]],
                                          ["bucket", "part", "n", "cell", "y", "known"])

    at, part, held, size = None, 0, [], 0
    for b in batches:
        bucket = b.column(0).to_numpy()
        ends = [*(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for first, end in zip([0, *ends], ends):
            if first == end:
                continue
            new = int(bucket[first]) != at
            if held and (new or size >= BLOCK):
                yield block(at, part, held)
                part, held, size = part + 1, [], 0
            if new:
                at, part = int(bucket[first]), 0
            held.append(b.slice(first, end - first))
            size += end - first
    if held:
        yield block(at, part, held)


def permuted_errors(model: CellModel, rows: DataFrame, label: str, order: list[Column], ahead: list[int]) -> dict:
    """{(feature, repeat): squared error} of the rows with one feature taken from the row
    `ahead`[repeat] places on in the circle of all rows by `order` (a bucket of rows
    first), and the plain one under ("", -1).

    A prediction depends on cells only, so the circle is kept as blocks of cells and
    labels, and a repeat sends each block's cells to the one or two blocks they go to.
    """
    spark, cells, prediction = rows.sparkSession, model.cells, model.prediction
    named = rows.select(F.coalesce(order[0], F.lit(-1)).cast("int").alias("bucket"), model.cell().alias("cell"), F.col(label).cast("double").alias("y"),
                        *[o.alias(f"_o{i}") for i, o in enumerate(order[1:])])
    named = named.repartition("bucket").sortWithinPartitions("bucket", *[f"_o{i}" for i in range(len(order) - 1)])
    blocks = cut_lineage(named.select("bucket", "cell", "y").mapInArrow(_circle_blocks, "bucket int, part int, n long, cell binary, y binary, known binary"))
    sizes = blocks.select("bucket", "part", "n").sort("bucket", "part").collect()  # a row per bucket or BLOCK rows
    starts = np.cumsum([0, *[r["n"] for r in sizes]])
    shared = spark.sparkContext.broadcast(({(r["bucket"], r["part"]): i for i, r in enumerate(sizes)}, starts))

    def send(batches):
        number, starts = shared.value
        total = int(starts[-1])
        for b in batches:
            for r in b.to_pylist():
                own = number[r["bucket"], r["part"]]
                yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([-1], pa.int32()), pa.array([0], pa.int64()),
                                                  *[pa.array([r[c]], pa.binary()) for c in ("cell", "y", "known")]], ["block", "repeat", "first", "cell", "y", "known"])
                for repeat, a in enumerate(ahead):
                    done, to = 0, (int(starts[own]) - a) % total
                    while done < r["n"]:
                        block = int(np.searchsorted(starts, to, side="right")) - 1
                        take = min(r["n"] - done, int(starts[block + 1]) - to)
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([repeat], pa.int32()), pa.array([to - int(starts[block])], pa.int64()),
                                                          pa.array([r["cell"][4 * done:4 * (done + take)]], pa.binary()), *[pa.array([None], pa.binary())] * 2],
                                                         ["block", "repeat", "first", "cell", "y", "known"])
                        done, to = done + take, (to + take) % total

    strides = np.cumprod([1, *cells.sizes[:0:-1]])[::-1].tolist()

    def score(t: pa.Table) -> pa.Table:
        got = t.to_pylist()
        own = next(r for r in got if r["repeat"] < 0)
        cell, y, known = np.frombuffer(own["cell"], np.int32), np.frombuffer(own["y"]), np.frombuffer(own["known"], bool)
        taken = np.zeros((len(ahead), len(cell)), np.int32)
        for r in got:
            if r["repeat"] >= 0:
                part = np.frombuffer(r["cell"], np.int32)
                taken[r["repeat"], r["first"]:r["first"] + len(part)] = part
        out = [("", -1, float(((y - prediction[cell])[known] ** 2).sum()))]
        for f, size, stride in zip(cells.features, cells.sizes, strides):
            rest = cell - cell // stride % size * stride
            out += [(f, k, float(((y - prediction[rest + taken[k] // stride % size * stride])[known] ** 2).sum())) for k in range(len(ahead))]
        return pa.table(dict(zip(("feature", "repeat", "sse"), map(pa.array, zip(*out)))), schema=pa.schema([("feature", pa.string()), ("repeat", pa.int32()), ("sse", pa.float64())]))

    sent = blocks.mapInArrow(send, "block int, repeat int, first long, cell binary, y binary, known binary")
    errors = sent.groupBy("block").applyInArrow(score, "feature string, repeat int, sse double").groupBy("feature", "repeat").agg(F.sum("sse").alias("sse"))
    return {(r["feature"], r["repeat"]): r["sse"] for r in errors.collect()}  # features x repeats + 1 rows


def forest_model(rows: DataFrame, cells: Cells, label: str, trees: int, depth: int, strategy: str, seed: int) -> CellModel:
    sums = forest_sums(rows, cells, label, F.lit(0), [(subset_size(strategy, len(cells.features)), -1)], [trees], [depth], seed)
    total = sum(np.frombuffer(r["total"]) for r in sums.select("total").toLocalIterator())  # a number a cell from each slice
    return CellModel(cells, total / trees)


def share_sums(y: np.ndarray, rates: np.ndarray, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """By round and rate (rising) the number and the sum of the rows drawn. A row has one
    uniform number a round, and is in the round of every rate above it."""
    width = len(rates) + 1
    n, s = np.zeros((rounds, width)), np.zeros((rounds, width))
    names = np.arange(width, dtype=np.uint8 if width <= 256 else np.uint16)
    for a, b, k, end in _tiles(len(y), rounds):
        rank = np.repeat(names, np.diff(_steps16(rng, rates), prepend=0, append=65536))  # the lowest rate above each number
        place = rank[_uniform16(rng, (end - k) * (b - a))].reshape(end - k, b - a) + width * np.arange(end - k)[:, None]
        size = (end - k) * width
        n[k:end] += np.bincount(place.ravel(), minlength=size).reshape(-1, width)
        s[k:end] += np.bincount(place.ravel(), np.tile(y[a:b], end - k), size).reshape(-1, width)
    return n[:, :-1].cumsum(axis=1), s[:, :-1].cumsum(axis=1)


class Boosting:
    """Boosted trials that go on from where they are. As in MLlib: the first tree fits the
    label and counts whole, the others fit twice the residual and count stepSize."""

    def __init__(self, rows: DataFrame, cells: Cells, label: str, role: str, trials: list[dict], seed: int):
        held = cell_sums(rows.where(F.col(role) != "fit"), cells, label, role)
        nothing = np.zeros((3, cells.n))
        self.cells, self.trials, self.seed = cells, trials, seed
        self.now: dict[int, np.ndarray] = {}  # a live trial's prediction by cell
        self.held = [held.get("stop", nothing), held.get("score", nothing)]
        self.dealt = _dealt(rows.where(F.col(role) == "fit"), cells.column(), label).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> Boosting:
        return self

    def __exit__(self, *exc):
        self.dealt.unpersist()

    def _sums(self, live: list[int], first: int, last: int) -> DataFrame:
        """(trial, codes, n, s): the rows a trial draws in its rounds from `first`, summed by round and cell."""
        rates = np.array([self.trials[i].get("subsamplingRate", 1.0) for i in live])
        own = [min(last, self.trials[i]["maxIter"]) - first for i in live]
        order, seed, rounds = np.argsort(rates, kind="stable"), self.seed, max(own)

        def run(batches):
            rng = np.random.Generator(np.random.SFC64([seed, TaskContext.get().partitionId(), first]))
            for codes, n, s in _summed(batches, lambda y: share_sums(y, rates[order], rounds, rng), max(1, HELD_SUMS // (rounds * len(live)))):
                out = [[live[j], codes.tobytes(), n[:, :own[j], k].T.astype(np.int32).tobytes(), s[:, :own[j], k].T.tobytes()] for k, j in enumerate(order)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 3))], ["trial", "codes", "n", "s"])

        return self.dealt.mapInArrow(run, "trial int, codes binary, n binary, s binary")

    def advance(self, live: list[int], first: int, last: int) -> dict[int, tuple[list[float], list[float]]]:
        """Boosts each live trial from round `first` to `last` or its own maxIter: its mean
        squared errors on the stop and on the score rows after each of these rounds."""
        live = [i for i in live if self.trials[i]["maxIter"] > first]
        if not live or last <= first:
            return {}
        sc = self.dealt.sparkSession.sparkContext
        bins, sizes, width, trials, seed = self.cells.bins(), self.cells.sizes, self.cells.n, self.trials, self.seed
        shared = sc.broadcast((self.held, {i: self.now[i] for i in live if i in self.now}))  # a number a cell and trial

        def run(t: pd.DataFrame) -> pd.DataFrame:
            i = int(t["trial"].iloc[0])
            p, (held, before) = trials[i], shared.value
            rounds, now, curves = min(last, p["maxIter"]) - first, before.get(i, np.zeros(width)), []
            n, s = np.zeros((rounds, width)), np.zeros((rounds, width))
            for codes, a, b in zip(t["codes"], t["n"], t["s"]):
                codes = np.frombuffer(codes, np.int32)
                n[:, codes] += np.frombuffer(a, np.int32).reshape(rounds, -1)
                s[:, codes] += np.frombuffer(b).reshape(rounds, -1)
            rng = np.random.default_rng([seed, i, first])
            for k in range(rounds):
                y = 2 * (s[k] - n[k] * now) if first + k else s[k]
                tree = grow(bins, sizes, n[k], y, p["maxDepth"], subset_size(p.get("featureSubsetStrategy", "all"), len(sizes)), rng,
                            p.get("minInstancesPerNode", 1), p.get("minInfoGain", 0.0))[-1]
                now = now + (p.get("stepSize", 0.1) if first + k else 1.0) * tree
                curves.append([squared_error(h, now) / max(h[0].sum(), 1) for h in held])
            stop, score = zip(*curves)
            return pd.DataFrame({"trial": [i], "stop": [list(stop)], "score": [list(score)], "now": [now.tobytes()]})

        sums = self._sums(live, first, last)
        got = sums.repartition(len(live), "trial").groupBy("trial").applyInPandas(
            run, "trial int, stop array<double>, score array<double>, now binary").collect()  # a row a trial, with a number a cell
        self.now = {r["trial"]: np.frombuffer(r["now"]) for r in got}
        return {r["trial"]: (r["stop"], r["score"]) for r in got}
