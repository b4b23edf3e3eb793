"""Embedding near-dedup with E8 lattice hashing.

Filing: each of `TABLES` tables projects a unit vector on two random sets of
eight orthonormal directions and decodes both images to points of the E8
lattice. The vector is filed under its own pair of points and under the next
cheapest neighbouring pairs (`PROBES` cells in all, moving to any of the 240
neighbours of either point). Two vectors meet when they share a cell of any
table. Measured on 4,000 random pairs, vectors with cosine 0.90 / 0.92 / 0.95 /
0.98 meet with probability 0.96 / 0.988 / 1.0 / 1.0; every link reported is
verified by its cosine in double precision. Pairs that meet are read only if
the signs of 64 random projections differ in few bits (a pair at cosine 0.9
fails that with probability below 1e-4).

Groups of near copies are never expanded into pairs. Equal vectors are one
node. Nodes that meet a leader of their cell (the node of least hash) within
half the linking angle form a ball around it, so all its members are linked
with each other. Balls that meet are compared through their centres: the
triangle inequality says that all members link, or none, or that it is
undecided; then the members are compared tile by tile, and only counts per
member leave the task. Cells with many balls are salted. Link counts and
components come from balls, so rows grow with the vectors and the balls that
meet, not with the square of a group.

Defined cases: a vector that is NULL, empty, zero, or holds NULL or non-finite
components links with nothing (n_links 0, its own component); vectors of
different lengths never link; a component's id is its smallest non-NULL
vec_id, NULL if it has none; kept compares vec_id and component_id with NULLs
equal; repeated rows are linked rows of their own; an empty table gives an
empty table; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_small, col, connected_components, materialise

TABLES = 6
PROBES = 4
BLOCKS = 2
WIDTH = 2.08  # of a lattice cell, in units of 1 / sqrt(dimension)
NEAREST = 8  # lattice neighbours kept per block before the cheapest pairs are chosen
SKETCH = 64
HOT_CELL = 4096
TILE = 128
TILE_PAIRS = 64  # pairs of tiles in an Arrow batch
SLACK = 1e-9  # radians: bounds decide only beyond rounding errors


def _neighbours() -> np.ndarray:
    """Zero and the 240 shortest vectors of E8."""
    out = [np.zeros(8)]
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


NEIGHBOURS = _neighbours()


def decode_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    rest = x - near
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(rest[odd]).argmax(axis=1)
    near[odd, worst] += np.where(rest[odd, worst] >= 0, 1, -1)
    return near


def decode_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: the nearer of the two cosets of D8."""
    whole, half = decode_d8(x), decode_d8(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


@lru_cache(maxsize=64)
def directions(dim: int, table: int, blocks: int) -> list[np.ndarray]:
    """Random directions of a table, orthonormal if the dimension allows."""
    g = np.random.default_rng([dim, table, 8])
    m = g.normal(size=(dim, 8 * blocks))
    m = np.linalg.qr(m)[0] if dim >= 8 * blocks else m / np.sqrt(dim)
    return np.split(m, blocks, axis=1)


@lru_cache(maxsize=8)
def sketch_directions(dim: int) -> np.ndarray:
    g = np.random.default_rng([dim, 1 << 20])
    return np.concatenate([np.linalg.qr(g.normal(size=(max(dim, 1), max(dim, 1))))[0] for _ in range(-(-SKETCH // dim))], axis=1)[:, :SKETCH]


@lru_cache(maxsize=64)
def multipliers(table: int, blocks: int) -> np.ndarray:
    return np.random.default_rng([table, 3]).integers(1, 1 << 62, size=8 * blocks, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def cells(x: np.ndarray, table: int, blocks: int = BLOCKS, probes: int = PROBES, width: float = WIDTH) -> np.ndarray:
    """(rows, probes) 64-bit cell keys, the own cell first, then by rising cost."""
    dim, costs, points = x.shape[1], [], []
    for q in directions(dim, table, blocks):
        image = x @ q * (np.sqrt(dim) / width)
        centre = decode_e8(image)
        cost = 2 - 2 * (image - centre) @ NEIGHBOURS.T  # squared distance added by moving to a neighbour
        cost[:, 0] = 0
        near = np.argpartition(cost, NEAREST, axis=1)[:, :NEAREST]
        cost = np.take_along_axis(cost, near, 1)
        order = np.argsort(cost, axis=1, kind="stable")
        costs.append(np.take_along_axis(cost, order, 1))
        points.append(centre[:, None, :] + NEIGHBOURS[np.take_along_axis(near, order, 1)])
    total, places = costs[0], [np.arange(NEAREST)]
    for c in costs[1:]:
        total = (total[:, :, None] + c[:, None, :]).reshape(len(x), -1)
        places = [np.repeat(p, NEAREST) for p in places] + [np.tile(np.arange(NEAREST), len(places[0]))]
    best = np.argsort(total, axis=1, kind="stable")[:, :probes]
    key = np.full((len(x), probes), np.uint64(table * 0x9E3779B97F4A7C15 + dim & (1 << 64) - 1))
    for b, (point, place) in enumerate(zip(points, places)):
        coords = np.rint(2 * np.take_along_axis(point, place[best][:, :, None], 1)).astype(np.int64).view(np.uint64)
        h = (coords * multipliers(table, blocks)[8 * b:8 * b + 8]).sum(axis=2, dtype=np.uint64)
        key = (key ^ h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return key ^ (key >> np.uint64(32))


def unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def by_length(b: pa.RecordBatch, *vectors: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts in which each vector column has one length."""
    sizes = np.stack([np.diff(b.column(v).offsets.to_numpy()) for v in vectors], axis=1)
    for s in np.unique(sizes, axis=0):
        yield b.filter(pa.array((sizes == s).all(axis=1)))


def _file(tables: int, probes: int, blocks: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in by_length(whole, "v"):
                x = unit(matrix(b.column("v")))
                keys = np.concatenate([cells(x, t, blocks, probes, width) for t in range(tables)], axis=1)
                sketch = np.packbits(x @ sketch_directions(x.shape[1]) > 0, axis=1).view("<i8")[:, 0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables * probes, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column("node"), lists, pa.array(sketch)], ["node", "keys", "sketch"])

    return run


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, va, vb) -> (a, b, angle) for vectors of one length."""
    for whole in batches:
        for b in by_length(whole, "va", "vb"):
            x, y = matrix(b.column("va")), matrix(b.column("vb"))
            if x.shape[1] == y.shape[1]:
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((unit(x) * unit(y)).sum(axis=1))], ["a", "b", "cosine"])


def _tiles(least: float):
    """Tile pairs -> per member of either side the copies it links with, and one
    row per pair of balls with a link (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            out: list[tuple[int, int, int]] = []
            for a, b, na, nb, ca, cb, xa, xb in zip(*(whole.column(c) for c in ("a", "b", "nodes_a", "nodes_b", "copies_a", "copies_b", "va", "vb"))):
                x = unit(np.array(xa.values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(na), -1))
                y = unit(np.array(xb.values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(nb), -1))
                link = x @ y.T >= least
                if link.any():
                    out.append((1, a.as_py(), b.as_py()))
                    for nodes, counts in ((na, link @ cb.values.to_numpy()), (nb, link.T @ ca.values.to_numpy())):
                        out += [(0, n, int(c)) for n, c in zip(nodes.as_py(), counts) if c]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["kind", "x", "y"])

    return run


def sketch_bits(radians: Column | float) -> Column:
    """Differing sign bits allowed at an angle: the mean and five deviations."""
    p = F.least(F.lit(radians) / np.pi if isinstance(radians, float) else radians / np.pi, F.lit(1.0))
    return SKETCH * p + 5 * F.sqrt(SKETCH * p * (1 - p))


def lattice_dedup(vectors: DataFrame, cosine: float = 0.9, tables: int = TABLES, probes: int = PROBES, blocks: int = BLOCKS,
                  width: float = WIDTH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row."""
    limit = float(np.arccos(cosine))
    v = col(vector_col)
    infinite = F.lit(float("inf"))
    t = vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    # exists() is NULL for a NULL vector, and so is the test
    good = F.coalesce((F.size("v") > 0) & F.exists("v", lambda x: x != 0)
                      & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite)), F.lit(False))
    # two seeded 64-bit hashes name a vector
    rows = t.select("vec_id", "v", good.alias("good"), F.xxhash64(F.lit(1), "v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    nodes = materialise(rows.where("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
                        .select(F.monotonically_increasing_id().alias("node"), "*"), "lattice-nodes")
    filed = materialise(nodes.select("node", "v").mapInArrow(_file(tables, probes, blocks, width), "node long, keys array<long>, sketch long"), "lattice-cells")
    balls = _balls(nodes, filed, tables, probes, limit / 2 - SLACK)
    pairs = _meeting_balls(filed, balls, limit)
    every, links = _links(nodes, balls, pairs, limit, cosine)
    size = balls.groupBy("ball").agg(F.sum("copies").alias("weight"), F.min("least").alias("least"))
    labels = connected_components(every.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        links.where("kind = 1").select(F.col("x").alias("u"), F.col("y").alias("v"))), "lattice")
    named = materialise(size.join(labels, F.col("ball") == F.col("node"), "left").select("ball", "weight", "least", F.coalesce("label", "ball").alias("label")), "lattice-labels")
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    weights = named.select("ball", "weight")
    more = (every.select(F.col("a").alias("ball"), F.col("b").alias("other")).union(every.select("b", "a"))
            .join(weights.withColumnRenamed("ball", "other"), "other").groupBy("ball").agg(F.sum("weight").alias("more")))
    ball_facts = named.join(component, "label").join(more, "ball", "left").select(
        "ball", "component_id", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("near"))
    single = links.where("kind = 0").groupBy(F.col("x").alias("node")).agg(F.sum("y").alias("single"))
    facts = materialise(balls.select("node", "ball").join(ball_facts, "ball").join(single, "node", "left").join(nodes.select("node", "h1", "h2"), "node")
                        .select("h1", "h2", "component_id", (F.col("near") + F.coalesce("single", F.lit(0)) - 1).alias("n_links")), "lattice-facts")
    linked = rows.where("good").select("vec_id", "h1", "h2").join(facts, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _balls(nodes: DataFrame, filed: DataFrame, tables: int, probes: int, radius: float) -> DataFrame:
    """(node, ball, angle, copies, least): each node with the centre of its ball.

    The leaders of a node's own cells are tried; of those within the radius the
    one of least hash becomes its centre. A centre need not be a member of its
    own ball. A node without a leader, or alone with one, is its own centre.
    """
    own = filed.select("node", "sketch", F.explode(F.array(*[F.get("keys", F.lit(t * probes)) for t in range(tables)])).alias("key"))
    leaders = own.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node", "sketch")).alias("lead")).where("n > 1")
    close = F.bit_count(F.col("sketch").bitwiseXOR(F.col("lead.sketch"))) <= sketch_bits(radius)
    tried = own.join(leaders, "key").where(close & (F.col("node") != F.col("lead.node"))).select(
        F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct()
    near = _with_vectors(tried, nodes).mapInArrow(_angles, "a long, b long, cosine double").where(F.col("cosine") >= float(np.cos(radius)))
    chosen = near.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("ball"), "cosine")).alias("pick"))
    first = materialise(nodes.select("node", "copies", "least").join(chosen, "node", "left").select(
        "node", "copies", "least", F.coalesce("pick.ball", "node").alias("ball"), F.coalesce(F.acos(F.least("pick.cosine", F.lit(1.0))), F.lit(0.0)).alias("angle")), "lattice-first")
    lonely = first.groupBy("ball").agg(F.count("*").alias("members"))
    single = F.col("members") == 1
    return materialise(first.join(lonely, "ball").select("node", F.when(single, F.col("node")).otherwise(F.col("ball")).alias("ball"),
                                                         F.when(single, 0.0).otherwise(F.col("angle")).alias("angle"), "copies", "least"), "lattice-balls")


def _with_vectors(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds va and vb, the vectors of the nodes a and b."""
    return (pairs.join(nodes.select(F.col("node").alias("a"), F.col("v").alias("va")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("v").alias("vb")), "b").select(*pairs.columns, "va", "vb"))


def _meeting_balls(filed: DataFrame, balls: DataFrame, limit: float) -> DataFrame:
    """(a, b), a < b: centres of balls of which two members share a cell.

    Members of one ball that share a cell are one row there. Where a ball has
    one member on either side, the sign sketches must agree.
    """
    sizes = balls.groupBy("ball").agg(F.count("*").alias("members"))
    named = materialise(filed.join(balls.select("node", "ball").join(sizes, "ball"), "node").select("ball", "members", "keys", "sketch"), "lattice-named")
    single = F.col("members") == 1
    rows = named.where(single).select("ball", F.explode("keys").alias("key"), "sketch").unionByName(
        named.where(~single).select("ball", F.explode("keys").alias("key")).distinct().withColumn("sketch", F.lit(None).cast("long")))
    hot = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_CELL).select(
        "key", F.ceil(F.col("n") / HOT_CELL).cast("int").alias("salts")), "lattice-hot")
    agree = F.coalesce(F.bit_count(F.col("s").bitwiseXOR(F.col("r"))) <= sketch_bits(limit), F.lit(True))

    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(right, on).where((F.col("a") < F.col("b")) & agree).select("a", "b")

    left = rows.select("key", F.col("ball").alias("a"), F.col("sketch").alias("s"))
    right = rows.select("key", F.col("ball").alias("b"), F.col("sketch").alias("r"))
    n_hot = hot.count()
    if not n_hot:
        return materialise(meet(left, right, ["key"]).distinct(), "lattice-pairs")
    small = checked_small(hot, n_hot) if n_hot <= 1 << 20 else hot
    cold = meet(left.join(small, "key", "left_anti"), right.join(small, "key", "left_anti"), ["key"])
    salted = left.join(small, "key").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).drop("salts")
    spread = right.join(small, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return materialise(cold.union(meet(salted, spread, ["key", "salt"])).distinct(), "lattice-pairs")


def _links(nodes: DataFrame, balls: DataFrame, pairs: DataFrame, limit: float, cosine: float) -> tuple[DataFrame, DataFrame]:
    """((a, b) balls all of whose members link, rows of `_tiles` for the undecided ones)."""
    sizes = balls.groupBy("ball").agg(F.max("angle").alias("reach"))
    faced = _with_vectors(pairs, nodes).mapInArrow(_angles, "a long, b long, cosine double")
    faced = (faced.join(sizes.select(F.col("ball").alias("a"), F.col("reach").alias("ra")), "a")
             .join(sizes.select(F.col("ball").alias("b"), F.col("reach").alias("rb")), "b"))
    apart, reach = F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0))), F.col("ra") + F.col("rb")
    every = F.when(reach == 0, F.col("cosine") >= cosine).otherwise(apart + reach <= limit - SLACK)
    faced = materialise(faced.select("a", "b", every.alias("every"), ((reach > 0) & (apart - reach <= limit + SLACK)).alias("some"))
                        .where("every or some"), "lattice-faced")
    part = faced.where("not every").select("a", "b")
    wanted = part.select(F.col("a").alias("ball")).union(part.select("b")).distinct()
    chunks = F.ceil(F.col("members") / TILE)
    counted = balls.groupBy("ball").agg(F.count("*").alias("members"))
    members = (balls.join(wanted, "ball").join(counted, "ball").join(nodes.select("node", "v"), "node")
               .select("ball", F.pmod(F.xxhash64("node"), chunks).alias("tile"), F.struct("node", "copies", "v").alias("m")))
    tiles = materialise(members.groupBy("ball", "tile").agg(F.collect_list("m").alias("m")).select(
        "ball", F.col("m.node").alias("nodes"), F.col("m.copies").alias("copies"), F.col("m.v").alias("v")), "lattice-tiles")

    def side(x: str) -> DataFrame:
        return tiles.select(F.col("ball").alias(x), F.col("nodes").alias(f"nodes_{x}"), F.col("copies").alias(f"copies_{x}"), F.col("v").alias(f"v{x}"))

    links = part.join(side("a"), "a").join(side("b"), "b").mapInArrow(_tiles(cosine), "kind long, x long, y long")
    # a row holds two tiles; the links are written here, with few of them in a batch
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = nodes.sparkSession.conf.get(batch)
    nodes.sparkSession.conf.set(batch, TILE_PAIRS)
    try:
        links = materialise(links, "lattice-links")
    finally:
        nodes.sparkSession.conf.set(batch, old)
    return faced.where("every").select("a", "b"), links
