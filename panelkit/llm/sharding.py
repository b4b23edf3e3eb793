"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every document starts with a shard by
its place in a hash order, so shard counts are at most one apart. In a round
each group of linked documents votes for the shard most of it already sits in
(of those with room for the rest of it), and its members ask to move there.
Quotas decide how many of the movers from shard a to b are let in: as many as
move from b to a, plus as many unlinked documents as b can send away in
exchange. The unlinked documents then fill the gaps, so the counts never
change. Rounds end when nobody moves, or after `rounds`.

A group larger than a shard is split into as many parts as it needs shards;
joins on large parts are salted; copies are counted before any shuffle. What
reaches the driver are counts by pair of shards (shards squared numbers).

Defined cases: a NULL text has no bytes (size 8, CRC 0) and equals an empty
one; NULL or repeated ids are separate documents; with fewer documents than
shards some shards stay empty; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checked_small, discard, materialise, texts

MOST_BUCKETS = 4096
ROWS_PER_BUCKET = 20_000
ROWS_PER_SALT = 10_000


def ranked(df: DataFrame, keys: list[str], by: Column, rows: int, name: str) -> DataFrame:
    """Adds a gapless rank from 0 within the keys, ordered by hash bucket and `by`.

    No task sees a whole key: rows are numbered within (key, bucket), and the
    buckets' counts, keys x `MOST_BUCKETS` rows at most, give the offsets.
    `df` is read twice, so it should be a stored table.
    """
    n = min(MOST_BUCKETS, rows // ROWS_PER_BUCKET + 1)
    t = df.withColumn("_bucket", F.pmod(F.xxhash64(by, F.lit("bucket")), F.lit(n)))
    counts = t.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys, F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = checked_small(counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
                            rows=MOST_BUCKETS * 32)
    within = W.partitionBy(*keys, "_bucket").orderBy(by, "row")
    return (t.join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.row_number().over(within) - 1)
            .drop("_bucket", "_before"))


def _quotas(moves: dict[tuple[int, int], int], spare: dict[int, int]) -> dict[tuple[int, int], int]:
    """How many may move from a to b: the swaps, and shares of b's spare places."""
    swaps = {(a, b): min(n, moves.get((b, a), 0)) for (a, b), n in moves.items()}
    asked: dict[int, int] = {}
    for (a, b), n in moves.items():
        asked[b] = asked.get(b, 0) + n - swaps[a, b]
    return {(a, b): swaps[a, b] + (n - swaps[a, b]) * min(spare.get(b, 0), asked[b]) // max(asked[b], 1)
            for (a, b), n in moves.items()}


def _fill(net: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(from, first rank, end rank, to): unlinked documents that leave the shards
    that gained movers for those that lost them; at most two rows a shard."""
    want, plan = [[b, -n] for b, n in sorted(net.items()) if n < 0], []
    for a, n in sorted(net.items()):
        at = 0
        while at < n:
            take = min(n - at, want[0][1])
            plan.append((a, at, at + take, want[0][0]))
            at += take
            want[0][1] -= take
            if not want[0][1]:
                want.pop(0)
    return plan


def _pick(pairs: list[tuple[Column, Column]], other: Column) -> Column:
    out = None
    for cond, value in pairs:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return other if out is None else out.otherwise(other)


def label_propagation_shards(docs: DataFrame, shards: int = 24, rounds: int = 10,
                             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, size, text_crc32, part, shard): part names the linked documents
    (NULL: none), shard counts are at most one apart."""
    t = texts(docs, id_col, text_col)
    base = materialise(t.select(F.monotonically_increasing_id().alias("row"), "doc_id",
                                (F.octet_length("text") + F.lit(8)).cast("long").alias("size"),
                                F.crc32("text").cast("long").alias("text_crc32"), F.sha2("text", 256).alias("same")), "shard-rows")
    total = base.count()
    quota = max(1, total // shards)
    groups = materialise(base.groupBy("same").agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    placed = ranked(base, [], F.xxhash64("row"), total, "place").withColumn("shard", (F.col("place") % shards).cast("int")).drop("place")
    parts = F.ceil(F.col("n") / quota)
    salts = F.floor(F.col("n") / parts / ROWS_PER_SALT).cast("int") + 1
    state = materialise(placed.join(groups, "same", "left").select(
        "row", "doc_id", "size", "text_crc32", "shard",
        F.when(F.col("n").isNotNull(), F.xxhash64("same", F.pmod(F.xxhash64("row", F.lit("part")), parts))).alias("part"),
        salts.alias("salts"), F.pmod(F.xxhash64("row", F.lit("salt")), salts).cast("int").alias("salt")), "shard-state-0")
    linked, alone = state.where("part is not null"), state.where("part is null")
    for k in range(1, rounds + 1):
        spare = {r.shard: r.n for r in alone.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row per shard
        room = F.element_at(F.array(*[F.lit(spare.get(s, 0)).cast("long") for s in range(shards)]), F.col("shard") + 1)
        votes = linked.groupBy("part", "shard").agg(F.count("*").alias("n"), F.max("salts").alias("salts"))
        votes = votes.withColumn("all", F.sum("n").over(W.partitionBy("part")))  # at most a row per shard in a window
        best = F.max_by("shard", F.struct((F.col("all") - F.col("n") <= room).alias("fits"), "n", F.xxhash64("part", "shard")))
        target = materialise(votes.groupBy("part").agg(best.alias("target"), F.max("salts").alias("salts"))
                             .select("part", "target", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")), f"shard-target-{k}")
        asking = materialise(linked.join(target, ["part", "salt"]), f"shard-asking-{k}") if rounds else linked
        moves = {(r.shard, r.target): r.n for r in
                 asking.where("shard <> target").groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}  # shards squared rows at most
        quotas = _quotas(moves, spare)
        if not any(quotas.values()):
            break
        movers = asking.where("shard <> target")
        if quotas == moves:
            moved = movers.withColumn("shard", F.col("target"))
        else:
            let = _pick([((F.col("shard") == a) & (F.col("target") == b), F.col("turn") < n) for (a, b), n in sorted(quotas.items())], F.lit(False))
            moved = ranked(movers, ["shard", "target"], F.xxhash64("part"), total, "turn").withColumn(
                "shard", F.when(let, F.col("target")).otherwise(F.col("shard"))).drop("turn")
        columns = state.columns
        new_linked = materialise(moved.select(columns).union(asking.where("shard = target").select(columns)), f"shard-linked-{k}")
        net: dict[int, int] = {}
        for (a, b), n in quotas.items():
            net[a], net[b] = net.get(a, 0) - n, net.get(b, 0) + n
        plan = _fill(net)
        if plan:
            sends = alone.where(F.col("shard").isin([a for a, *_ in plan]))
            rest = alone.where(~F.col("shard").isin([a for a, *_ in plan]))
            to = _pick([((F.col("shard") == a) & (F.col("turn") >= x) & (F.col("turn") < y), F.lit(b)) for a, x, y, b in plan], F.col("shard"))
            sent = ranked(sends, ["shard"], F.xxhash64("row"), total, "turn").withColumn("shard", to.cast("int")).select(columns)
            alone = materialise(sent.union(rest.select(columns)), f"shard-alone-{k}")
        for x in (asking, target):
            discard(x)
        linked = new_linked
    return linked.union(alone).select("row", "doc_id", "size", "text_crc32", "part", "shard")


def with_slots(placed: DataFrame) -> DataFrame:
    """Adds slot: gapless from 0 within the shard. `placed` must be stored tables."""
    return ranked(placed, ["shard"], F.xxhash64("row"), placed.count(), "slot")


def cut_links(placed: DataFrame) -> DataFrame:
    """(links, cut): links from each group part to its largest share of one shard, and those cut."""
    n = placed.where("part is not null").groupBy("part", "shard").agg(F.count("*").alias("n"))
    p = n.groupBy("part").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
    return p.agg(F.coalesce(F.sum(F.col("all") - 1), F.lit(0)).alias("links"), F.coalesce(F.sum(F.col("all") - F.col("most")), F.lit(0)).alias("cut"))
