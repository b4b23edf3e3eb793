"""Fuzzy best-match join: each left name to its most similar right name.

A pair of normalised names a, b scores T or more only if their indel distance
(characters deleted from either until they are equal) is at most
D = (1 - (T - 0.5) / 100) (la + lb), lowered by one where its parity differs
from la + lb. The distance adds up over any cut of the alignment, which gives
an exact blocking key:

1. names meet by pair of lengths (la, lb); a is cut into m = D // 3 + 1 even
   parts, so the alignment spends at most e = D // m <= 2 on one of them;
2. for that part, deleting at most two characters from it and from its
   counterpart in b leaves equal texts: those texts are the join keys
   (deletion neighbourhoods). The counterpart's start and size follow from the
   part's place, limited by what the parts before it (each spends more than e
   if this is the first cheap one), the size difference and the rest of the
   names must cost;
3. classes of lengths with parts too short to tell anything (low thresholds
   only) compare all their names instead, salted;
4. pairs that met are made distinct and scored: the LCS is a bit-vector
   recurrence on one long per character of a, with the positions of each
   character in b as bit masks (names over 62 characters: the plain LCS);
5. best per left name by a min over the struct (-score, right order) with
   map-side partial aggregation; the winner is joined back to every left row.

Only distinct normalised names take part in 1-4. Key rows hold a 64-bit hash of
the key and the name; a collision only makes one more pair to score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lcs_length, token_sort_key
from ..session import cut_lineage

# Fixed value: the alphabet of the token-sort normal form (lower-case ASCII
# letters, digits, underscore and the single space separator).
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789_ "
MASK_BITS = 62       # positions in a mask; the recurrence's sums then stay below 2**63
CHEAP = 2            # most deletions spent on a part that makes keys
SHORTEST_KEY = 2     # a class whose keys could be shorter compares all its names
SALTS = 32


def _drop(s: Column, count: int) -> Column:
    """All texts left when `count` (0..2) characters of `s` are deleted; NULL if it has fewer."""
    n = F.length(s)

    def one(i: Column) -> Column:
        return F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, n))

    def two(i: Column) -> Column:
        head, rest = F.substring(s, F.lit(1), i - 1), i + 1
        return F.transform(F.sequence(rest, n), lambda j: F.concat(head, F.substring(s, rest, j - rest), F.substring(s, j + 1, n)))

    if count == 0:
        return F.array(s)
    if count == 1:
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), one))
    return F.when(n >= 2, F.flatten(F.transform(F.sequence(F.lit(1), n - 1), two)))


def _deletions(s: Column, count: Column) -> Column:
    out = F.when(count == 0, _drop(s, 0)).when(count == 1, _drop(s, 1))
    return F.array_distinct(out.when(count == 2, _drop(s, 2)))


def _classes(names: DataFrame, own: str, others: list[int], ratio: float) -> DataFrame:
    """Adds a class of lengths (la, lb) for each length on the other side that can
    match: distance d, deletions x from a and y from b at most, m parts, e per part."""
    far = F.floor(F.lit(1 - ratio) * (F.col("la") + F.col("lb")) + F.lit(1e-9)).cast("int")
    other = "lb" if own == "la" else "la"
    return (names.withColumn(own, F.length("name")).withColumn(other, F.explode(F.array(*[F.lit(n) for n in others])))
            .withColumn("d", far - F.pmod(far - F.col("la") - F.col("lb"), F.lit(2)))
            .where(F.abs(F.col("la") - F.col("lb")) <= F.col("d"))
            .withColumn("x", ((F.col("d") + F.col("la") - F.col("lb")) / 2).cast("int"))
            .withColumn("y", ((F.col("d") - F.col("la") + F.col("lb")) / 2).cast("int"))
            .withColumn("m", F.floor(F.col("d") / (CHEAP + 1)).cast("int") + 1)
            .withColumn("e", F.floor(F.col("d") / F.col("m")).cast("int"))
            .withColumn("weak", (F.col("e") > 0) & (F.floor(F.col("la") / F.col("m")) - F.least("e", "x") < SHORTEST_KEY)))


def _parts(classes: DataFrame) -> DataFrame:
    """One row per part k of a: place p, length l."""
    return (classes.where("not weak").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            .withColumn("p", F.floor(F.col("la") * F.col("k") / F.col("m")).cast("int"))
            .withColumn("l", F.floor(F.col("la") * (F.col("k") + 1) / F.col("m")).cast("int") - F.col("p")))


def _key(text: Column) -> Column:
    return F.xxhash64("la", "lb", "k", text).alias("key")


def _all_key(salt: Column) -> Column:
    return F.xxhash64("la", "lb", F.lit("all"), salt).alias("key")


def left_keys(names: DataFrame, right_lengths: list[int], ratio: float) -> DataFrame:
    """(key, name): the deletion neighbourhoods of each part of each left name."""
    classes = _classes(names, "la", right_lengths, ratio)
    parts = (_parts(classes).withColumn("gone", F.explode(F.sequence(F.lit(0), F.least("e", "x", "l"))))
             .withColumn("text", F.explode(_deletions(F.substring("name", F.col("p") + 1, F.col("l")), F.col("gone")))))
    every = classes.where("weak").select(_all_key(F.pmod(F.xxhash64("name"), F.lit(SALTS)).cast("int")), "name")
    return parts.select(_key(F.col("text")), "name").unionByName(every)


def right_keys(names: DataFrame, left_lengths: list[int], ratio: float) -> DataFrame:
    """(key, name): the same for every counterpart that a part can have in a right name.

    A counterpart `more` characters longer than its part is matched with the
    most deletions its budget allows: equal texts after fewer are equal after more.
    """
    classes = _classes(names, "lb", left_lengths, ratio)
    part = (_parts(classes).withColumn("more", F.explode(F.sequence(-F.col("e"), F.col("e"))))
            .withColumn("size", F.col("l") + F.col("more"))
            .withColumn("from_a", F.least(F.floor((F.col("e") - F.col("more")) / 2).cast("int"), F.col("x"), F.col("y") - F.col("more"), F.col("l")))
            .withColumn("gone", F.col("from_a") + F.col("more"))
            .where("size >= 0 and from_a >= 0 and gone >= 0 and size <= lb"))
    first, last = F.greatest(F.lit(0), F.col("p") - F.col("x")), F.least(F.col("lb") - F.col("size"), F.col("p") + F.col("y"))
    starts = (F.when(F.col("m") == 1, F.when(F.col("size") == F.col("lb"), F.array(F.lit(0))))
              .when(F.col("k") == 0, F.array(F.lit(0)))
              .when(F.col("k") == F.col("m") - 1, F.array(F.col("lb") - F.col("size")))
              .otherwise(F.when(first <= last, F.sequence(first, last))))
    shift = F.col("start") - F.col("p")
    before = F.greatest(F.abs(shift), F.col("k") * (F.col("e") + 1))
    after = F.abs(F.col("lb") - F.col("la") - shift - F.col("more"))
    placed = part.withColumn("start", F.explode(starts)).where(before + F.abs("more") + after <= F.col("d"))
    texts = placed.withColumn("text", F.explode(_deletions(F.substring("name", F.col("start") + 1, F.col("size")), F.col("gone"))))
    every = classes.where("weak").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select(_all_key(F.col("salt")), "name")
    return texts.select(_key(F.col("text")), "name").unionByName(every)


def lengths(names: DataFrame) -> list[int]:
    """The distinct lengths of the names, at most as many as the longest has characters."""
    return sorted(r[0] for r in names.select(F.length("name")).distinct().collect())


def meeting_pairs(left: DataFrame, right: DataFrame, threshold: int) -> DataFrame:
    """(ln, rn) of names that share a key, with repeats where they share several.

    Holds every pair of `name`s (normalised, not empty) with a token-sort
    ratio of `threshold` or more.
    """
    ratio = (threshold - 0.5) / 100.0
    a = left_keys(left, lengths(right), ratio).withColumnRenamed("name", "ln")
    b = right_keys(right, lengths(left), ratio).withColumnRenamed("name", "rn")
    return a.join(b, "key").select("ln", "rn")


def char_codes(c: Column) -> Column:
    """Places of a normalised text's characters in ALPHABET (array<int>, from 1)."""
    return F.transform(F.split(c, ""), lambda ch: F.call_function("instr", F.lit(ALPHABET), ch))


def char_masks(c: Column) -> Column:
    """For each ALPHABET character the bit set of its places in a text (array<long>)."""
    places = F.sequence(F.lit(0), F.length(c) - 1)
    return F.transform(F.split(F.lit(ALPHABET), ""), lambda ch: F.aggregate(
        F.filter(places, lambda i: F.substring(c, i + 1, F.lit(1)) == ch), F.lit(0).cast("long"),
        lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def masked_lcs(codes: Column, masks: Column, length: Column) -> Column:
    """LCS length from the codes of a and the masks of b (at most MASK_BITS long)."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), length) - 1

    def step(free: Column, code: Column) -> Column:
        hit = free.bitwiseAND(F.element_at(masks, code))
        return (free + hit).bitwiseOR(free - hit).bitwiseAND(full)

    return length - F.bit_count(F.aggregate(codes, full, step)).cast("int")


def fuzzy_best_match(left: DataFrame, right: DataFrame, *, left_key: str, right_key: str,
                     right_order: str, right_cols: list[str], threshold: int = 80,
                     exclude_same: bool = False) -> DataFrame:
    """For each row of ``left``: the ``right`` row whose token-sort ratio with it
    is highest, if that score is >= ``threshold``; ties go to the lowest
    ``right_order``. Returns left's columns + ``match_score`` + ``right_cols``
    (NULL when no right row reaches the threshold).

    ``left_key``/``right_key`` are the already-cleaned match texts.
    ``exclude_same`` skips pairs whose normalised texts are equal (self match)."""
    raw = left.select(F.col(left_key).alias("_lraw")).distinct().withColumn("_ln", token_sort_key(F.col("_lraw")))
    lk = raw.select(F.col("_ln").alias("name")).where("name <> ''").distinct()
    # one representative (lowest order) per distinct normalised right text:
    # equal texts score equally, and the tie rule picks the lowest order
    rk = (right.select(F.col(right_order).alias("_ro"), token_sort_key(F.col(right_key)).alias("name"))
               .where("name <> ''").groupBy("name").agg(F.min("_ro").alias("_ro")))
    # several jobs read the distinct names; the tables' scans feed only these two
    lk, rk = cut_lineage(lk), cut_lineage(rk)
    pairs = meeting_pairs(lk, rk.select("name"), threshold)
    if exclude_same:
        pairs = pairs.where(F.col("ln") != F.col("rn"))
    # masks and codes are made once per name and joined to the pairs that met
    short = F.length("name") <= MASK_BITS
    names_a = lk.select(F.col("name").alias("ln"), F.length("name").alias("la"), char_codes(F.col("name")).alias("codes"))
    names_b = rk.select(F.col("name").alias("rn"), F.length("name").alias("lb"), F.when(short, char_masks(F.col("name"))).alias("masks"), "_ro")
    met = pairs.distinct().join(names_a, "ln").join(names_b, "rn")
    common = F.when(F.col("masks").isNotNull(), masked_lcs(F.col("codes"), F.col("masks"), F.col("lb"))).otherwise(lcs_length("ln", "rn"))
    # the threshold applies to each name's best score: a filter on the score
    # itself would be pushed into the join and evaluate it twice
    scored = met.select("ln", "_ro", F.bround(F.lit(200.0) * common / (F.col("la") + F.col("lb")), 0).cast("int").alias("_s"))
    best = (scored.groupBy("ln").agg(F.min(F.struct((-F.col("_s")).alias("neg"), F.col("_ro"))).alias("_b"))
                  .select("ln", (-F.col("_b.neg")).alias("match_score"), F.col("_b._ro").alias("_ro"))
                  .where(F.col("match_score") >= threshold))
    rsel = right.select(F.col(right_order).alias("_ro"), *right_cols)
    matched = raw.join(best, raw["_ln"] == best["ln"]).join(rsel, "_ro").drop("_ro", "ln", "_ln")
    return (left.join(matched, left[left_key].eqNullSafe(matched["_lraw"]), "left")
                .drop("_lraw"))
