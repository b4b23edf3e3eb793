import random

import pytest
from pyspark.sql import functions as F

from panelkit.operators import fuzzy
from panelkit.operators.fuzzy import fuzzy_best_match

from .test_text_rules import _ratio


def check(spark, left, right, thr, exclude_same=False):
    ldf = spark.createDataFrame(left, "lid long, name string")
    rdf = spark.createDataFrame(right, "ord long, station string")
    out = fuzzy_best_match(ldf, rdf, left_key="name", right_key="station", right_order="ord",
                           right_cols=["ord"], threshold=thr)
    got = {r.lid: (r.match_score, r.ord) for r in out.collect()}
    assert len(got) == len(left)
    for lid, name in left:
        s, neg = max((_ratio(name, st), -o) for o, st in right)
        assert got[lid] == ((s, -neg) if s >= thr else (None, None)), (thr, name, got[lid])


def test_fuzzy_matches_brute_force(spark):
    rnd = random.Random(5)
    words = ["BIG", "BEND", "EEL", "RIVER", "OAK", "HILL", "BELL", "SONOMA", "SOMONA", "PARK", "TAP", ""]
    left = [(i, " ".join(rnd.sample(words, rnd.randint(1, 3)))) for i in range(60)]
    right = [(j, " ".join(rnd.sample(words, rnd.randint(1, 3))) + rnd.choice(["", " TAP", " 2"])) for j in range(40)]
    right.append((99, right[0][1]))  # duplicate station text, higher order: never wins a tie
    check(spark, left, right, 80)


@pytest.mark.parametrize("thr", [60, 80, 95])
def test_keys_are_exact_on_near_duplicates(spark, thr):
    rnd = random.Random(9)

    def word():
        return "".join(rnd.choice("aab c1") for _ in range(rnd.randint(1, 14)))
    check(spark, [(i, word()) for i in range(80)], [(j, word()) for j in range(80)], thr)


@pytest.mark.parametrize("thr", [60, 80, 95])
def test_keys_are_exact_after_random_edits(spark, thr):
    """Long names and their edited copies, some over 62 characters."""
    rnd = random.Random(thr)
    right, left = [], []
    for j in range(60):
        name = "".join(rnd.choice("abcdefghijklmnop  ") for _ in range(rnd.choice([4, 9, 14, 22, 35, 70])))
        right.append((j, name))
        chars = list(name)
        for _ in range(rnd.randint(0, 1 + int(len(name) * 0.45))):
            at = rnd.randrange(len(chars) + 1)
            if rnd.random() < 0.5 and at < len(chars):
                del chars[at]
            else:
                chars.insert(at, rnd.choice("abcdxyz "))
        left.append((j, "".join(chars)))
    check(spark, left, right, thr)


def invented(rnd, n):
    parts = ("BRUNS WICK PLA CER VILLE WY AN DOTTE DOB BINS MAR TELL PEN RYN RIN CON SHADY GLEN SPRING GAP TIG ER CREEK "
             "FROG TOWN HIG GINS OAK HILL BEL MONT SAN TA ROSA LOS TOS RED BLUFF MOR GAN VOLTA HALF MOON CAL PIKE CITY ALTO MES").split()
    return [(i, " ".join("".join(rnd.choice(parts) for _ in range(rnd.choice([1, 2, 2, 3]))) for _ in range(rnd.choice([1, 2])))) for i in range(n)]


def test_pairs_that_meet_on_invented_names(spark):
    """2,000 x 2,000 names of one or two words: few pairs meet, none of the close
    ones is lost, and no key holds a large share."""
    rnd = random.Random(2)
    a, b = ({x.lower() for _, x in invented(rnd, 2000)} for _ in range(2))
    a, b = ({" ".join(sorted(x.split())) for x in s} for s in (a, b))
    left, right = (spark.createDataFrame([(x,) for x in s], "name string") for s in (a, b))
    met = fuzzy.meeting_pairs(left, right, 80).cache()
    assert met.count() < 0.05 * len(a) * len(b)
    keys = fuzzy.left_keys(left, fuzzy.lengths(right), 0.795).groupBy("key").count().join(
        fuzzy.right_keys(right, fuzzy.lengths(left), 0.795).groupBy("key").agg(F.count("*").alias("n")), "key")
    most, total = keys.agg(F.max(F.col("count") * F.col("n")), F.sum(F.col("count") * F.col("n"))).first()
    assert most <= 0.01 * total
    found = {(r.ln, r.rn) for r in met.distinct().collect()}
    for x in rnd.sample(sorted(a), 60):
        for y in b:
            if (x, y) not in found:
                assert _ratio(x, y) < 80, (x, y)
    met.unpersist()


def test_null_and_empty_names(spark):
    left = spark.createDataFrame([(1, None), (2, ""), (3, "--"), (4, "OAK")], "lid long, name string")
    right = spark.createDataFrame([(1, None), (2, ""), (3, "OAK")], "ord long, station string")
    got = {r.lid: r.ord for r in fuzzy_best_match(left, right, left_key="name", right_key="station", right_order="ord", right_cols=["ord"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    none = right.where("ord > 9")
    assert fuzzy_best_match(left, none, left_key="name", right_key="station", right_order="ord", right_cols=["ord"]).where("ord is null").count() == 4
