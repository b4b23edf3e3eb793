"""Every training-data operator against brute force, on a small table with NULLs,
empty and long texts, repeated rows, ties and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelkit.llm import (attention_lm, bpe, exact_dedup, license_scan, packing, quality_ledger, sharding, simhash,
                          suffix_dedup, toxicity)
from panelkit.llm.common import connected_components, materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)


def prose(n: int) -> str:
    return " ".join(rng.choice(["the", "of", "thention", "erwh", "Éan", "aux,", "blede.", "12", "x"]) + rng.choice(["", "", "ly", "re"]) for _ in range(n))


PASSAGE = prose(150)
BASE = prose(400)
TEXTS = [None, "", " \t\n", "one", "two words", "A b C", prose(30), BASE, BASE, BASE + " tail", prose(20) + PASSAGE + prose(20),
         PASSAGE + prose(90), prose(7) + PASSAGE, "ab" * 700, "don't it's <|endoftext|> <|ENDOFTEXT|> 3,14 naïve é İ x",
         "\n".join(["same line here"] * 5 + ["other"]), prose(6000), "word " * 60, "x" * 3000, "Released under the MIT License.",
         prose(40) + " Licensed under the Apache License,\nVersion 2.0. " + prose(40)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(7, BASE), (None, "one"), (None, None)]
DATA = [(i, t, "k", 1, 2.0, True) for i, t in ROWS]
SCHEMA = "doc_id long, text string, row string, kept int, word double, fp boolean"


@pytest.fixture(scope="module")
def docs(spark):
    return materialise(spark.createDataFrame(DATA, SCHEMA), "llm-fixture")


@pytest.fixture(scope="module")
def none(spark):
    return materialise(spark.createDataFrame([], SCHEMA), "llm-empty")


def by_row(rows, *cols):
    return Counter(tuple(r[c] for c in cols) for r in rows)


def utf8(t):
    return (t or "").encode()


def test_bpe_equals_the_library(docs, none):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.vocabulary())
    want = Counter()
    for i, x in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i, tuple(ids), t.decode(ids, skip_special_tokens=False)] += 1
    got = bpe.bpe_round_trip(docs).collect()
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    back = bpe.bpe_decode(bpe.bpe_encode(docs)).collect()
    assert by_row(back, "doc_id", "decoded") == Counter((i, d) for (i, _, d), n in want.items() for _ in range(n))
    assert bpe.bpe_round_trip(none).count() == 0


def test_bpe_long_and_short_merge_alike():
    c = bpe.codec(bpe.vocabulary())
    for word in ["thentionbleering", "aaaaaaaaaaaa", "ÉÉÉéé"]:
        parts = [c.id_of_byte[b] for b in word.encode()]
        assert c.merge_short(list(parts)) == c.merge_long(list(parts))


def brute_fp(text, k=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs, none):
    fps = [brute_fp(t) for _, t in ROWS]
    comp = list(range(len(fps)))
    for _ in fps:
        comp = [min(comp[j] for j, y in enumerate(fps) if bin(x ^ y).count("1") <= 2) for x in fps]
    least = {c: min((i for (i, _), d in zip(ROWS, comp) if d == c and i is not None), default=None) for c in comp}
    got = simhash.simhash_groups(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id").collect()
    assert by_row(got, "doc_id", "f", "component_id") == Counter((i, f"{x:016x}", least[c]) for (i, _), x, c in zip(ROWS, fps, comp))
    assert simhash.simhash_groups(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp))


@pytest.mark.parametrize("meet", [2, 64])
def test_simhash_links_lose_no_pair(spark, meet):
    r = np.random.default_rng(3)
    base = int(r.integers(0, 1 << 63))
    fps = sorted({base ^ sum(1 << int(b) for b in r.integers(0, 12, r.integers(0, 4))) for _ in range(150)} | {int(x) for x in r.integers(0, 1 << 63, 60)})
    got = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), 2, meet=meet).collect()
    want = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2}
    assert {(x.u, x.v) for x in got} == want and len(got) == len(want)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (95, 100), (50, 50)], "u long, v long")
    got = {r.node: r.label for r in connected_components(e, "test").collect()}
    assert got == {i: 0 for i in range(31)} | {90: 90, 95: 90, 100: 90}


def test_exact_dedup(docs, none):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    top = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    assert by_row(got, "doc_id", "keep_id", "group_size", "text_sha256") == Counter(
        (i, top[t or ""], len(groups[t or ""]), hashlib.sha256(utf8(t)).hexdigest()) for i, t in ROWS)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    tight = exact_dedup.exact_dedup(docs, most_cells=1 << 16)
    assert by_row(tight.collect(), "doc_id", "keep_id", "kept") == by_row(got, "doc_id", "keep_id", "kept")
    for stored in (False, True):
        left = exact_dedup.drop_exact_duplicates(docs, stored=stored)
        assert left.columns == docs.columns and sorted((r.text or "") for r in left.collect()) == sorted(groups)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def brute_covered(texts, length=400):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        c = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                c[i:i + length] = True
        out.append(c)
    return out


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_suffix_dedup(docs, none, most):
    data = [utf8(t) for _, t in ROWS]
    want = Counter()
    for (i, _), t, c in zip(ROWS, data, brute_covered(data)):
        want[i, bytes(np.frombuffer(t, np.uint8)[~c]), len(t), int(c.sum()), int(np.count_nonzero(np.diff(c, prepend=False) & c))] += 1
    got = suffix_dedup.remove_repeats(docs, most=most).collect()
    assert Counter((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got) == want
    if most == 4096:
        clean = suffix_dedup.without_repeats(docs)
        assert clean.columns == docs.columns and clean.where("text is null").count() == 2
        assert suffix_dedup.remove_repeats(none).count() == 0


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, x in ROWS:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k in range(-(-len(ids) // 500)):
            part = ids[500 * k:500 * k + 500]
            want[i, k, 500 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack_documents(docs, length=500, open_bins=4).collect()
    assert by_row(rows, "doc_id", "piece", "start", "length", "ids_crc32") == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 500
    assert packing.pack_documents(none).count() == 0


def test_sharding(spark, docs, none):
    many = [(i, f"text {i}") for i in range(400)] + [(400 + i, f"twin {i % 30}") for i in range(120)] + [(600 + i, "hot") for i in range(260)] + ROWS
    table = materialise(spark.createDataFrame(many, "doc_id long, text string"), "shard-fixture")
    placed = materialise(sharding.label_propagation_shards(table, shards=6), "shard-placed")
    rows = sharding.with_slots(placed).collect()
    assert by_row(rows, "doc_id", "size", "text_crc32") == Counter((i, len(utf8(t)) + 8, zlib.crc32(utf8(t))) for i, t in many)
    counts = Counter(r["shard"] for r in rows)
    assert len(counts) == 6 and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r["shard"] == s) == list(range(n))
    cut = sharding.cut_links(placed).first()
    assert cut.cut <= 0.1 * cut.links
    assert sharding.label_propagation_shards(none).count() == 0
    few = sharding.label_propagation_shards(docs, shards=24).collect()
    assert max(Counter(r["shard"] for r in few).values()) == 1


def test_quality_ledger(docs, none):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        n, inside = Counter(win), set()
        for i, x in enumerate(win):
            if n[x] > 1:
                inside.update(range(i, i + 8))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)

    ledger = materialise(quality_ledger.quality_ledger(docs), "ledger")
    want = Counter((i, *brute(t)) for i, t in ROWS)
    assert by_row(ledger.collect(), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    kept = quality_ledger.apply_policy(ledger, ("base", 1)).collect()
    assert all(r.kept == (r.n_words >= 20 and 100 * r.n_repeat_words <= 30 * r.n_words) for r in kept)
    m = quality_ledger.mask(("pretraining", 2))
    for r in quality_ledger.ablations(ledger, ("pretraining", 2)).collect():
        b = quality_ledger.bit(r.rule)
        assert (r.n_failed, r.n_only, r.kept_without) == tuple(sum(f(x.failed & m) for x in kept) for f in (
            lambda v: bool(v & b), lambda v: v == b, lambda v: not v & ~b))
    assert quality_ledger.quality_ledger(none).count() == 0


def test_license_scan(docs, none):
    got = {r.doc_id: r.licenses for r in license_scan.license_scan(docs).where("n_licenses > 0").collect()}
    assert got == {19: "mit", 20: "apache-2.0"}
    assert license_scan.license_scan(docs).count() == len(ROWS) and license_scan.license_scan(none).count() == 0
    assert license_scan.collision_probability(0.8 / 5.2) > 0.9999


def test_toxicity(spark, none):
    r = random.Random(1)
    data = [(i, prose(40) + (" " + r.choice(["scumly", "scumre", "scumth"]) if i % 5 == 0 else ""), 1, int(i % 5 == 0)) for i in range(600)]
    table = materialise(spark.createDataFrame([(i, t) for i, t, _, _ in data] + [(None, None), (9000, "")], "doc_id long, text string"), "toxic-docs")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in data if i % 2 == 0] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(table, labels).collect()
    held = [x for x in rows if x.doc_id is not None and x.doc_id < 600 and x.doc_id % 2]
    assert len(rows) == 602 and np.mean([x.rejected == (x.doc_id % 5 == 0) for x in held]) > 0.98
    assert not any(x.rejected for x in rows if x.doc_id in (None, 9000))
    assert toxicity.drop_toxic(table, labels).columns == ["doc_id", "text"]
    empty = none.select("doc_id", "text")
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(table, labels.where("toxic is null")).where("rejected").count() == 0


def test_lm_counts_and_model(docs, none):
    rows = attention_lm.lm_scores(docs, rounds=1).collect()
    tok = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, t in ROWS]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in ROWS]
    c = Counter(w for t, h in zip(tok, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, h, len(t), sum(c[w] > 0 for w in t), n, sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
                  for (i, _), h, t in zip(ROWS, held, tok))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows)
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert attention_lm.lm_scores(none).count() == 0


def random_weights(seed=0):
    r = np.random.default_rng(seed)
    return {k: r.normal(0, 0.4, s).astype(np.float32) for k, s in attention_lm.SHAPES.items()}


def test_lm_windows_score_each_token_once_and_causally():
    a, w = attention_lm, random_weights()
    kind = (np.arange(a.INPUTS) % a.CLASSES).astype(np.uint8)
    s = np.random.default_rng(1).integers(1, a.INPUTS, 100).astype(np.uint16)
    x, y, m = a.windows_of(s, kind)
    assert m.sum() == 101 and list(y[m > 0]) == [*kind[s], 0]
    one = a.log_probs(w, x.astype(np.intp), y.astype(np.intp))
    late = x.copy()
    late[:, -1] = 5
    assert np.allclose(one[:, :-1], a.log_probs(w, late.astype(np.intp), y.astype(np.intp))[:, :-1])


def test_lm_each_token_is_scored_with_sixteen_before_it():
    a, w = attention_lm, random_weights(8)
    kind = (np.arange(a.INPUTS) % a.CLASSES).astype(np.uint8)
    s = np.random.default_rng(9).integers(1, a.INPUTS, 120).astype(np.uint16)

    def by_token(symbols):
        x, y, m = a.windows_of(symbols, kind)
        return a.log_probs(w, x.astype(np.intp), y.astype(np.intp))[m > 0]

    want = by_token(s)
    for t in range(17, 120):
        other = s.copy()
        other[t - 17] = s[t - 17] % (a.INPUTS - 1) + 1
        assert by_token(other)[t] != want[t]


def test_lm_gradient_is_the_loss_slope():
    a, w = attention_lm, {k: v.astype(np.float64) for k, v in random_weights(2).items()}
    r = np.random.default_rng(3)
    x, y = r.integers(0, 40, (3, a.WINDOW)), r.integers(0, a.CLASSES, (3, a.SCORED))
    m = np.ones((3, a.SCORED))
    g = a.gradients(w, x, y, m)
    for name in ("out", "q", "k", "v", "qp", "kp"):
        w = {k: v.copy() for k, v in w.items()}
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        loss = []
        for d in (1e-4, -2e-4):
            w[name][at] += d
            loss.append(-a.log_probs(w, x, y).mean())
        w[name][at] += 1e-4
        assert abs((loss[0] - loss[1]) / 2e-4 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))


def test_training_steps_use_their_arrays_again():
    """A batch after the first takes few fresh bytes, and what an earlier batch left changes nothing."""
    import tracemalloc
    a, r = attention_lm, np.random.default_rng(6)
    w, used = random_weights(3), []

    def batches():
        for n in (32, 32, 5, 32):
            if n == 32 and len(used) == 1:
                tracemalloc.start()
            used.append((r.integers(0, a.INPUTS, (n, a.WINDOW)), r.integers(0, a.CLASSES, (n, a.SCORED)), (r.random((n, a.SCORED)) < 0.9).astype(np.uint8)))
            yield used[-1]
            if len(used) == 2:
                peak.append(tracemalloc.get_traced_memory()[1])
                tracemalloc.stop()

    peak: list[int] = []
    got = a.adam(w, batches())
    assert peak[0] < 2_500_000  # 4.5 MB with fresh arrays
    assert all(np.isfinite(v).all() for v in got.values()) and np.array_equal(got["bigram"], w["bigram"])
    room = a.Room()
    for x, y, m in used:
        assert all(np.array_equal(v, a.gradients(w, x, y, m)[k]) for k, v in a.gradients(w, x, y, m, room=room).items())
        assert np.array_equal(a.log_probs(w, x, y), a.log_probs(w, x, y, room=room))


def test_gradients_match_the_plain_softmax():
    """Also where a logit is beyond what exp can hold."""
    a, r = attention_lm, np.random.default_rng(7)
    x, y = r.integers(0, a.INPUTS, (6, a.WINDOW)), r.integers(0, a.CLASSES, (6, a.SCORED))
    m = (r.random((6, a.SCORED)) < 0.7).astype(np.uint8)
    for scale in (1, 300):
        w = random_weights(5)
        w["out"] *= scale
        late = x[:, a.CONTEXT:]
        q, k = (np.clip(w[n][z] + w[n + "p"][at:], -1.9, 1.9).astype(float) for n, z, at in (("q", late, a.CONTEXT), ("k", x, 0)))
        e = np.exp(q @ k.transpose(0, 2, 1)) * a.SEEN
        o = (e / e.sum(axis=2, keepdims=True)) @ w["v"][x].astype(float)
        logits = o @ w["out"].astype(float) + w["bigram"][late]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[np.arange(6)[:, None], np.arange(a.SCORED), y] -= 1
        p *= m[..., None] / m.sum()
        want = np.einsum("bsw,bsc->wc", o, p)
        assert np.allclose(a.gradients(w, x, y, m)["out"], want, atol=1e-4 * np.abs(want).max())


def test_lm_windows_of_several_texts_are_those_of_each():
    a, r = attention_lm, np.random.default_rng(4)
    kind = (np.arange(a.INPUTS) % a.CLASSES).astype(np.uint8)
    sizes = np.array([0, 1, a.SCORED - 1, a.SCORED, 0, 100, 0])
    s = r.integers(1, a.INPUTS, sizes.sum()).astype(np.uint16)
    one_by_one = [a.windows_of(t, kind) for t in np.split(s, np.cumsum(sizes)[:-1])]
    for got, want in zip(a.windows_of(s, kind, sizes), zip(*one_by_one)):
        assert np.array_equal(got, np.concatenate(want))


def test_lm_trains_on_every_symbol_of_every_training_text(docs, monkeypatch):
    a, got = attention_lm, {}

    def train(windows, count, bigram, rounds):
        got["targets"] = sum(sum(r.m) for r in windows.collect())
        got["seen"] = real(windows, count, bigram, 1)
        return got["seen"]

    real = a.train
    monkeypatch.setattr(a, "train", train)
    a.lm_scores(docs, rounds=1).count()
    learned = [t for i, t in ROWS if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1]
    words = [w for t in learned for w in a.lower_words(utf8(t))]
    assert got["targets"] == sum(map(len, a.word_ids("word_bpe_49k.json", words))) + len(learned)
    assert np.isfinite(got["seen"]).all()


def test_lm_round_goes_over_every_batch():
    import types

    import pyarrow as pa
    a, seen = attention_lm, Counter()
    r = np.random.default_rng(6)
    flat = a.pack(random_weights(7))

    def batch(ids):
        x = np.repeat(np.array(ids, np.uint16)[:, None], a.WINDOW, axis=1)
        y, m = r.integers(0, a.CLASSES, (2, len(ids), a.SCORED)).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([z.tobytes() for z in t], pa.binary()) for t in (x, y, np.ones_like(m))], ["x", "y", "m"])

    def adam(w, batches, **_):
        for x, _, _ in batches:
            seen.update(x[:, 0].tolist())
        return w

    real, a.adam = a.adam, adam
    try:
        parts = list(a._round(types.SimpleNamespace(value=flat))(iter([batch(range(100)), batch([]), batch(range(100, 1000))])))
        assert set(seen) == set(range(1000)) and {p.column("weight")[0].as_py() for p in parts} == {1000.0}
        assert list(a._round(types.SimpleNamespace(value=flat))(iter([]))) == []
        few = Counter(seen)
        list(a._round(types.SimpleNamespace(value=flat))(iter([batch([5])])))
        assert seen[5] - few[5] == a.LEAST_STEPS * a.BATCH
    finally:
        a.adam = real


def test_lm_round_sends_only_what_is_fitted():
    """The bigram table, two thirds of the weights, doesn't go through the shuffle of a round."""
    import types

    import pyarrow as pa
    a, flat = attention_lm, attention_lm.pack(random_weights(7))
    x, y = np.zeros((40, a.WINDOW), np.uint16), np.zeros((40, a.SCORED), np.uint8)
    b = pa.RecordBatch.from_arrays([pa.array([z.tobytes() for z in t], pa.binary()) for t in (x, y, np.ones_like(y))], ["x", "y", "m"])
    parts = [p.column("part")[0].as_py() for p in a._round(types.SimpleNamespace(value=flat))(iter([b]))]
    assert sum(map(len, parts)) == 4 * (len(flat) - a.INPUTS * a.CLASSES)


def test_lm_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(attention_lm, "REMEMBERED", 3)
    symbol = np.arange(60000).astype(np.uint16)
    table = attention_lm.WordTable("word_bpe_49k.json", symbol, np.zeros(60000), {b"river": 1.5})
    first = {}
    for words in ({b"river", b"stone", b"xqzzw"}, {b"hill", b"park", b"oak"}, {b"stone", b"river", b"xqzzw"}):
        for w, i in table.learn(words).items():
            got = list(table.data[table.begin[i]:table.begin[i] + table.size[i]]), float(table.log[i])
            assert str(first.setdefault(w, got)) == str(got)
    assert first[b"river"][1] == 1.5 and np.isnan(first[b"stone"][1])
