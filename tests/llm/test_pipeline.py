"""The corpus pipeline: every stage against brute force on its own input, with NULLs,
repeated rows, clashing columns and empty tables."""

import os
import random

import pytest

import corpus_pipeline as cp
from panelkit.llm.word_ids import tokenizer

from .test_operators import brute_covered, brute_fp

rng = random.Random(8)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, carried double, row_id int"


def prose(n):
    return " ".join(rng.choice(["river", "stone", "Of", "the", "quiet", "morning", "é", "and,", "bridge."]) + rng.choice(["", "s", "ing"]) for _ in range(n))


PASSAGE, COPY = prose(120), prose(60)
TEXTS = [None, "", " ", "one", COPY, COPY, COPY + " and", COPY.upper(), prose(40) + " " + PASSAGE, PASSAGE + " " + prose(200),
         prose(3000), prose(30), prose(31)]


def row(i, t):
    return (i, t, "en", "web", None if t is None else len(t), "x", 1, 0.5, 7)


ROWS = [row(i, t) for i, t in enumerate(TEXTS)] + [row(11, TEXTS[11]), row(None, "one"), row(None, None)]
TOXIC = [row(1000 + i, "you vile scum filth " + prose(15) + " vile scum") for i in range(60)]
CLEAN = [row(2000 + i, prose(20 + i % 9)) for i in range(400)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(ROWS + TOXIC + CLEAN, SCHEMA).repartition(3).write.parquet(os.path.join(d, "documents.parquet"))
    labels = [(r[0], 0 if r in TOXIC else 1, int(r in TOXIC)) for r in TOXIC[:45] + CLEAN[:320]] + [(5, None, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    return d


def stored(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(path))
    return spark.read.parquet(str(path))


def texts(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in df.collect())


def test_toxic_documents_go_and_clean_ones_stay(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    left = cp.drop_toxic(spark, docs, folder)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.collect()}
    assert not ids & {r[0] for r in TOXIC} and ids >= {r[0] for r in CLEAN}


def test_of_equal_texts_the_largest_id_stays(spark, tmp_path):
    left = cp.drop_copies(spark, stored(spark, ROWS, tmp_path / "in"), "")
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(-1 if i is None else i)
    assert texts(left) == sorted((max(g), t) for t, g in groups.items()) and left.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_one_document_of_each_near_group_stays(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 11] + [row(11, TEXTS[11])]
    fps = [brute_fp(r[1]) for r in rows]
    comp = list(range(len(fps)))
    for _ in fps:
        comp = [min(comp[j] for j, y in enumerate(fps) if bin(x ^ y).count("1") <= 2) for x in fps]
    want = sorted((min(r[0] for r, d in zip(rows, comp) if d == c)) for c in set(comp))
    left = cp.drop_near_copies(spark, stored(spark, rows, tmp_path / "in"), "")
    assert sorted(r.doc_id for r in left.collect()) == want


def test_passages_go_and_documents_stay(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None]
    covered = brute_covered([(r[1] or "").encode() for r in rows])
    want = sorted((r[0], bytes(b for b, c in zip((r[1] or "").encode(), cov) if not c).decode("utf-8", "ignore")) for r, cov in zip(rows, covered))
    out = cp.remove_passages(spark, stored(spark, rows, tmp_path / "in"), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == want
    assert all((r.text is None) == (r.doc_id == 0) and r.row_id == 7 and r.carried == 0.5 for r in out)
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    assert any(len(t) < len(r[1] or "") for (_, t), r in zip(want, sorted(rows, key=lambda r: r[0])))


def test_sequences_are_gapless_and_hold_all_ids(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None and r[0] != 11]
    out = cp.pack(spark, stored(spark, rows, tmp_path / "in"), "").collect()
    t = tokenizer("word_bpe_49k.json")
    length = {r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    assert {i: sum(r.length for r in out if r.doc_id == i) for i in length} == length
    for s in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_the_whole_run_is_its_stages_in_turn(spark, folder, tmp_path):
    docs = spark.read.parquet(folder + "/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, folder)
        if k < len(cp.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    got = cp.run(spark, folder)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(keep).collect()), key=str) == sorted(map(tuple, docs.select(keep).collect()), key=str)
    ids = {r.doc_id for r in got.collect()}
    assert not ids & {r[0] for r in TOXIC} and 7 in ids


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    assert cp.run(spark, d).count() == 0
