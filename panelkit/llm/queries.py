"""One query per operator over its whole table, with the oracle SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import read_table

from . import (attention_lm, bpe, exact_dedup, lattice_dedup, license_scan, packing, periodic_runs, quality_ledger, sharding,
               simhash, suffix_dedup, toxicity, vector_codes)
from .common import materialise


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode with the byte-level vocabulary."""
    t = bpe.bpe_round_trip(read_table(spark, sf_dir, "documents"))
    return t.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.sha256_of_ids(F.col("ids")).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components: 3-word shingles, 2 bits."""
    t = simhash.simhash_groups(read_table(spark, sf_dir, "documents"), shingle=3, bits=2)
    return t.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier chain over all documents, trained on the labels."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("carried")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies; the largest doc_id of a group stays."""
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes inside repeated 400-byte strings removed."""
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention-model and word-count scores of all documents."""
    return attention_lm.lm_scores(read_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in whole texts."""
    return license_scan.license_scan(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids."""
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), length=4096).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards under the law of rows."""
    t = sharding.label_propagation_shards(read_table(spark, sf_dir, "documents"), shards=24)
    return sharding.with_slots(materialise(t, "shards")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of rule bits, with the base and the current policy applied."""
    ledger = quality_ledger.quality_ledger(read_table(spark, sf_dir, "documents"))
    both = quality_ledger.apply_policy(quality_ledger.apply_policy(ledger, ("base", 1), "base_kept"), ("pretraining", 2))
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("kept")).alias("kept"),
                       F.col("failed").alias("failed_rules"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy costs, from the stored ledger's bits."""
    ledger = materialise(quality_ledger.quality_ledger(read_table(spark, sf_dir, "documents")), "ledger")
    return quality_ledger.ablations(ledger, ("pretraining", 2))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four bytes a vector, four Lloyd rounds."""
    return vector_codes.vector_codes(read_table(spark, sf_dir, "embeddings"))


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's rewriting: one document in ten (by the CRC of its id) repeats
    a stretch of its words to the end. Documents without an id stay as they are."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of at least six words and four periods."""
    t = periodic_runs.periodic_runs(read_table(spark, sf_dir, "documents"), rewrite=with_planted_period)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return t.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                    F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among the embeddings: cosine 0.9 and more."""
    return lattice_dedup.lattice_dedup(read_table(spark, sf_dir, "embeddings"), cosine=0.9)


def _lloyd_sql(rounds: int = 4) -> str:
    """Lloyd's rounds unrolled; whole numbers in doubles stay exact at these sizes."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (
            SELECT vec_id, p, any_value(v) AS v, min(struct_pack(d := d, j := j)) AS m FROM (
                SELECT x.vec_id, x.p, x.v, b.j, x.vv - 2 * list_inner_product(x.v, b.c) + list_inner_product(b.c, b.c) AS d
                FROM parts x JOIN b{k} b USING (p)) GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""
        b{k + 1} AS MATERIALIZED (
            SELECT b.p, b.j, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (
                SELECT p, j, list(floor(s / n) ORDER BY i) AS c FROM (
                    SELECT p, m.j AS j, i, sum(x) AS s, count(*) AS n FROM (
                        SELECT p, m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) GROUP BY p, m.j, i) GROUP BY p, j) n
            ON n.p = b.p AND n.j = b.j)""")
    return f"""
        WITH kept AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT *, list_inner_product(v, v) AS vv FROM (
                SELECT vec_id, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM kept, range(4) r(p))),
        b0 AS MATERIALIZED (
            SELECT p, j, v AS c FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j FROM parts) WHERE j < 256),
        {",".join(steps)},
        books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, j, i)) AS codebooks_sha256
                  FROM (SELECT p, j, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b{rounds})),
        coded AS (SELECT vec_id, string_agg(printf('%02x', m.j), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM coded JOIN kept USING (vec_id), books"""


QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_toxicity, op4_exact_dedup, op5_suffix_dedup,
                                 op6_lm_scoring, op7_license_scan, op8_packing, op9_sharding,
                                 op10_quality_rules, quality_ablations, op11_vector_codes, op12_periodic_runs, op13_lattice_dedup)}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
        t AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
        g AS (SELECT doc_id, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win FROM t),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g WHERE len(win) = 8) WHERE c > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT range AS k FROM range(8)) GROUP BY doc_id),
        l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        s AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, max(strlen(word)) AS longest FROM t GROUP BY doc_id),
        m AS (SELECT d.doc_id, coalesce(s.n_words, 0) AS n_words, CAST(coalesce(s.word_chars, 0) AS BIGINT) AS word_chars,
                     CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                     coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                     coalesce(l.n_lines, 0) AS n_lines, coalesce(s.longest, 0) AS longest
              FROM d LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
                     CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 40 * n_words)::INT
                     + 8 * (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::INT + 16 * (n_words >= 20 AND word_chars < 2 * n_words)::INT
                     + 32 * (n_words >= 20 AND word_chars > 15 * n_words)::INT + 64 * (longest > 1000)::INT AS BIGINT) AS failed_rules FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rules = 0 AS kept, failed_rules FROM f""",
    "op11_vector_codes": _lloyd_sql(),
    "op13_lattice_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        links AS MATERIALIZED (
            SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.w FROM reach JOIN links ON links.u = reach.r),
        comp AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id),
        n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(comp.component_id, e.vec_id) AS component_id,
               coalesce(comp.component_id, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN comp USING (vec_id)""",
}

_POLICY = ("pretraining", 2)
_BITS = ", ".join(f"('{r}', {quality_ledger.bit(r)})" for r in quality_ledger.POLICIES[_POLICY])
ORACLE["quality_ablations"] = f"""
    WITH ledger AS (SELECT failed_rules & {quality_ledger.mask(_POLICY)} AS m FROM ({ORACLE["op10_quality_rules"]})),
    rules AS (SELECT * FROM (VALUES {_BITS}) AS r(rule, b))
    SELECT rule, count(*) FILTER (WHERE m & b <> 0) AS n_failed, count(*) FILTER (WHERE m = b) AS n_only,
           count(*) FILTER (WHERE m & ~b = 0) AS kept_without
    FROM ledger, rules GROUP BY rule"""
