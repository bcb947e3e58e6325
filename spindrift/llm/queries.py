"""The contract queries opN_<name>: thin digests over the operators' own outputs, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, byte_cnn, decontaminate, html_tree, line_chunks, near_dedup, quality_rules, repeats, token_files, toxicity
from spindrift.llm.common import scratch, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("op1_html_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(table(spark, sf_dir, "pages"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token_files")
    token_files.write(table(spark, sf_dir, "documents"), vocabulary(), path)
    return token_files.read(spark, path)


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_words", "log_ratio", "marked")


@query("op4_line_chunks")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_decontaminate")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_repeats")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")


@query("op7_byte_cnn")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_cnn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_chunks")


@query(
    "op8_quality_rules",
    r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), x -> regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
    g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
    r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE c > 1) GROUP BY doc_id),
    m AS (
        SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
            (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
        FROM w LEFT JOIN r USING (doc_id)
    ),
    b AS (
        SELECT *, (n_words < 50) AS r0, (100 * n_repeat_words > 50 * n_words) AS r1, (10 * n_symbols > n_words) AS r2,
            (2 * n_dup_lines > n_lines) AS r3, (word_chars > 15 * n_words) AS r4, (word_chars < 2 * n_words) AS r5 FROM m
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed,
        NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5) AS kept,
        (r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT)::BIGINT AS fail_bits
    FROM b
    """,
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    led = quality_rules.apply_policy(quality_rules.apply_policy(led, "base", "passed"), "v2")
    return led.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "NOT passed AS base_failed", "kept", "fail_bits")


@query("op9_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


@query("op10_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())
