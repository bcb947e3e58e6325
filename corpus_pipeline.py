"""From raw documents to token ids: quality, line dedup, near-duplicates, decontamination, BPE.

Every stage is (spark, docs, sf_dir) -> DataFrame over all that the stage before kept; all but the last return the
columns of documents.  `run` writes each stage's result as Parquet in the shared folder and reads it again, so a lost
executor repeats a stage's task and never an earlier stage.

Null texts count as empty; empty and repeated rows and extra columns pass through every stage that doesn't drop the
document; an empty table gives an empty table.  Decisions about near duplicates and benchmark items name documents by
doc_id: they hold for all rows of that id, and rows without an id can't be named and stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, byte_cnn, decontaminate, line_chunks, near_dedup
from spindrift.llm.common import table, written
from spindrift.llm.queries import vocabulary

#: Documents with less probability of good quality go.
LEAST_QUALITY = 0.5
#: Jaccard similarity of 5-word shingles, in percent, from which documents are near duplicates.
NEAR_PERCENT = 80
#: Most bytes of encoded runs that a worker keeps and of text that it encodes at once: executors still hold what earlier
#: stages took.
RUN_STORE, SLICE_BYTES = 24 << 20, 1 << 20


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs whose doc_id isn't in gone (doc_id), which is broadcast only while it is small."""
    gone = written(gone.select("doc_id").distinct(), "gone")
    return docs.join(line_chunks.sent_or_shuffled(gone, 16), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the byte-level classifier rejects."""
    scored = byte_cnn.with_scores(docs, *byte_cnn.fitted(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated passages; a document of which no word is left stood elsewhere, line by line, and goes."""
    out = line_chunks.remove_repeated_passages(docs)
    out = out.where((F.col("n_removed_lines") == 0) | F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest doc_id."""
    found = near_dedup.near_duplicates(docs, NEAR_PERCENT)
    return without(docs, found.where(~F.col("kept")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return without(docs, decontaminate.leaks(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of what is left."""
    return bpe.round_trip(docs, vocabulary(), with_ids=True, run_store=RUN_STORE, slice_bytes=SLICE_BYTES)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("tokens", tokens)]

#: SQL can express neither a trained network nor byte-pair encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
