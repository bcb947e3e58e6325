"""Text vectors behind a small protocol: distinct texts are encoded once, in batches, by an encoder that each task loads."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Signed word hashing to unit vectors: stands in where no model is at hand; equal texts get equal vectors."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, texts):
        out = np.zeros((len(texts), self.size), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.size] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embed(rows: DataFrame, load: Callable[[], Encoder], text: str = "text", out: str = "vec", batch: int = 64) -> DataFrame:
    """rows with a vector of each text; null and blank texts get null.  load() runs once in a task."""

    def run(batches):
        model = load()
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(np.asarray(model.encode(part), np.float32)), pa.list_(pa.float32()))], names=["__t", out])

    distinct = rows.where(F.trim(text) != "").select(F.col(text).alias("__t")).distinct()
    return rows.join(distinct.mapInArrow(run, f"__t string, {out} array<float>"), F.col(text) == F.col("__t"), "left").drop("__t")


def author_vectors(edges: DataFrame, papers: DataFrame, load: Callable[[], Encoder], most: int = 30, language: str = "en") -> DataFrame:
    """authorid, vec, ndoc: the unit mean of at most `most` documents (by paper id) of one language for each author."""
    from spindrift.functions.vectors import length
    from spindrift.operators.ranking import top_k

    docs = papers.where(F.col("language") == language).where(F.length(F.trim("doc")) > 5).select("paperid", "doc")
    # edges without a document go before any are made distinct
    near = edges.select("authorid", "paperid").join(docs.select("paperid").distinct(), "paperid", "left_semi").distinct()
    capped = top_k(near.join(docs.select("paperid"), "paperid"), ["authorid"], [F.asc("paperid")], most)
    vectors = embed(docs.join(capped.select("paperid").distinct(), "paperid", "left_semi"), load, "doc")
    each = capped.select("authorid", "paperid").join(vectors.where("vec IS NOT NULL").select("paperid", "vec"), "paperid")
    # `most` bounds a group, so its vectors are gathered whole; taken apart by place they would be a row for each number
    groups = each.groupBy("authorid").agg(F.collect_list("vec").alias("vs"))
    mean = F.transform(F.get("vs", F.lit(0)), lambda _, i: F.aggregate("vs", F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size("vs"))
    means = groups.select("authorid", mean.alias("mean"), F.size("vs").cast("long").alias("ndoc"))
    sized = means.withColumn("__n", length(F.col("mean")))
    return sized.select("authorid", F.transform("mean", lambda x: x / F.when(F.col("__n") > 0, F.col("__n")).otherwise(1.0)).alias("vec"), "ndoc")
