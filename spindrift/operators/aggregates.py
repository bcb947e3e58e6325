"""Counts, ordered lists and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_papers(edges: DataFrame, authors: DataFrame | None = None) -> DataFrame:
    """authorid, n_papers over the given authors only (all without)."""
    if authors is not None:
        edges = edges.join(authors.select("authorid").distinct(), "authorid", "left_semi")
    return edges.select("authorid", "paperid").distinct().groupBy("authorid").agg(F.count("paperid").alias("n_papers"))


def field_counts(edges: DataFrame, paper_fields: DataFrame, fields: DataFrame, level: int = 1, score: str | None = None) -> DataFrame:
    """authorid, fieldid, n: papers of each author in each field of a level, or the sum of a score."""
    wanted = fields.where(F.col("level") == level).select("fieldid")
    chain = edges.join(paper_fields, "paperid").join(wanted, "fieldid")
    return chain.groupBy("authorid", "fieldid").agg((F.sum(score) if score else F.count(F.lit(1))).alias("n"))


def ordered_list(rows: DataFrame, by: str, order: str, value: str, out: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return rows.groupBy(by).agg(F.transform(pairs, lambda s: s[value]).alias(out))


def joined_text(rows: DataFrame, by: list[str], order: str, value: str, out: str, separator: str = " . ") -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda s: s[value]), separator).alias(out))


def distribution(value: str, quantiles: tuple[float, ...] = (0.5, 0.9)) -> list[Column]:
    """min, mean, max and exact quantiles with linear interpolation."""
    c = F.col(value)
    return [F.min(c).alias("lo"), F.avg(c).alias("mean"), F.max(c).alias("hi"), *(F.percentile(c, q).alias(f"p{round(100 * q)}") for q in quantiles)]


def rate(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def pool_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").otherwise(">20")
