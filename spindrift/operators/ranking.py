"""Top-k, arg-max, keep-first, filter-or-all and samples, all with explicit orders so that results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rk") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def keep_first(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_k(rows, by, order, 1, "__rk").drop("__rk")


def share(rows: DataFrame, by: str, n: str) -> Column:
    return F.col(n) / F.sum(n).over(Window.partitionBy(by))


def filter_or_all(rows: DataFrame, by: list[str], keep: Column) -> DataFrame:
    """Rows for which keep holds; a group in which no row passes stays whole."""
    passes = F.coalesce(keep, F.lit(False))
    return rows.withColumn("__p", passes).withColumn("__any", F.max("__p").over(Window.partitionBy(*by))).where(F.col("__p") | ~F.col("__any")).drop("__p", "__any")


def top_two_gap(rows: DataFrame, by: str, n: str, gap: str = "margin") -> DataFrame:
    """by, gap: the largest value less the second; a group of one has its value.  Two values a group leave the map side."""
    best = top_k(rows.select(by, n), [by], [F.desc_nulls_last(n)], 2)
    return best.groupBy(by).agg((F.max(n) - F.coalesce(F.max(F.when(F.col("rk") == 2, F.col(n))), F.lit(0))).alias(gap))


def hashed(key: str, seed: int) -> Column:
    """A hash of seed and key that any engine can make."""
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by hash of the key and seed: the same rows at every partitioning."""
    return rows.withColumn("__h", hashed(key, seed)).orderBy("__h", key).limit(n).drop("__h")


def stratified_sample(rows: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """sizes[s] rows of each stratum s by hash; other strata go."""
    want = F.lit(0)
    for s, n in sizes.items():
        want = F.when(F.col(stratum) == s, F.lit(n)).otherwise(want)
    w = Window.partitionBy(stratum).orderBy(hashed(key, seed), key)
    return rows.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= want).drop("__rk")
