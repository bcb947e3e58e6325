"""Dense vectors in arrays: dot products, centroids, prototypes, nearest labels, clusters.  No score is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a divided by its length; a zero vector stays."""
    return F.transform(a, lambda x: x.cast("double") / F.when(length(a) > 0, length(a)).otherwise(F.lit(1.0)))


def cosine(a: Column, b: Column) -> Column:
    """Null if either is null, zero or not a number."""
    n = length(a) * length(b)
    c = F.when(n > 0, dot(a, b) / n)
    return F.when(~F.isnan(c), c)


def centroids(rows: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """key, vec (mean, then unit length), ndoc.  Means are summed by place before the shuffle, so no group is gathered."""
    each = rows.where(F.col(vec).isNotNull()).select(key, F.posexplode(vec).alias("i", "x"))
    means = each.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    whole = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"), F.max("n").alias("ndoc"))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return whole.withColumn("__n", size).select(key, F.transform("vec", lambda x: x / F.when(F.col("__n") > 0, F.col("__n")).otherwise(1.0)).alias("vec"), "ndoc")


def nearest(rows: DataFrame, vocabulary: DataFrame, k: int = 1, key: str = "vec_id", limit: int = 100_000) -> DataFrame:
    """key, label, sim, rk: the k most similar entries of a vocabulary (label, vec) for each row.

    The vocabulary is a label set of checked size (limit entries); it is sent to the rows and a bounded top list is kept
    in each row, so nothing but the k entries leaves it.
    """
    from pyspark.sql import Window

    if vocabulary.limit(limit + 1).count() > limit:
        raise ValueError(f"the vocabulary has more than {limit} entries")
    words = F.broadcast(vocabulary.select(F.col("label"), F.col("vec").alias("__v")))
    scored = rows.select(key, "vec").join(words, F.lit(True)).select(key, "label", cosine(F.col("vec"), F.col("__v")).alias("sim"))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("sim"), "label")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def kmeans(rows: DataFrame, k: int, key: str = "vec_id", seed: int = 42, rounds: int = 60) -> DataFrame:
    """key, cluster: k-means++ on unit vectors by cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.where(length(F.col("vec")) > 0).select(key, array_to_vector(F.transform("vec", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine", initMode="k-means||").fit(data)
    return model.transform(data).select(key, F.col("prediction").alias("cluster"))


def leave_one_out(rows: DataFrame, group: str, key: str, exclude: str, vec: str = "vec") -> DataFrame:
    """key, vec: the unit prototype of each row's group without the rows of the same `exclude` value."""
    each = rows.select(key, group, exclude, F.posexplode(vec).alias("i", "x"))
    total = each.groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("t"))
    own = each.groupBy(group, exclude, "i").agg(F.sum(F.col("x").cast("double")).alias("o"))
    left = total.join(own, [group, "i"]).select(group, exclude, "i", (F.col("t") - F.col("o")).alias("x"))
    proto = left.groupBy(group, exclude).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    proto = proto.select(group, exclude, unit(F.col("vec")).alias("vec"))
    return rows.select(key, group, exclude).join(proto, [group, exclude])
