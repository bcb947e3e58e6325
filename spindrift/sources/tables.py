"""Tables in and out: Parquet, CSV with stable row ids, optional sources, vector stores, single-file exports, peeks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header; all strings without a schema; quoted line ends and doubled quotes are understood, blanks are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", False).csv(path)
    return df.select(*(F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name.lstrip("﻿")) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema))


def with_rid(df: DataFrame, name: str = "rid") -> DataFrame:
    """0-based row numbers in file order.  Partition sizes are counted first, so no row moves to one place."""
    spark = df.sparkSession
    schema = T.StructType([T.StructField(name, T.LongType(), False), *df.schema.fields])
    return spark.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (x[1], *x[0])), schema)


def optional_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The file, or an empty table of the schema where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return csv(spark, path, schema)


def rows(spark: SparkSession, values: list[tuple], schema: str, view: str | None = None) -> DataFrame:
    df = spark.createDataFrame(values, schema)
    if view:
        df.createOrReplaceTempView(view)
    return df


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by a key, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def export_csv(df: DataFrame, path: str) -> None:
    """One UTF-8 file with a byte-order mark for spreadsheets; rows stream through the driver a partition at a time."""
    import csv as writer

    with Path(path).open("w", encoding="utf-8-sig", newline="") as f:
        out = writer.writer(f)
        out.writerow(df.columns)
        for row in df.toLocalIterator():
            out.writerow(["" if v is None else v for v in row])


def save_vectors(df: DataFrame, path: str) -> None:
    """(id, vec array<float>, ndoc) as the vector store."""
    df.select("id", F.col("vec").cast("array<float>").alias("vec"), "ndoc").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, vec array<float>, ndoc int").parquet(path)


def peek(spark: SparkSession, paths: list[str]) -> list[dict]:
    """For each file its rows, columns, types and first three rows; a file that can't be read says why."""
    out = []
    for p in paths:
        try:
            df = spark.read.parquet(p)
            out.append({"path": p, "rows": df.count(), "columns": df.dtypes, "first": [r.asDict() for r in df.limit(3).collect()]})
        except Exception as e:  # noqa: BLE001  a broken file must not hide the others
            out.append({"path": p, "error": str(e).splitlines()[0]})
    return out


def id_lookup(ids: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each id's digits with the table's row, with or without the address and letter before them, and found."""
    from spindrift.functions.names import id_digits
    from spindrift.operators.linkage import lookup

    own = ids.select(id_digits(F.col(ids.columns[0]).cast("string")).alias("id"))
    return lookup(own, table, id_digits(F.col(key).cast("string")), columns)
