"""The linkage roles over the star-schema tables: authors are parts, papers orders, institutions suppliers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Roles:
    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def authors(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("authorid"), F.concat_ws(" ", "p_name", "p_brand").alias("display_name"))

    @property
    def details(self) -> DataFrame:
        """authorid and a JSON array of its words reversed and its upper case."""
        n = F.col("display_name")
        back = F.array_join(F.reverse(F.split(n, " ")), " ")
        return self.authors.select("authorid", F.to_json(F.array(back, F.upper(n))).alias("display_name_alternatives"))

    @property
    def papers(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_partkey").alias("authorid"), F.col("l_orderkey").alias("paperid"))

    @property
    def affiliations(self) -> DataFrame:
        first = self.table("lineitem").where("l_linenumber = 1")
        return first.select(F.col("l_partkey").alias("authorid"), F.col("l_orderkey").alias("paperid"), F.lit("first").alias("author_position"), F.col("l_suppkey").alias("institutionid"))

    @property
    def paper_fields(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("paperid"), F.col("o_orderpriority").alias("fieldid"))

    @property
    def fields(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderpriority").alias("fieldid")).distinct().withColumn("level", F.lit(1))

    @property
    def roster(self) -> DataFrame:
        """Every tenth part; its host is the least supplier of its own first lines."""
        own = self.authors.where("authorid % 10 = 0")
        hosts = self.affiliations.groupBy("authorid").agg(F.min("institutionid").alias("host_id"))
        return own.join(hosts, "authorid", "left").select((F.col("authorid") / 10).cast("long").alias("rid"), F.col("display_name").alias("name"), "host_id")

    @property
    def gold(self) -> DataFrame:
        return self.authors.where("authorid % 10 = 0").select((F.col("authorid") / 10).cast("long").alias("rid"), "authorid")

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")

    def vectors_of(self, ids: DataFrame, key: str, number) -> DataFrame:
        """key, vec: the unit vector that a number picks modulo how many there are (one row, counted)."""
        from spindrift.functions.vectors import unit

        n = self.vectors.count()
        return ids.select(key, (number % n).alias("vec_id")).distinct().join(self.vectors.select("vec_id", unit(F.col("vec")).alias("vec")), "vec_id").select(key, "vec")


#: The same roles as SQL common table expressions.
SQL_ROLES = """
authors AS (SELECT p_partkey AS authorid, p_name || ' ' || p_brand AS display_name FROM part),
papers AS (SELECT l_partkey AS authorid, l_orderkey AS paperid FROM lineitem),
aff AS (SELECT l_partkey AS authorid, l_orderkey AS paperid, l_suppkey AS institutionid FROM lineitem WHERE l_linenumber = 1),
hosts AS (SELECT authorid, min(institutionid) AS host_id FROM aff GROUP BY authorid),
roster AS (SELECT CAST(authorid // 10 AS BIGINT) AS rid, display_name AS name, host_id FROM authors LEFT JOIN hosts USING (authorid) WHERE authorid % 10 = 0),
gold AS (SELECT rid, rid * 10 AS authorid FROM roster),
pf AS (SELECT o_orderkey AS paperid, o_orderpriority AS fieldid FROM orders)"""


def sql_norm(x: str) -> str:
    return rf"regexp_replace(trim(lower(strip_accents(regexp_replace({x}, '[\x{{2D}}\x{{AD}}\x{{2010}}-\x{{2015}}\x{{2212}}]', ' ', 'g')))), '\s+', ' ', 'g')"


def sql_first_last(x: str) -> str:
    n = sql_norm(x)
    return f"regexp_extract({n}, '^([^ ]*)', 1) || '|' || regexp_extract({n}, '([^ ]*)$', 1)"


def sql_word_set(x: str) -> str:
    return f"array_to_string(list_sort(string_split({sql_norm(x)}, ' ')), ' ')"
