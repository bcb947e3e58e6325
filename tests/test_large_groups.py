"""Names that many rows and authors share: nothing as large as their pairs is stored, and pairs are made in many tasks."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import evaluation as E
from spindrift.operators import linkage as L
from spindrift.plans import funnel
from spindrift.session import EU

ROWS, AUTHORS = 100, 400


@pytest.fixture(scope="module")
def tables(spark):
    people = spark.range(AUTHORS).select((F.col("id") + 1).alias("authorid"), F.lit("Ana Bell").alias("display_name"), F.lit('["Bell Ana", "ANA BELL"]').alias("display_name_alternatives"))
    edges = people.select("authorid", (F.col("authorid") * 10).alias("paperid"), F.col("authorid").alias("institutionid"))
    # every fourth row has no host
    roster = spark.range(ROWS).select(F.col("id").alias("rid"), F.lit("Ana Bell").alias("name"), F.when(F.col("id") % 4 != 0, F.col("id") + 1).alias("host_id"))
    vectors = people.select("authorid", F.array(F.lit(0.0), F.lit(1.0)).alias("vec"))
    return roster, people, edges, vectors, roster.select("rid", F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))


def test_layers_stay_small(spark, tables, monkeypatch):
    roster, people, edges, av, rv = tables
    sizes = []

    def counted(df, store=funnel.layer):
        out = store(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(funnel, "layer", counted)
    monkeypatch.setattr(L, "layer", counted, raising=False)
    out = funnel.run(EU, roster, people, people, edges, edges, av, rv)
    final = {r.rid: (r.authorid, r.source) for r in out.final.collect()}
    assert final == {i: (i + 1, "round2_inst") if i % 4 else (1, "round4_maxpapers") for i in range(ROWS)}
    assert max(sizes) <= 4 * AUTHORS < ROWS * AUTHORS
    assert out.candidates.count() == 3 * ROWS * AUTHORS
    assert {r.pool for r in out.pools().collect()} == {AUTHORS}


def test_two_layer_stays_small(spark, tables, monkeypatch):
    roster, people, edges, _, _ = tables
    sizes = []

    def counted(df, store=funnel.layer):
        out = store(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(funnel, "layer", counted)
    monkeypatch.setattr(L, "layer", counted, raising=False)
    got = funnel.two_layer(L.roster_keys(roster), L.author_keys(people), L.alias_keys(people), roster.select("rid", "host_id"), edges, edges)
    assert {r.rid: r.authorid for r in got.collect()} == {i: i + 1 for i in range(ROWS) if i % 4}
    assert max(sizes) <= 4 * AUTHORS < ROWS * AUTHORS


def test_pairs_are_made_in_many_tasks(spark, tables):
    roster, people, _, _, _ = tables
    rk, ak, alk = L.roster_keys(roster), L.author_keys(people), L.alias_keys(people)
    least = 8 * spark.sparkContext.defaultParallelism
    for found, n in ((L.key_join(rk, ak, "nn", "exact"), 1), (L.alias_match(rk, alk), 2), (L.or_equi_join(rk, alk.withColumnsRenamed({"nn": "x", "ws": "y"}), [("ws", "y"), ("nn", "x")], by_name=True), 2)):
        rows = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()
        assert found.rdd.getNumPartitions() >= least
        assert sum(r.n for r in rows) == n * ROWS * AUTHORS and len(rows) > 1
        assert found.distinct().count() == n * ROWS * AUTHORS


def test_classes_answer_for_their_rows(spark, tables):
    roster, people, _, _, _ = tables
    found = L.Candidates(L.roster_keys(roster), L.author_keys(people), L.alias_keys(people))
    lists, gold = found.lists().withColumnRenamed("cid", "rid"), roster.select("rid", (F.col("rid") + 1).alias("authorid"))
    assert lists.count() == AUTHORS
    rows = lists.withColumn("n", F.col("authorid"))
    assert E.filter_sweep(rows, "n", [20, 500], "n", gold, found.members).collect() == E.filter_sweep(found.pairs().select("rid", "authorid").distinct().withColumn("n", F.col("authorid")), "n", [20, 500], "n", gold).collect()
    assert found.among(gold).count() == ROWS
