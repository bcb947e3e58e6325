"""The funnel on a hand-written snapshot whose outcomes follow from the rules alone."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spindrift.functions import compare
from spindrift.operators.decisions import floor_split
from spindrift.plans import funnel
from spindrift.session import EU, RegionConfig

AUTHORS = [
    ("A1", "Mira Voss", "[]", 40, "I7"), ("A2", "Mira Q. Voss", "[]", 35, "I1"), ("A3", "José Armañá", "[]", 50, None), ("A4", "Jose Armana", "[]", 31, None),
    ("A5", "Lena Brandt", "[]", 45, "I2"), ("A6", "Lena Brandt", "[]", 60, "I2"), ("A7", "Lena Brandt", "[]", 12, "I3"), ("A8", "Tomo Hale", "[]", 10, None),
    ("A9", "I. Kern", '["Kern Ivo Pell"]', 33, None), ("A10", "Oda Ruiz", '["Oda Ruiz"]', 70, None), ("A11", "Wim Zeld", "[]", 44, "I4"), ("A12", "Oda Ruiz", "{bad", 32, None),
]
ROSTER = [(0, "Mira Voss", "I1"), (1, "Jose Armana", "I9"), (2, "Lena Brandt", "I2"), (3, "Tomo Hale", None), (4, "Pell Kern Ivo", None), (5, "Oda Ruiz", None), (6, "Wim de Zeld", "I4"), (7, "Noa Blank", "I1")]
SIMS = {"A3": 0.90, "A4": 0.50, "A5": 0.850, "A6": 0.855, "A10": 0.90, "A12": 0.60}


@pytest.fixture(scope="module")
def inputs(spark):
    people = spark.createDataFrame(AUTHORS, "authorid string, display_name string, display_name_alternatives string, n int, inst string")
    papers = people.select("authorid", F.explode(F.sequence(F.lit(1), "n")).alias("k")).select("authorid", F.concat("authorid", F.lit("-"), F.col("k").cast("string")).alias("paperid"))
    aff = people.select("authorid", F.concat("authorid", F.lit("-1")).alias("paperid"), F.col("inst").alias("institutionid"))
    roster = spark.createDataFrame(ROSTER, "rid long, name string, host_id string")
    av = spark.createDataFrame([(a, [s]) for a, s in SIMS.items()], "authorid string, vec array<double>")
    rv = spark.createDataFrame([(r[0], [1.0]) for r in ROSTER], "rid long, vec array<double>")
    return roster, people.select("authorid", "display_name"), people.select("authorid", "display_name_alternatives"), aff, papers, av, rv


def run(inputs, config=EU):
    return {r.rid: (r.authorid, r.match_type, r.source) for r in funnel.run(config, *inputs, same=compare.match_udf()).final.collect()}


def test_outcomes(inputs):
    assert run(inputs) == {
        0: ("A2", "fuzzy", "round2_inst"),
        1: ("A3", "exact", "round3_semantic"),
        2: ("A6", "exact", "round4_semtie"),
        3: ("A8", "exact", "name_unique"),
        4: ("A9", "alias", "round4_maxpapers"),
        5: ("A10", "exact", "round4_semtie"),
        6: ("A11", "fuzzy", "round2_inst"),
    }


def test_switches(inputs):
    assert run(inputs, replace(EU, dedupe_before_margin=True))[5] == ("A10", "exact", "round3_semantic")
    assert 4 not in run(inputs, replace(EU, use_alias=False))
    assert 6 not in run(inputs, replace(EU, use_fuzzy=False))
    assert RegionConfig("eu").from_env({"EU_PAPER_FLOOR": "7", "EU_USE_ALIAS": "0"}) == RegionConfig("eu", paper_floor=7, use_alias=False)


def test_without_hosts(spark, inputs):
    roster = inputs[0].withColumn("host_id", F.lit(None).cast("string"))
    got = run((roster, *inputs[1:]))
    assert got[0] == ("A1", "exact", "name_unique")
    assert got[6] == ("A11", "fuzzy", "round4_maxpapers")


def test_missing_scores_are_null(spark, inputs):
    nan = spark.createDataFrame([(a, [float("nan")]) for a in SIMS], "authorid string, vec array<double>")
    none = nan.limit(0)
    assert run((*inputs[:5], nan, inputs[6])) == run((*inputs[:5], none, inputs[6]))


def test_floor(inputs):
    final = funnel.run(EU, *inputs, same=compare.match_udf()).final
    matched, held = floor_split(final, 30)
    assert [r.rid for r in held.collect()] == [3] and matched.count() == 6
    assert floor_split(final, 0)[1].count() == 0
    assert "| name_unique | 1 | 1 |" in funnel.report(final, 30)
