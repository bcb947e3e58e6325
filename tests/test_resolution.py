"""Institution resolution end to end over a small cache, and embedding of distinct texts."""

import numpy as np
from pyspark.sql import functions as F

from spindrift.functions.embed import HashEncoder, author_vectors, embed
from spindrift.operators import resolution as S
from spindrift.plans.funnel import swapped_roster
from spindrift.sources.connectors import RESULT


def test_chain_and_tiers(spark):
    hosts = spark.createDataFrame([("Regents of the University of Hill",), ("Pebble Tech",), ("Nowhere Ltd",), ("Alpha Tech",)], "name string")
    res = lambda i, shown, *more: [(f"https://x/{i}", shown, list(more), 1.0, None)]
    cache = spark.createDataFrame(
        [
            ("Regents of the University of Hill", "US", []),
            ("University of Hill", "US", res("I1", "University of Hill")),
            ("Pebble Tech", None, res("I2", "Something Else Entirely", "Pebble Technology")),
            ("Alpha Tech", "US", res("I3", "Alpha Tech Campus")),
        ],
        f"query string, cc string, results {RESULT}",
    )
    found = S.first_results(S.queries_of(hosts, "us", "US"), cache)
    got = {r.name: (r.id, r.method) for r in S.classify(found).collect()}
    assert got["Regents of the University of Hill"] == ("I1", "exact")
    assert got["Pebble Tech"] == ("I2", "exact")
    assert got["Alpha Tech"] == ("I3", "fuzzy")  # Jaccard 2/3, coverage 1
    assert got["Nowhere Ltd"] == (None, None)
    rows = spark.createDataFrame([(0, "Alpha Tech"), (1, "Beta"), (2, None), (3, "Late"), (4, "Fixed  Name")], "rid long, name string")
    out = S.row_lookup(rows, spark.createDataFrame([("fixed name", "I9")], "name string, id string"), S.classify(found), spark.createDataFrame([("Late",)], "name string"))
    assert {r.rid: (r.id, r.method) for r in out.collect()} == {0: ("I3", "fuzzy"), 1: (None, "none"), 2: (None, "none"), 3: (None, "pending"), 4: ("I9", "override")}


def test_bridge_keeps_filled_cells(spark):
    bridge = spark.createDataFrame([(0, "a", "I1"), (1, "a", None), (2, "b", None), (3, "c", None)], "row_id long, name string, host_id string")
    fix = lambda rows, key: spark.createDataFrame(rows, f"{key}, host_id string")
    after = S.finalise_bridge(bridge, fix([(0, "X"), (2, "R2")], "row_id long"), fix([("a", "N")], "name string"), fix([("c", "C")], "name string"))
    assert {r.row_id: (r.host_id, r.how) for r in after.collect()} == {0: ("I1", "kept"), 1: ("N", "name_override"), 2: ("R2", "row_override"), 3: ("C", "cached")}
    assert S.changed_cells(bridge, after).count() == 0


def test_embedding(spark):
    df = spark.createDataFrame([(0, "alpha beta"), (1, "alpha beta"), (2, " "), (3, None)], "k long, text string")
    got = {r.k: r.vec for r in embed(df, HashEncoder).collect()}
    assert got[0] == got[1] and abs(np.linalg.norm(got[0]) - 1) < 1e-5 and got[2] is None and got[3] is None
    edges = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("B", 9)], "authorid string, paperid long")
    papers = spark.createDataFrame([(1, "en", "first text here"), (2, "de", "zweiter Text hier"), (3, "en", "third text here"), (9, "en", "x")], "paperid long, language string, doc string")
    assert [(r.authorid, r.ndoc) for r in author_vectors(edges, papers, HashEncoder, 2).collect()] == [("A", 2)]


def test_swapped_roster(spark):
    rows = spark.createDataFrame([(0, "x", "光学", "某大学", 2001), (1, "y", None, " ", 2001), (2, "z", "某大学", "光学", 2019)], "rid long, name string, a string, b string, year int")
    assert [tuple(r) for r in swapped_roster(rows).orderBy("rid").collect()] == [(0, "x", "某大学", "光学"), (2, "z", "某大学", "光学")]
    assert [r.inst for r in swapped_roster(rows, True).where(F.col("rid") == 2).collect()] == ["光学"]
