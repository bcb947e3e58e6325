"""Hand-derived vectors of name, institution, comparison and romanisation rules."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from spindrift.functions import cjk, compare, names
from spindrift.functions import institutions as inst
from spindrift.functions import vectors as V
from spindrift.sources import connectors as C
from spindrift.sources import tables, xlsx


def one(spark, f, *values):
    kinds = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([tuple(values)], kinds).select(f(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


@pytest.mark.parametrize(
    ("raw", "nn", "fl", "ws"),
    [
        ("José Armañá", "jose armana", "jose|armana", "armana jose"),
        ("Jean‐Luc Órban", "jean luc orban", "jean|orban", "jean luc orban"),
        ("Mira Q. Voss", "mira q. voss", "mira|voss", "mira q. voss"),
        ("Odo", "odo", "odo|odo", "odo"),
        ("", "", "|", ""),
        (" Lena   Brandt ", "lena brandt", "lena|brandt", "brandt lena"),
        ("Łucja Ørn-Weiß", "łucja ørn weiß", "łucja|weiß", "weiß ørn łucja"),
        ("\tAda Lund", " ada lund", "|lund", " ada lund"),
        (" Ada Lund", "ada lund", "ada|lund", "ada lund"),
        ("ΝΊΚΟΣ Dell", "νικοσ dell", "νικοσ|dell", "dell νικοσ"),
        ("İlke Tan", "ilke tan", "ilke|tan", "ilke tan"),
    ],
)
def test_name_keys(spark, raw, nn, fl, ws):
    assert one(spark, names.norm, raw) == nn
    assert one(spark, names.first_last, raw) == fl
    assert one(spark, names.word_set, raw) == ws


def test_titles_and_text(spark):
    for raw, want in [("Prof Ada Lund", "Ada Lund"), ("A/Prof. Ada Lund", "Ada Lund"), ("Adj Prof Ada Lund", "Ada Lund"), ("Emma Drew", "Emma Drew"), ("Dr Drew Hon", "Drew Hon")]:
        assert one(spark, names.strip_title, raw) == want
    assert one(spark, names.deinvert, json.dumps({"the": [0, 3], "cat": [1], "sat": [2]})) == "the cat sat the"
    for bad in ("{", "", "{}", None):
        assert one(spark, names.deinvert, bad) is None
    for raw in ("https://x/A12", "a12", "12"):
        assert one(spark, names.id_digits, raw) == "12"
    assert one(spark, names.clean_tokens, "Dr. Anna-Maria (Mia) Ruiz, Jr.") == ["anna", "maria", "ruiz"]


def test_institutions(spark):
    raw = "Institute of Things [999,DE], Other [1,FR]"
    assert one(spark, inst.host_name, raw) == "Institute of Things"
    assert one(spark, inst.host_country, raw) == "DE"
    assert one(spark, inst.host_country, "X [1,UK]") == "GB"
    for raw, want in [
        ("Regents of the University of Northfield - Ann Harbor", "University of Northfield - Ann Harbor"),
        ("Pebble Tech Research Corporation", "Pebble Tech"),
        ("The University of Central Lake Board of Trustees", "University of Central Lake"),
        ("Plain Foundation, Inc.", "Plain"),
    ]:
        assert one(spark, lambda x: inst.rewritten(x, "wrapper"), raw) == want
    assert one(spark, lambda x: inst.rewritten(x, "abbreviations"), "Rock Institute of Tech") == "Rock Institute of Technology"
    assert one(spark, lambda x: inst.rewritten(x, *inst.CANONICAL), "Pine State Univ University Park") == "Pine State University"
    assert one(spark, lambda x: inst.rewritten(x, "at"), "University of Hill at Dale") == "University of Hill Dale"
    assert one(spark, inst.truncations, "University of Hill Dale") == ["University of Hill"]
    assert one(spark, inst.campus_system, "SUNY at Rocky Brook") == ["Rocky Brook University", "SUNY Rocky Brook", "Rocky Brook College", "Rocky Brook"]
    assert one(spark, inst.keys_eu, "Universität Köln") == ["universität köln", "universitaet koeln", "universitat koln"]
    assert one(spark, inst.same_organisation, "Dale University", "dale university hospital") is True
    assert one(spark, inst.same_organisation, "Dale", "dale university") is False
    assert one(spark, lambda x: inst.rewritten(x, "academy"), "中国科学院大连化学物理研究所") == "大连化学物理研究所"


def test_comparison():
    nick = compare.nickname_table([["william", "Bill", "will"], ["anna", "ann"]])
    same = lambda a, b, **k: compare.names_match(a, b, nick, **k)
    assert same("Mira Voss", "Mira Q. Voss")
    assert same("Mira Voss", "Mira Jane Voss")
    assert not same("Mira Jane Voss", "Mira Kate Voss")
    assert same("李雷", "anything at all")
    assert same("Voss, Mira", "M. Voss")
    assert same("Bill Stone", "William Stone")
    assert not same("Anna Stone", "Bert Stone")
    assert same("Toledo‐Arana Ana", "Toledo Arana Ana")
    assert compare.fuzzy_ok("stone mira", "Mira Stone", nick)
    assert not same("Mira Voss", "Mira Q Voss", exact=True)
    assert same("Mira Ann Voss Lind", "ann voss") and not same("ann voss", "Mira Ann Voss Lind", exact=True)
    assert same("Mira Ann Voss", "Mira Voss") and same("Odo Berg; Mira Voss", "O. Berg") and not same("Odo Berg", "Bert Oberg")


def test_nickname_files(spark, tmp_path):
    (tmp_path / "names.csv").write_text("# groups\nKatherine, Kate ,kit\n\nkit,christopher\n", encoding="utf-8")
    nick = compare.nickname_table(compare.nickname_groups(spark, f"file://{tmp_path}/names.csv"))
    assert nick["kit"] == {"katherine", "kate", "kit", "christopher"} and "kit" in nick["kate"] and "christopher" not in nick["kate"]
    assert compare.names_match("Kate Stone", "Katherine Stone", nick) and not compare.names_match("Kate Stone", "Christopher Stone", nick)


def test_anchors(spark):
    f = lambda a, b: compare.anchored(F.split(a, " "), F.array_remove(F.split(b, " "), ""))
    assert one(spark, f, "sylvie lejeune", "e lejeune") is False
    assert one(spark, f, "harald a helfgott", "h a helfgott") is True
    assert one(spark, f, "anna ruiz", "") is True


def test_romanize():
    readings = {"李": ["li"], "雷": ["lei"], "吕": ["lv"], "欧": ["ou"], "阳": ["yang"], "明": ["ming"], "单": ["dan"]}
    got = cjk.romanize("李雷", readings)
    assert {"li lei", "lei li", "l li", "li l"} == set(got)
    assert {"lu ming", "lv ming", "lyu ming"} <= set(cjk.romanize("吕明", readings))
    assert {"ming ouyang", "ou yang ming"} <= set(cjk.romanize("欧阳明", readings))
    assert {"shan lei", "dan lei"} <= set(cjk.romanize("单雷", readings))
    assert cjk.romanize("明·雷", readings) == ["lei ming", "ming lei"]
    assert cjk.romanize(None, readings) == []


def test_vectors(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None)], "k string, vec array<double>")
    got = {r.k: (r.vec, r.ndoc) for r in V.centroids(rows, "k").collect()}
    assert got["a"][0] == pytest.approx([0.7071068, 0.7071068]) and got["a"][1] == 2
    assert got["z"][0] == [0.0, 0.0] and "n" not in got
    pair = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert pair.select(V.cosine(F.col("a"), F.col("b"))).first()[0] is None


def test_csv_and_rids(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿name,text\n"Voss, Mira","line one\nline ""two"""\nOdo,\n', encoding="utf-8")
    df = tables.with_rid(tables.csv(spark, str(tmp_path / "r.csv")))
    got = [tuple(r) for r in df.orderBy("rid").collect()]
    assert got == [(0, "Voss, Mira", 'line one\nline "two"'), (1, "Odo", None)]
    assert tables.optional_csv(spark, str(tmp_path / "none.csv"), "a string, b string").count() == 0
    tables.export_csv(df.orderBy("rid"), str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes().startswith(b"\xef\xbb\xbfrid,name,text")
    assert "error" in tables.peek(spark, [str(tmp_path / "no.parquet")])[0]


def test_sheet(spark, tmp_path):
    book = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>Mira </t></r><r><t>Voss</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>year</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2019.0</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    got = xlsx.read(spark, str(tmp_path / "b.xlsx"))
    assert got.columns == ["row_index", "name", "c1", "year"]
    assert [tuple(r) for r in got.collect()] == [(0, "Mira Voss", None, "2019")]


def test_connectors(spark, tmp_path):
    cache = C.Cache(str(tmp_path / "c.json"), keep_empty=False)
    client = C.Offline({("b", None): [{"id": "https://x/I1", "display_name": "B", "affiliations": ["I9"]}]})
    assert C.search(client, cache, [("a", "DE"), ("b", None)])[0]["display_name"] == "B"
    cache.save()
    assert C.Cache(str(tmp_path / "c.json")).get("b", None)
    assert C.Cache(str(tmp_path / "c.json")).get("a", "DE") is None
    replies = iter([(500, None, None), (429, 1, None), (200, None, [{"id": 1}])])
    assert C.Throttled(lambda q, cc: next(replies), sleep=lambda s: None).fetch("q", None) == [{"id": 1}]
    with pytest.raises(C.BudgetExhausted):
        C.Throttled(lambda q, cc: (429, 999, None), sleep=lambda s: None).fetch("q", None)
    assert C.host_confirmed([{"id": 1, "affiliations": []}, {"id": 2, "affiliations": ["I9"]}], "I9")[1] == "host"
    assert C.as_table(spark, cache).count() == 1


def test_swaps(spark):
    df = spark.createDataFrame([("半导体", "某某大学", 2001), ("某某大学", "半导体", 2019), (None, " ", None)], "a string, b string, y int")
    i, f = inst.swap_by_marks(F.col("a"), F.col("b"))
    assert [tuple(r) for r in df.select(i, f).collect()] == [("某某大学", "半导体"), ("某某大学", "半导体"), (None, None)]
    assert [r[0] for r in df.select(inst.swap_by_year(F.col("a"), F.col("b"), F.col("y"))).collect()] == ["半导体", "半导体", None]


def test_streaming(spark, tmp_path):
    from spindrift.streaming.roster import match_stream

    index = spark.createDataFrame([("exact", 1, "Mira Voss", "mira voss")], "kind string, authorid long, sci_name string, nn string")
    spark.createDataFrame([(0, "MIRA VOSS"), (1, "Odo")], "rid long, name string").write.parquet(str(tmp_path / "in"))
    stream = match_stream(spark, str(tmp_path / "in"), "rid long, name string", index)
    run = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.rid, r.authorid) for r in spark.table("found").collect()] == [(0, 1)]


def test_invert_within_the_row(spark):

    df = spark.createDataFrame([("b a  b",), ("",), ("x",), (None,)], "s string").select(names.invert(F.split("s", " ")).alias("m"))
    assert [r.m for r in df.collect()] == [{"a": [1], "b": [0, 3]}, None, {"x": [0]}, None]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_author_vectors_are_not_taken_apart(spark):
    from spindrift.functions.embed import HashEncoder, author_vectors

    edges = spark.createDataFrame([("A", 1), ("A", 2), ("A", 2), ("A", 3), ("B", 9)], "authorid string, paperid long")
    docs = spark.createDataFrame([(1, "en", "red fox runs"), (2, "en", "blue fish swims"), (3, "en", "red fox runs")], "paperid long, language string, doc string")
    got = author_vectors(edges, docs, HashEncoder, 2)
    rows = got.collect()
    mean = HashEncoder().encode(["red fox runs", "blue fish swims"]).mean(0)
    assert [(r.authorid, r.ndoc) for r in rows] == [("A", 2)]
    assert rows[0].vec == pytest.approx([float(x) / float((mean**2).sum() ** 0.5) for x in mean], abs=1e-6)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
