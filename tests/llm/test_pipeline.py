"""The pipeline's stages in order, on the smallest documents and on edge cases."""

import re

import corpus_pipeline as p
from spindrift.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name != "tokens":
            assert docs.columns == columns
        sizes.append(docs.count())
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
    assert all(a >= b for a, b in zip(sizes, sizes[1:], strict=False)) and sizes[-1] > 0.5 * sizes[0]
    assert sizes[-1] == sizes[-2]


def test_edges(spark):
    line = "words that make a line of more than twenty words so that it is a passage by itself wherever it comes again in any text"
    rows = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, f"{line}\nalpha beta", "en", "s", 1), (3, f"gamma delta\n{line}", "en", "s", 1), (3, f"gamma delta\n{line}", "en", "s", 1), (None, line, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS score", "'y' AS gone", "'z' AS row")
    got = {name: sorted((str(r.doc_id), getattr(r, "text", None)) for r in stage(spark, docs, SF).collect()) for name, stage in p.STAGES}
    given = sorted((str(r[0]), r[1]) for r in rows)
    assert got["line_dedup"] == sorted((d, "gamma delta" if d == "3" else t) for d, t in given)
    assert got["near_duplicates"] == [x for x in given if x[0] != "3"] if shares(rows[2][1], rows[3][1]) >= 0.8 else given
    assert got["decontamination"] == given
    assert [d for d, _ in got["tokens"]] == [d for d, _ in given]
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def shares(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_run_equals_its_stages_and_brute_force(spark):
    """run() on the smallest tables: its rows are the stages' rows; near duplicates and leaks by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        docs = written(stage(spark, docs, SF), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r.ids_sha256 for r in p.run(spark, SF).collect()}
    assert got == {i: r.ids_sha256 for i, r in kept["tokens"].items()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for i, r in kept["line_dedup"].items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    lead = {i: i for i in sets}
    root = lambda i: i if lead[i] == i else root(lead[i])
    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                lead[max(a, b)] = min(a, b)
    assert set(kept["near_duplicates"]) == {i for i in sets if root(i) == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {i for i, r in kept["near_duplicates"].items() if any(t in (r.text or "") for t in items)}
    assert whole and not whole & set(kept["decontamination"])
