"""Queries of the diagnostics, the single-score funnel and the text functions, each with the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from spindrift.functions import institutions as inst
from spindrift.functions import names
from spindrift.functions import vectors as V
from spindrift.operators import aggregates as A
from spindrift.operators import diagnostics as X
from spindrift.operators import evaluation as E
from spindrift.operators import ranking as R
from spindrift.operators import resolution as S
from spindrift.plans import funnel
from spindrift.plans.queries import CAND, CENTROID, DOT, FUNNEL, GRID, KEYS, NP, ROW, VEC, layers, pool, roles
from spindrift.plans.registry import query
from spindrift.plans.views import SQL_ROLES, table
from spindrift.session import EU

FIELDS = """nf AS (SELECT authorid, fieldid, count(*) AS n FROM papers JOIN pf USING (paperid) GROUP BY ALL),
tf AS (SELECT *, row_number() OVER (PARTITION BY authorid ORDER BY n DESC, fieldid) AS rk FROM nf)"""


def top_fields(r, k: int):
    n = A.field_counts(r.papers, r.paper_fields, r.fields)
    return R.top_k(n, ["authorid"], [F.desc("n"), F.asc("fieldid")], k)


@query("resolvable_flag", f"WITH {SQL_ROLES} SELECT rid, authorid, authorid IN (SELECT authorid FROM aff) AS resolvable FROM gold")
def resolvable_flag(spark, sf_dir):
    r = roles(spark, sf_dir)
    return X.resolvable(r.gold, r.affiliations)


@query("host_survivor", f"WITH {FUNNEL} SELECT g.rid, g.authorid, EXISTS (SELECT 1 FROM cand c WHERE c.rid = g.rid AND c.authorid = g.authorid) AS in_pool, EXISTS (SELECT 1 FROM gated c WHERE c.rid = g.rid AND c.authorid = g.authorid) AS survives FROM gold g")
def host_survivor(spark, sf_dir):
    gold, out = roles(spark, sf_dir).gold, layers(spark, sf_dir)
    return X.host_survivors(gold, out.among(gold), out.gated)


@query("addressable", f"WITH {FUNNEL} SELECT g.rid, g.authorid FROM gold g WHERE EXISTS (SELECT 1 FROM gated c WHERE c.rid = g.rid AND c.authorid = g.authorid)")
def addressable(spark, sf_dir):
    return X.addressable(roles(spark, sf_dir).gold, layers(spark, sf_dir).gated)


@query("ceilings", f"WITH {FUNNEL} SELECT count(*) AS n_gold, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM cand c WHERE c.rid = g.rid AND c.authorid = g.authorid)) AS in_pool, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM gated c WHERE c.rid = g.rid AND c.authorid = g.authorid)) AS behind_gate, count(*) FILTER (WHERE fin.authorid = g.authorid) AS answered_right FROM gold g LEFT JOIN fin USING (rid)")
def ceilings(spark, sf_dir):
    gold, out = roles(spark, sf_dir).gold, layers(spark, sf_dir)
    return X.ceilings(gold, out.among(gold), out.gated, out.final)


@query("worklist", f"WITH {FUNNEL}, dc AS (SELECT rid, count(DISTINCT authorid) AS pool FROM cand GROUP BY rid) SELECT rid, pool, pool = 1 AS sole FROM dc WHERE rid NOT IN (SELECT rid FROM instu) AND rid NOT IN (SELECT rid FROM uniq)")
def worklist(spark, sf_dir):
    """What unique names and institutions leave open."""
    out = layers(spark, sf_dir)
    return X.worklist(roles(spark, sf_dir).roster, out.pools(), out.unique.select("rid").unionByName(out.institution.select("rid")))


@query("label_filter_sweep", f"WITH {KEYS}, {CAND}, {NP}, {FIELDS}, w AS (SELECT rid, fieldid FROM gold JOIN tf USING (authorid) WHERE rk = 1), x AS (SELECT cv.rid, cv.authorid, n_papers, k, coalesce(tf.rk <= k, false) AS ok FROM cv LEFT JOIN np USING (authorid) LEFT JOIN w USING (rid) LEFT JOIN tf ON tf.authorid = cv.authorid AND tf.fieldid = w.fieldid, unnest([1, 2, 3, 5]) t(k)), y AS (SELECT *, bool_or(ok) OVER (PARTITION BY k, rid) AS any_ok FROM x), z AS (SELECT * FROM y WHERE ok OR NOT any_ok QUALIFY row_number() OVER (PARTITION BY k, rid ORDER BY n_papers DESC NULLS LAST, authorid) = 1) SELECT k, count(*) AS n, count(*) FILTER (WHERE z.authorid = gold.authorid) AS correct FROM z JOIN gold USING (rid) GROUP BY k")
def label_filter_sweep(spark, sf_dir):
    r, lists, members = pool(spark, sf_dir)
    top = top_fields(r, 5).select("authorid", "fieldid", "rk")
    wanted = r.gold.join(top.where("rk = 1"), "authorid").select("rid", "fieldid")
    return X.label_filter_sweep(lists, top, wanted, A.distinct_papers(r.papers), r.gold, [1, 2, 3, 5], members)


FLIP = f"WITH {FUNNEL}, m AS (SELECT rid, authorid FROM scored LEFT JOIN np USING (authorid) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY coalesce(n_papers, 0) DESC, authorid) = 1), s AS (SELECT rid, authorid FROM scored QUALIFY row_number() OVER (PARTITION BY rid ORDER BY sim DESC, authorid) = 1)"


def two_answers(spark, sf_dir):
    r, scored = roles(spark, sf_dir), layers(spark, sf_dir).scored_papers
    n = scored.withColumn("n_papers", F.coalesce("n_papers", F.lit(0)))
    return r, R.keep_first(n, ["rid"], [F.desc("n_papers"), F.asc("authorid")]), R.keep_first(scored, ["rid"], [F.desc_nulls_last("sim"), F.asc("authorid")])


@query("answer_flips", FLIP + " SELECT count(*) FILTER (WHERE m.authorid = g.authorid AND s.authorid = g.authorid) AS kept_right, count(*) FILTER (WHERE m.authorid <> g.authorid AND s.authorid <> g.authorid) AS kept_wrong, count(*) FILTER (WHERE m.authorid <> g.authorid AND s.authorid = g.authorid) AS gained, count(*) FILTER (WHERE m.authorid = g.authorid AND s.authorid <> g.authorid) AS lost FROM gold g JOIN m USING (rid) JOIN s USING (rid)")
def answer_flips(spark, sf_dir):
    """From most papers to most similar."""
    r, papers, similar = two_answers(spark, sf_dir)
    return X.flips(papers, similar, r.gold)


@query("gold_margin", FLIP + " SELECT g.rid, CAST(coalesce(a.n_papers, 0) - coalesce(b.n_papers, 0) AS BIGINT) AS margin FROM gold g JOIN s USING (rid) LEFT JOIN np a ON a.authorid = g.authorid LEFT JOIN np b ON b.authorid = s.authorid WHERE s.authorid <> g.authorid")
def gold_margin(spark, sf_dir):
    r, _, similar = two_answers(spark, sf_dir)
    return X.gold_margin(A.distinct_papers(r.papers), similar, r.gold, "n_papers")


@query("recommended_cell", f"WITH {FUNNEL}, {GRID}, grid AS (SELECT CAST(t AS DOUBLE) AS threshold, CAST(m AS DOUBLE) AS margin, count(*) FILTER (WHERE s1 >= t AND (s2 IS NULL OR s2 < t OR round(s1 - s2, 9) >= m)) AS answered, count(*) FILTER (WHERE s1 >= t AND (s2 IS NULL OR s2 < t OR round(s1 - s2, 9) >= m) AND top = gold.authorid) AS correct FROM pr JOIN gold USING (rid), unnest([0.0, 0.2, 0.5]) a(t), unnest([0.0, 0.03]) c2(m) GROUP BY t, m) SELECT threshold, margin, answered, correct, round(correct / answered, 6) AS precision FROM grid WHERE answered > 0 AND correct / answered >= 0.1 ORDER BY answered DESC, correct / answered DESC, threshold, margin LIMIT 1")
def recommended_cell(spark, sf_dir):
    grid = E.threshold_grid(layers(spark, sf_dir).scored, roles(spark, sf_dir).gold, [0.0, 0.2, 0.5], [0.0, 0.03])
    return X.recommended(grid, 0.1).withColumn("precision", F.round("precision", 6))


@query("language_rules", "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share FROM n), h AS (SELECT 'floor' AS rule, CAST(f AS DOUBLE) AS value, lang, source FROM s, unnest([12, 20, 60]) t(f) WHERE n >= f UNION ALL SELECT 'share', CAST(f AS DOUBLE), lang, source FROM s, unnest([0.04, 0.06, 0.1]) t(f) WHERE share >= f) SELECT rule, value, source, min(lang) AS lang FROM h GROUP BY rule, value, source HAVING min(lang) = max(lang)")
def language_rules(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return X.language_rules(n, "source", "lang", "n", [12, 20, 60], [0.04, 0.06, 0.1])


@query("first_text", "SELECT source, arg_min(text, doc_id) AS text FROM documents WHERE text IS NOT NULL GROUP BY source")
def first_text(spark, sf_dir):
    return X.first_text(table(spark, sf_dir, "documents"), "source", "text", "doc_id")


@query("prototype_of", f"WITH {CENTROID}, e AS (SELECT vec_id, embedding, CASE WHEN vec_id % 3 = 0 THEN ' ' || upper(CAST(label AS VARCHAR)) END AS t FROM embeddings), k AS (SELECT e.vec_id, p.label FROM e JOIN proto p ON lower(trim(t)) = lower(CAST(p.label AS VARCHAR))), s AS (SELECT vec_id, p.label, {DOT.format(a='e.embedding', b='p.vec')} / sqrt({DOT.format(a='e.embedding', b='e.embedding')}) AS sim FROM e, proto p WHERE vec_id NOT IN (SELECT vec_id FROM k)) SELECT vec_id AS rid, CAST(label AS VARCHAR) AS label, NULL::DOUBLE AS sim FROM k UNION ALL SELECT vec_id, CAST(label AS VARCHAR), round(sim, 6) FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1")
def prototype_of(spark, sf_dir):
    v = roles(spark, sf_dir).vectors.withColumn("label", F.col("label").cast("string"))
    named = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit(" "), F.upper("label")))
    rows = v.select(F.col("vec_id").alias("rid"), named.alias("field_text"), "vec")
    return X.prototype_of(rows, V.centroids(v, "label")).withColumn("sim", F.round("sim", 6))


V1 = f"""{FIELDS}, fv AS (SELECT authorid, vec FROM tf, cnt JOIN uv ON vec_id = (ascii(fieldid) - 48) * 7 % c WHERE rk <= 3), open_rows AS ("""
FUNNEL_V1 = FUNNEL.replace("open_rows AS (", V1).replace(
    f"scored AS (SELECT o.*, {DOT.format(a='a.vec', b='r.vec')} AS sim FROM open_rows o, cnt JOIN uv a ON a.vec_id = (o.authorid // 3) % c JOIN uv r ON r.vec_id = (o.rid * 10 // 3) % c)",
    f"best AS (SELECT p.rid, p.authorid, max({DOT.format(a='fv.vec', b='r.vec')}) AS sim FROM (SELECT DISTINCT rid, authorid FROM open_rows) p JOIN fv USING (authorid), cnt JOIN uv r ON r.vec_id = (p.rid * 10 // 3) % c GROUP BY ALL), scored AS (SELECT o.*, coalesce(best.sim, -1) AS sim FROM open_rows o LEFT JOIN best USING (rid, authorid))",
).replace("sim >= 0.8", "sim >= 0.1").replace(">= 0.01)", ">= 0.03)")


@query("funnel_v1", f"WITH {FUNNEL_V1} SELECT {ROW}, n_papers FROM fin")
def funnel_v1(spark, sf_dir):
    """The funnel by the most similar of an author's three commonest fields."""
    r = roles(spark, sf_dir)
    t = top_fields(r, 3)
    fv = r.vectors_of(t.select("fieldid").distinct(), "fieldid", (F.ascii("fieldid") - 48) * 7)
    rv = r.vectors_of(r.roster, "rid", (F.col("rid") * 10 / 3).cast("long"))
    config = replace(EU, score="v1", sem_thresh_v1=0.1)
    return funnel.run(config, r.roster, r.authors, r.details, r.affiliations, r.papers, None, rv, author_fields=t.select("authorid", "fieldid"), field_vectors=fv).final


FUNNEL_BACK = FUNNEL.replace("JOIN uv a ON a.vec_id = (o.authorid // 3) % c", "JOIN uv a ON a.vec_id = CASE WHEN o.authorid % 2 = 0 THEN (o.authorid // 3) % c ELSE (o.authorid + 1) % c END")


@query("funnel_fallback_vectors", f"WITH {FUNNEL_BACK} SELECT {ROW}, n_papers FROM fin")
def funnel_fallback_vectors(spark, sf_dir):
    """Authors without documents are scored by another vector."""
    r = roles(spark, sf_dir)
    own = r.vectors_of(r.authors.where("authorid % 2 = 0"), "authorid", (F.col("authorid") / 3).cast("long"))
    back = r.vectors_of(r.authors, "authorid", F.col("authorid") + 1)
    rv = r.vectors_of(r.roster, "rid", (F.col("rid") * 10 / 3).cast("long"))
    return funnel.run(EU, r.roster, r.authors, r.details, r.affiliations, r.papers, own, rv, fallback_vectors=back).final


# ---- text functions -------------------------------------------------------------------------------------------------------------


@query("override_keys", r"SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   ' || p_brand, '\s+', ' ', 'g'))) AS us, replace(replace(regexp_replace(p_name || '（' || p_brand || '）', '\s+', '', 'g'), '（', '('), '）', ')') AS cn FROM part")
def override_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", inst.override_key(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_brand")).alias("us"), inst.override_key(F.concat("p_name", F.lit("（"), "p_brand", F.lit("）")), "cn").alias("cn"))


@query("swapped_columns", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '大学' ELSE c_mktsegment END AS inst, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS field, CASE WHEN c_custkey % 5 < 2 THEN c_name ELSE c_mktsegment END AS by_year FROM customer")
def swapped_columns(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    b = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("大学"))).otherwise(F.col("c_name"))
    own, field = inst.swap_by_marks(F.col("c_mktsegment"), b)
    year = F.lit(2019) + F.col("c_custkey") % 5
    return c.select("c_custkey", own.alias("inst"), field.alias("field"), inst.swap_by_year(F.col("c_mktsegment"), F.col("c_name"), year).alias("by_year"))


@query("swapped_roster", "SELECT c_custkey AS rid, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS inst, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS field FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def swapped_roster(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("rid"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(" ").alias("a"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("b"), F.lit(2020).alias("year"))
    return funnel.swapped_roster(rows)


@query("same_organisation", "SELECT s_suppkey, s_suppkey % 2 = 0 AS same FROM supplier")
def same_organisation(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    shown = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("The "), "s_name", F.lit(", Inc"))).otherwise("Elsewhere")
    return s.select("s_suppkey", inst.same_organisation(F.upper("s_name"), shown).alias("same"))


@query("region_spellings", "SELECT s_suppkey, 'University of ' || s_name AS us, 'Universität ' || s_name AS eu, s_name AS aus, s_name AS cn FROM supplier")
def region_spellings(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), F.col("s_name")
    first = lambda x, region: F.element_at(inst.variants(x, region), 1)
    return s.select(
        "s_suppkey", first(F.concat(F.lit("Board of Trustees of the University of "), n, F.lit(", Research Foundation, Inc.")), "us").alias("us"),
        F.element_at(inst.variants(F.concat(F.lit("Universitaet "), n), "eu"), 1).alias("eu"), first(F.concat(F.lit("The "), n), "aus").alias("aus"), first(F.concat(F.lit("中国科学院"), n), "cn").alias("cn"),
    )


@query("norm_periods", r"SELECT p_partkey, lower(replace(p_name, ' ', '. ')) AS dotted, lower(p_name) AS nn FROM part")
def norm_periods(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(". ")).alias("x"))
    return p.select("p_partkey", F.lower("x").alias("dotted"), names.norm(F.col("x"), strip_periods=True).alias("nn"))


@query("row_lookup", "SELECT s_suppkey AS rid, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'O' || s_suppkey WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'H' || s_suppkey END AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'none' WHEN s_suppkey % 5 = 0 THEN 'override' WHEN s_suppkey % 3 = 0 THEN 'pending' WHEN s_suppkey % 2 = 0 THEN 'exact' ELSE 'none' END AS method FROM supplier")
def row_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rid"), F.col("s_name").alias("name"))
    tag = lambda t: F.concat(F.lit(t), F.col("rid").cast("string")).alias("id")
    rows = s.select("rid", F.when(F.col("rid") % 7 != 0, F.col("name")).alias("name"))
    return S.row_lookup(rows, s.where("rid % 5 = 0").select(F.upper("name").alias("name"), tag("O")), s.where("rid % 2 = 0").select("name", tag("H"), F.lit("exact").alias("method")), s.where("rid % 3 = 0").select("name"))


@query("first_results", "SELECT s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'plain' WHEN s_suppkey % 3 = 0 THEN 'country' END AS found FROM supplier")
def first_results(spark, sf_dir):
    """The step of the fallback chain that answers: with the country, without, else nothing."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    hosts = s.select(F.col("s_name").alias("name"), F.lit("DE").alias("cc"))
    got = lambda w, cc, tag: s.where(w).select(F.col("s_name").alias("query"), F.lit(cc).cast("string").alias("cc"), F.array(F.lit(tag)).alias("results"))
    cache = got("s_suppkey % 2 = 0", None, "plain").unionByName(got("s_suppkey % 6 = 3", "DE", "country")).unionByName(s.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("query"), F.lit("DE").alias("cc"), F.array().cast("array<string>").alias("results")))
    out = S.first_results(S.queries_of(hosts, "eu"), cache)
    return out.join(s, F.col("name") == F.col("s_name")).select(F.col("s_suppkey").alias("name"), F.try_element_at("results", F.lit(1)).alias("found"))
