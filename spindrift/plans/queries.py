"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import compare, names
from spindrift.functions import institutions as inst
from spindrift.functions import vectors as V
from spindrift.operators import aggregates as A
from spindrift.operators import decisions as D
from spindrift.operators import evaluation as E
from spindrift.operators import linkage as L
from spindrift.operators import ranking as R
from spindrift.operators import resolution as S
from spindrift.plans import funnel
from spindrift.plans.registry import query
from spindrift.plans.views import SQL_ROLES, Roles, sql_first_last, sql_norm, sql_word_set, table
from spindrift.session import EU, layer, shared_dir

N, FL, WS = sql_norm, sql_first_last, sql_word_set
WITH = f"WITH {SQL_ROLES}"
KEYS = f"""{SQL_ROLES},
ak AS (SELECT authorid, display_name AS sci_name, {N("display_name")} AS nn, {WS("display_name")} AS ws, {FL("display_name")} AS fl FROM authors),
al AS (SELECT authorid, unnest([array_to_string(list_reverse(string_split(display_name, ' ')), ' '), upper(display_name)]) AS sci_name FROM authors),
alk AS (SELECT authorid, sci_name, {N("sci_name")} AS nn, {WS("sci_name")} AS ws FROM al),
rk AS (SELECT rid, name, host_id, {N("name")} AS nn, {WS("name")} AS ws, {FL("name")} AS fl FROM roster),
ex AS (SELECT rid, name, authorid, sci_name, 'exact' AS match_type FROM rk JOIN ak USING (nn)),
ali AS (SELECT DISTINCT rid, name, authorid, sci_name, 'alias' AS match_type FROM rk, alk WHERE rk.nn = alk.nn OR rk.ws = alk.ws),
ea AS (SELECT * FROM ex UNION ALL SELECT * FROM ali)"""


def roles(spark: SparkSession, sf_dir: str) -> Roles:
    return Roles(spark, sf_dir)


def keys(spark, sf_dir):
    r = roles(spark, sf_dir)
    return r, L.roster_keys(r.roster), L.author_keys(r.authors), L.alias_keys(r.details)


def pool(spark, sf_dir) -> tuple[Roles, DataFrame, DataFrame]:
    """The exact and alias candidates (rid, authorid) of classes of rows, the class in rid, and members (rid, cid)."""
    r, rk, ak, alk = keys(spark, sf_dir)
    found = L.Candidates(rk, ak, alk)
    return r, found.lists().withColumnRenamed("cid", "rid"), found.members


def pair_of(a: str, b: str, c: str) -> str:
    return f"{a} {b} {c}"


# ---- sources, projections, predicates -------------------------------------------------------------------------------


@query("scan_project_filter", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_shipdate < TIMESTAMP '1999-01-01'")
def scan_project_filter(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where((F.col("l_quantity") >= 45) & (F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp"))).select("l_orderkey", "l_partkey", "l_quantity")


@query("row_numbers", "SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS rid, r_name FROM region")
def row_numbers(spark, sf_dir):
    from spindrift.sources.tables import with_rid

    return with_rid(table(spark, sf_dir, "region").select("r_name"))


@query("literal_sets", "SELECT n_nationkey, n_name, n_name IN ('NATION_1', 'NATION_3') AS listed, CASE WHEN n_regionkey = 0 THEN 'home' ELSE 'away' END AS tag FROM nation WHERE n_name IS NOT NULL AND n_name <> ''")
def literal_sets(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where(F.col("n_name").isNotNull() & (F.col("n_name") != ""))
    return n.select("n_nationkey", "n_name", F.col("n_name").isin("NATION_1", "NATION_3").alias("listed"), F.when(F.col("n_regionkey") == 0, "home").otherwise("away").alias("tag"))


@query("exists_semi", "SELECT o_orderkey, o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 1 AND l.l_quantity > 40)")
def exists_semi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey", "left_semi")


@query("not_in_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def not_in_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("in_or_in", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) OR l_suppkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def in_or_in(spark, sf_dir):
    ids = table(spark, sf_dir, "part").where("p_size = 7").select("p_partkey")
    return L.in_either(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_partkey", "l_suppkey", ids)


@query(
    "text_ladder",
    "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN trim(o_orderpriority) END, CASE WHEN o_orderkey % 3 = 0 THEN 'T' || (CASE WHEN o_orderkey % 2 = 0 THEN ' | ' || o_orderstatus ELSE '' END) END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, 'D') AS field_text FROM orders",
)
def text_ladder(spark, sf_dir):
    k = F.col("o_orderkey")
    blank = lambda c, x: F.when(c, x).otherwise(F.lit("  "))
    return table(spark, sf_dir, "orders").select("o_orderkey", names.title_then_program(blank(k % 4 == 0, F.col("o_orderpriority")), blank(k % 3 == 0, F.lit("T")), blank(k % 2 == 0, F.col("o_orderstatus")), F.lit("D")).alias("field_text"))


@query(
    "panel_text",
    r"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace('PE' || p_size || ' - ' || p_type, '^[A-Z]{2}[0-9]+\s*-\s*', '') ELSE regexp_replace(p_name || ' (LS)', '\s*\([A-Z]{2}\)\s*$', '') END AS field_text, regexp_replace(p_size || ' - ' || p_type, '^[0-9]+\s*-\s*', '') AS label_text FROM part",
)
def panel_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    panel = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("PE"), F.col("p_size"), F.lit(" - "), F.col("p_type"))).otherwise("-")
    return p.select("p_partkey", names.panel_text(panel, F.concat(F.col("p_name"), F.lit(" (LS)"))).alias("field_text"), names.field_code_text(F.lit(" "), F.concat(F.col("p_size"), F.lit(" - "), F.col("p_type"))).alias("label_text"))


@query("event_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def event_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---- name keys --------------------------------------------------------------------------------------------------------


def words_sql(n: int) -> str:
    return f"SELECT doc_id, array_to_string(string_split_regex(trim(text), '\\s+')[1:{n}], ' ') AS name FROM documents"


NAMES = "names AS (SELECT doc_id, text AS name FROM documents)"


def doc_names(spark, sf_dir) -> DataFrame:
    """Names as hard as texts get: every whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"))


@query("norm_key", f"WITH {NAMES} SELECT doc_id, {N('name')} AS nn FROM names")
def norm_key(spark, sf_dir):
    return doc_names(spark, sf_dir).select("doc_id", names.norm(F.col("name")).alias("nn"))


@query("fl_key", f"WITH {NAMES} SELECT doc_id, {FL('name')} AS fl FROM names")
def fl_key(spark, sf_dir):
    return doc_names(spark, sf_dir).select("doc_id", names.first_last(F.col("name")).alias("fl"))


@query("wset_key", f"WITH {NAMES} SELECT doc_id, {WS('name')} AS ws FROM names")
def wset_key(spark, sf_dir):
    return doc_names(spark, sf_dir).select("doc_id", names.word_set(F.col("name")).alias("ws"))


TITLED = "titled AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'A/Prof. ' WHEN 1 THEN 'Adj Prof ' WHEN 2 THEN 'Dr ' WHEN 3 THEN 'Emma ' ELSE 'hon. assoc ' END || p_name AS name FROM part)"
TITLE_RE = r"^(?:(?:" + "|".join(names.TITLES) + r")\.?\s+)+"


@query("strip_title", f"WITH {TITLED} SELECT p_partkey, regexp_replace(name, '{TITLE_RE}', '', 'i') AS name FROM titled")
def strip_title(spark, sf_dir):
    prefix = F.element_at(F.array(*map(F.lit, ["A/Prof. ", "Adj Prof ", "Dr ", "Emma ", "hon. assoc "])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.strip_title(F.concat(prefix, F.col("p_name"))).alias("name"))


MESSY = "messy AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Dr. ' || p_name || ' (Nick)' WHEN 1 THEN p_name || ', Jr.' WHEN 2 THEN 'Prof ' || replace(p_name, ' ', '-') || ' nee ' || p_type ELSE p_type || p_name END AS name FROM part)"
CLEAN = r"list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(name, '\([^)]*\)', ' ', 'g'))), '[\x{2D}\x{AD}\x{2010}-\x{2015}\x{2212}]', ' ', 'g'), '\b(?:dr|prof|professor|mr|mrs|ms|ing)\b\.?', ' ', 'g'), '\b(?:geb|geborne|geborene|ep|epouse|nee|verw)\b\.?', ' ', 'g'), '\b(?:jr|sr|ii|iii|iv)\b', ' ', 'g'), '[,.]', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda x: x <> '')"


def messy(spark, sf_dir):
    n, t, k = F.col("p_name"), F.col("p_type"), F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Dr. "), n, F.lit(" (Nick)"))).when(k == 1, F.concat(n, F.lit(", Jr."))).when(k == 2, F.concat(F.lit("Prof "), F.replace(n, F.lit(" "), F.lit("-")), F.lit(" nee "), t)).otherwise(F.concat(t, n))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))


@query("clean_tokens", f"WITH {MESSY} SELECT p_partkey, array_to_string({CLEAN}, '|') AS tokens, array_to_string(list_reverse({CLEAN}), ' ') AS turned FROM messy")
def clean_tokens(spark, sf_dir):
    t = names.clean_tokens(F.col("name"))
    return messy(spark, sf_dir).select("p_partkey", F.array_join(t, "|").alias("tokens"), names.reversed_name(F.array_join(t, " ")).alias("turned"))


@query("surname_candidates", f"WITH {MESSY}, t AS (SELECT p_partkey, {CLEAN} AS t FROM messy) SELECT DISTINCT p_partkey, unnest(list_distinct(list_filter([t[len(t)], CASE WHEN len(t) > 1 THEN t[len(t) - 1] END, t[1]], lambda x: x IS NOT NULL))) AS surname FROM t")
def surname_candidates(spark, sf_dir):
    return messy(spark, sf_dir).select("p_partkey", F.explode(names.surname_candidates(names.clean_tokens(F.col("name")))).alias("surname"))


@query("camel_split", rf"SELECT p_partkey, {N(r'''regexp_replace(p_name || upper(p_brand[1:1]) || lower(p_brand[2:]) || 'McNeil', '(\p{Ll})(\p{Lu})', '\1 \2', 'g')''')} AS name FROM part")
def camel_split(spark, sf_dir):
    b = F.col("p_brand")
    joined = F.concat(F.col("p_name"), F.upper(F.substring(b, 1, 1)), F.lower(F.substring(b, 2, 100)), F.lit("McNeil"))
    return table(spark, sf_dir, "part").select("p_partkey", names.norm(names.camel_split(joined)).alias("name"))


@query("id_digits", "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS d1, CAST(s_suppkey AS VARCHAR) AS d2 FROM supplier")
def id_digits(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.id_digits(F.concat(F.lit("https://x.example/A"), k)).alias("d1"), names.id_digits(F.concat(F.lit("a"), k)).alias("d2"))


@query("id_lookup", "SELECT CAST(k AS VARCHAR) AS id, n_name, n_name IS NOT NULL AS found FROM (SELECT unnest([1, 3, 99]) AS k) LEFT JOIN nation ON n_nationkey = k")
def id_lookup(spark, sf_dir):
    from spindrift.sources.tables import id_lookup as look

    return look(spark.createDataFrame([("A1",), ("https://x/3",), ("99",)], "raw string"), table(spark, sf_dir, "nation"), "n_nationkey", ["n_name"])


@query("deinvert", "SELECT doc_id, array_to_string(string_split_regex(trim(text), '\\s+'), ' ') AS text FROM documents WHERE trim(text) <> ''")
def deinvert(spark, sf_dir):
    """Build the inverted index of every document's words and turn it back, each within its row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = d.repartition(L.many(d), "doc_id").select("doc_id", names.invert(F.split(F.trim("text"), r"\s+")).alias("index"))
    index = d.where("size(index) > 0").select("doc_id", F.to_json("index").alias("j"))
    return index.select("doc_id", names.deinvert(F.col("j")).alias("text"))


@query("doc_build", "SELECT doc_id, coalesce(lang, '') || '. ' || coalesce(source, '') AS doc, length(coalesce(lang, '') || '. ' || coalesce(source, '')) > 5 AS usable FROM documents")
def doc_build(spark, sf_dir):
    d = names.document(F.col("lang"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", d.alias("doc"), (F.length(d) > 5).alias("usable"))


# ---- joins ------------------------------------------------------------------------------------------------------------


@query("exact_join", f"WITH {KEYS} SELECT * FROM ex")
def exact_join(spark, sf_dir):
    _, rk, ak, _ = keys(spark, sf_dir)
    return L.key_join(rk, ak, "nn", "exact")


ALIAS_SQL = f"WITH {KEYS} SELECT * FROM ali"


@query("alias_union_join", ALIAS_SQL)
def alias_union_join(spark, sf_dir):
    _, rk, _, alk = keys(spark, sf_dir)
    return L.alias_match(rk, alk)


@query("alias_or_join", ALIAS_SQL)
def alias_or_join(spark, sf_dir):
    """The disjunction stated directly on pairs of name and alias keys, through the same helper."""
    _, rk, _, alk = keys(spark, sf_dir)
    found = L.or_equi_join(rk, alk.withColumnsRenamed({"nn": "x", "ws": "y"}), [("ws", "y"), ("nn", "x")], by_name=True)
    return found.withColumn("match_type", F.lit("alias"))


@query("fuzzy_fl_antijoin", f"WITH {KEYS} SELECT rid, name, authorid, sci_name, 'fuzzy' AS match_type FROM rk JOIN ak USING (fl) WHERE rid NOT IN (SELECT rid FROM ex WHERE authorid % 3 = 0)")
def fuzzy_fl_antijoin(spark, sf_dir):
    _, rk, ak, _ = keys(spark, sf_dir)
    return L.fuzzy_match(rk, ak, L.key_join(rk, ak, "nn", "exact").where("authorid % 3 = 0"))


@query("index_join", f"WITH {KEYS} SELECT * FROM ea")
def index_join(spark, sf_dir):
    """Exact and alias candidates over a prepared index, written once and read by kind."""
    import uuid

    _, rk, ak, alk = keys(spark, sf_dir)
    path = f"{shared_dir(spark)}/name-index-{uuid.uuid4().hex}"
    L.build_index(ak, alk, path)
    index = spark.read.parquet(path)
    return L.index_match(rk, index, "exact").unionByName(L.index_match(rk, index, "alias"))


GATE = """gated AS (SELECT p.rid, name, authorid, sci_name, match_type, p.host_id FROM (SELECT ea.*, rk.host_id FROM ea JOIN rk USING (rid) WHERE rk.host_id IS NOT NULL) p
    WHERE EXISTS (SELECT 1 FROM aff a WHERE a.authorid = p.authorid AND a.institutionid = p.host_id))"""


@query("inst_gate", f"WITH {KEYS}, {GATE} SELECT rid, name, authorid, sci_name, match_type, host_id FROM gated")
def inst_gate(spark, sf_dir):
    r, rk, ak, alk = keys(spark, sf_dir)
    hosts, found = layer(r.roster.select("rid", "host_id")), L.Candidates(rk, ak, alk)
    return found.gated(found.rows.join(hosts, "rid"), L.published_at(r.affiliations, hosts))


REOPEN = """reopen AS (SELECT DISTINCT rk.rid, rk.name, ak.authorid, ak.sci_name, 'fuzzy' AS match_type FROM rk JOIN ak USING (fl) JOIN aff a ON a.authorid = ak.authorid AND a.institutionid = rk.host_id
    WHERE rk.rid IN (SELECT rid FROM ea) AND NOT EXISTS (SELECT 1 FROM ea e WHERE e.rid = rk.rid AND e.authorid = ak.authorid))"""


@query("homonym_reopen", f"WITH {KEYS}, {REOPEN} SELECT * FROM reopen")
def homonym_reopen(spark, sf_dir, same=None):
    r, rk, ak, alk = keys(spark, sf_dir)
    hosts = layer(r.roster.select("rid", "host_id"))
    return L.Candidates(rk, ak, alk).homonyms(hosts, L.published_at(r.affiliations, hosts), same)


@query("homonym_reopen_compared")
def homonym_reopen_compared(spark, sf_dir):
    return homonym_reopen(spark, sf_dir, compare.match_udf())


@query("names_match_pairs")
def names_match_pairs(spark, sf_dir):
    """Each pair of texts is compared once, however many rows and authors have them."""
    _, rk, ak, _ = keys(spark, sf_dir)
    texts = L.spread_join(rk.select("name", "fl").distinct(), ak.select("sci_name", "fl").distinct().withColumn("authorid", F.col("sci_name")), "fl").select("name", "sci_name")
    judged = layer(texts.select("name", "sci_name", compare.match_udf()("name", "sci_name").alias("same"), compare.match_udf(mode="fuzzy")("name", "sci_name").alias("same_turned")))
    return L.spread_join(rk.select("rid", "name").join(judged, "name"), ak.select("authorid", "sci_name"), "sci_name").select("rid", "authorid", "same", "same_turned")


@query("paper_counts", f"{WITH} SELECT authorid, count(DISTINCT paperid) AS n_papers FROM papers WHERE authorid IN (SELECT authorid FROM gold) GROUP BY authorid")
def paper_counts(spark, sf_dir):
    r = roles(spark, sf_dir)
    return A.distinct_papers(r.papers, r.gold)


TOP3 = """n AS (SELECT authorid, fieldid, count(*) AS n FROM papers JOIN pf USING (paperid) WHERE authorid IN (SELECT authorid FROM gold) GROUP BY ALL),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY authorid) AS share, row_number() OVER (PARTITION BY authorid ORDER BY n DESC, fieldid) AS rk FROM n),
top3 AS (SELECT * FROM sh WHERE rk <= 3)"""


def top3(r: Roles) -> DataFrame:
    near = r.papers.join(r.gold.select("authorid"), "authorid", "left_semi")
    n = A.field_counts(near, r.paper_fields, r.fields)
    return R.top_k(n.withColumn("share", R.share(n, "authorid", "n")), ["authorid"], [F.desc("n"), F.asc("fieldid")], 3)


@query("top3_fields_share", f"{WITH}, {TOP3} SELECT g.rid, authorid, fieldid, n, round(share, 6) AS share, CAST(rk AS INTEGER) AS rk FROM gold g LEFT JOIN top3 USING (authorid)")
def top3_fields_share(spark, sf_dir):
    r = roles(spark, sf_dir)
    return r.gold.join(top3(r), "authorid", "left").select("rid", "authorid", "fieldid", "n", F.round("share", 6).alias("share"), "rk")


@query("weighted_fields", "SELECT l_partkey AS authorid, o_orderpriority AS fieldid, round(sum(l_discount), 6) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def weighted_fields(spark, sf_dir):
    r = roles(spark, sf_dir)
    edges = r.table("lineitem").select(F.col("l_partkey").alias("authorid"), F.col("l_orderkey").alias("paperid"), "l_discount")
    out = A.field_counts(edges, r.paper_fields, r.fields, score="l_discount")
    return out.select("authorid", "fieldid", F.round("n", 6).alias("n"))


@query("first_last_fields", f"{WITH} SELECT authorid, fieldid, count(*) AS n FROM aff JOIN pf USING (paperid) GROUP BY ALL")
def first_last_fields(spark, sf_dir):
    r = roles(spark, sf_dir)
    return A.field_counts(r.affiliations.where(F.col("author_position").isin("first", "last")), r.paper_fields, r.fields)


@query("dup_propagate", "WITH rows AS (SELECT c_custkey AS rid, c_nationkey, c_mktsegment FROM customer), res AS (SELECT rid, rid * 7 AS authorid FROM rows WHERE rid % 9 = 0), known AS (SELECT c_nationkey, c_mktsegment, arg_max(authorid, rid) AS authorid FROM res JOIN rows USING (rid) GROUP BY ALL) SELECT rid, c_nationkey, c_mktsegment, authorid FROM rows JOIN known USING (c_nationkey, c_mktsegment) WHERE rid NOT IN (SELECT rid FROM res)")
def dup_propagate(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rid"), "c_nationkey", "c_mktsegment")
    resolved = rows.where("rid % 9 = 0").select("rid", (F.col("rid") * 7).alias("authorid"))
    return L.propagate(resolved, rows, ["c_nationkey", "c_mktsegment"])


@query("rescue_surname", f"{WITH}, t AS (SELECT rid, host_id, string_split({N('name')}, ' ') AS t FROM roster), k AS (SELECT DISTINCT rid, host_id, unnest([t[len(t)], t[len(t) - 1], t[1]]) AS last FROM t), p AS (SELECT authorid, display_name, list_extract(string_split({N('display_name')}, ' '), -1) AS last FROM authors) SELECT DISTINCT k.rid, p.authorid FROM k JOIN p USING (last) JOIN aff a ON a.authorid = p.authorid AND a.institutionid = k.host_id")
def rescue_surname(spark, sf_dir):
    r = roles(spark, sf_dir)
    found = L.surname_recall(r.roster, r.authors, r.roster.select("rid", "host_id"), r.affiliations)
    return found.select("rid", "authorid").distinct()


@query("rescue_plan")
def rescue_plan(spark, sf_dir):
    r = roles(spark, sf_dir)
    answered = r.gold.where("rid % 2 = 1")
    matched, low = funnel.rescue(r.roster, answered, r.authors, r.roster.select("rid", "host_id"), r.affiliations, r.papers, 30, compare.anchored, compare.match_udf(mode="fuzzy"))
    return matched.withColumn("reason", F.lit(None).cast("string")).unionByName(low)


@query("unmatched_set", f"{WITH} SELECT rid, name FROM roster WHERE rid NOT IN (SELECT rid FROM gold WHERE rid % 2 = 0) AND rid NOT IN (SELECT rid FROM gold WHERE rid % 3 = 0)")
def unmatched_set(spark, sf_dir):
    r = roles(spark, sf_dir)
    return L.unmatched(r.roster, r.gold.where("rid % 2 = 0"), r.gold.where("rid % 3 = 0")).select("rid", "name")


@query("prefer_answer", f"{WITH}, a AS (SELECT rid, authorid FROM gold WHERE rid % 2 = 0), b AS (SELECT rid, authorid + 1 AS authorid FROM gold WHERE rid % 3 = 0) SELECT rid, coalesce(a.authorid, b.authorid) AS authorid FROM a FULL JOIN b USING (rid)")
def prefer_answer(spark, sf_dir):
    g = roles(spark, sf_dir).gold
    return L.prefer(g.where("rid % 2 = 0"), g.where("rid % 3 = 0").select("rid", (F.col("authorid") + 1).alias("authorid")), "rid", "authorid")


@query("semi_scan_en", "SELECT d.doc_id, n_chars FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) WHERE lang = 'en'")
def semi_scan_en(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars").join(good, "doc_id", "left_semi")


# ---- aggregates, windows, order ------------------------------------------------------------------------------------------


@query("filtered_counts", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS n_en, count(*) FILTER (WHERE lang = 'fr') AS n_fr, count(*) AS n, round(count(*) FILTER (WHERE lang = 'en') / greatest(count(*), 1), 6) AS share_en FROM documents GROUP BY source")
def filtered_counts(spark, sf_dir):
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("lang") == "fr").alias("n_fr"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("share_en", F.round(names.ratio(F.col("n_en"), F.col("n")), 6))


@query("ordered_list", "SELECT conv_id, array_to_string(list(role ORDER BY turn, role), '|') AS roles FROM conversations GROUP BY conv_id")
def ordered_list(spark, sf_dir):
    out = A.ordered_list(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "roles")
    return out.select("conv_id", F.array_join("roles", "|").alias("roles"))


@query("ordered_listagg", "SELECT conv_id, md5(string_agg(text, ' . ' ORDER BY turn, text)) AS text_md5 FROM conversations GROUP BY conv_id")
def ordered_listagg(spark, sf_dir):
    return A.joined_text(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "t").select("conv_id", F.md5("t").alias("text_md5"))


@query("capped_papers", f"{WITH} SELECT authorid, paperid, CAST(row_number() OVER (PARTITION BY authorid ORDER BY paperid) AS INTEGER) AS rk FROM (SELECT DISTINCT * FROM papers) QUALIFY rk <= 5")
def capped_papers(spark, sf_dir):
    return R.top_k(roles(spark, sf_dir).papers.distinct(), ["authorid"], [F.asc("paperid")], 5)


@query("value_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_cust FROM orders GROUP BY ALL")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_cust"))


@query("top_two_gap", "WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC) AS rk FROM n) SELECT o_custkey, max(n) - coalesce(max(n) FILTER (WHERE rk = 2), 0) AS margin FROM r GROUP BY o_custkey")
def top_two_gap(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return R.top_two_gap(n, "o_custkey", "n")


@query("keep_first", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def keep_first(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("filter_or_all", "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice > 250000 AS p FROM orders) SELECT o_custkey, o_orderkey FROM (SELECT *, bool_or(p) OVER (PARTITION BY o_custkey) AS any_p FROM r) WHERE p OR NOT any_p")
def filter_or_all(spark, sf_dir):
    return R.filter_or_all(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.col("o_totalprice") > 250000).select("o_custkey", "o_orderkey")


@query("quantile_compare", "SELECT quality, count(n_chars) AS n, min(n_chars) AS lo, round(avg(n_chars), 6) AS mean, max(n_chars) AS hi, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90 FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def quantile_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = E.compare(rows, "n_chars", "quality")
    return out.select("quality", "n", "lo", F.round("mean", 6).alias("mean"), "hi", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


@query("hash_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100")
def hash_sample(spark, sf_dir):
    return R.hash_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100)


@query("stratified_sample", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) <= CASE o_orderpriority WHEN '1-URGENT' THEN 50 WHEN '2-HIGH' THEN 50 WHEN '5-LOW' THEN 100 ELSE 0 END")
def stratified_sample(spark, sf_dir):
    return R.stratified_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", {"1-URGENT": 50, "2-HIGH": 50, "5-LOW": 100})


# ---- vectors ----------------------------------------------------------------------------------------------------------------

DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
UNIT = "list_transform({a}, lambda x: CAST(x AS DOUBLE) / sqrt(" + DOT.format(a="{a}", b="{a}") + "))"
CENTROID = "cen AS (SELECT label, list(m ORDER BY i) AS mean, max(c) AS ndoc FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m, count(*) AS c FROM embeddings, range(1, 65) t(i) GROUP BY ALL) GROUP BY label), proto AS (SELECT label, ndoc, list_transform(mean, lambda x: x / sqrt(list_sum(list_transform(mean, lambda y: y * y)))) AS vec FROM cen)"


@query("centroid_by_label", f"WITH {CENTROID} SELECT label, ndoc, round(vec[1], 6) AS v1, round(vec[32], 6) AS v32, round(vec[64], 6) AS v64 FROM proto")
def centroid_by_label(spark, sf_dir):
    c = V.centroids(roles(spark, sf_dir).vectors, "label")
    return c.select("label", "ndoc", *(F.round(F.col("vec")[i - 1], 6).alias(f"v{i}") for i in (1, 32, 64)))


@query("nearest_prototype", f"WITH {CENTROID}, s AS (SELECT vec_id, p.label, {DOT.format(a='e.embedding', b='p.vec')} / sqrt({DOT.format(a='e.embedding', b='e.embedding')}) AS sim FROM embeddings e, proto p) SELECT vec_id, label, round(sim, 6) AS sim FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) = 1")
def nearest_prototype(spark, sf_dir):
    v = roles(spark, sf_dir).vectors
    return V.nearest(v, V.centroids(v, "label"), 1).select("vec_id", "label", F.round("sim", 6).alias("sim"))


VEC = f"cnt AS (SELECT count(*) AS c FROM embeddings), uv AS (SELECT vec_id, {UNIT.format(a='embedding')} AS vec FROM embeddings)"
CAND = "cv AS (SELECT DISTINCT rid, authorid FROM ea)"


@query("max_cosine", f"WITH {KEYS}, {TOP3}, {VEC}, f AS (SELECT authorid, vec FROM top3, cnt JOIN uv ON vec_id = (ascii(fieldid) - 48) * 7 % c), s AS (SELECT g.rid, g.authorid, {DOT.format(a='f.vec', b='r.vec')} AS sim FROM gold g JOIN f USING (authorid), cnt JOIN uv r ON r.vec_id = g.rid % c) SELECT rid, authorid, round(max(sim), 6) AS sim FROM s GROUP BY ALL")
def max_cosine(spark, sf_dir):
    r = roles(spark, sf_dir)
    t = top3(r)
    fv = r.vectors_of(t.select("fieldid").distinct(), "fieldid", (F.ascii("fieldid") - 48) * 7)
    rv = r.vectors_of(r.gold, "rid", F.col("rid"))
    out = D.max_field_scores(r.gold, t.select("authorid", "fieldid"), fv, rv)
    return out.where("sim IS NOT NULL").select("rid", "authorid", F.round("sim", 6).alias("sim"))


@query("fallback_vector", f"WITH {SQL_ROLES}, {VEC}, a AS (SELECT authorid FROM authors), o AS (SELECT authorid, vec FROM a, cnt JOIN uv ON vec_id = authorid % c WHERE authorid % 2 = 0), fb AS (SELECT authorid, vec FROM a, cnt JOIN uv ON vec_id = (authorid + 1) % c) SELECT authorid, round(coalesce(o.vec[1], fb.vec[1]), 6) AS v1, o.vec IS NULL AS from_fields FROM a LEFT JOIN o USING (authorid) LEFT JOIN fb USING (authorid)")
def fallback_vector(spark, sf_dir):
    r = roles(spark, sf_dir)
    a = r.authors.select("authorid")
    own = r.vectors_of(a.where("authorid % 2 = 0"), "authorid", F.col("authorid")).withColumnRenamed("vec", "own")
    back = r.vectors_of(a, "authorid", F.col("authorid") + 1)
    return a.join(own, "authorid", "left").join(back, "authorid", "left").select("authorid", F.round(F.coalesce("own", "vec")[0], 6).alias("v1"), F.col("own").isNull().alias("from_fields"))


@query("leave_one_out", f"WITH tot AS (SELECT label, i, sum(CAST(embedding[i] AS DOUBLE)) AS t FROM embeddings, range(1, 65) x(i) GROUP BY ALL), d AS (SELECT e.vec_id, e.label, list(t - CAST(embedding[i] AS DOUBLE) ORDER BY i) AS vec FROM embeddings e JOIN tot USING (label) GROUP BY ALL) SELECT vec_id, round(vec[1] / sqrt(list_sum(list_transform(vec, lambda y: y * y))), 6) AS v1 FROM d")
def leave_one_out(spark, sf_dir):
    v = roles(spark, sf_dir).vectors.withColumn("own", F.col("vec_id"))
    return V.leave_one_out(v, "label", "vec_id", "own").select("vec_id", F.round(F.col("vec")[0], 6).alias("v1"))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    return V.kmeans(roles(spark, sf_dir).vectors, 8)


# ---- decisions ------------------------------------------------------------------------------------------------------------------

RANK = "CASE match_type WHEN 'exact' THEN 0 WHEN 'alias' THEN 1 ELSE 2 END"
FUNNEL = f"""{KEYS}, {VEC}, {REOPEN},
uniq0 AS (SELECT rid FROM ea GROUP BY rid HAVING count(DISTINCT authorid) = 1),
uniq AS (SELECT rid, name, authorid, match_type, 'name_unique' AS source FROM ex WHERE rid IN (SELECT rid FROM uniq0) AND rid NOT IN (SELECT rid FROM reopen) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY authorid) = 1),
cand AS (SELECT * FROM ea UNION ALL SELECT * FROM reopen),
pend AS (SELECT c.*, rk.host_id FROM cand c JOIN rk USING (rid) WHERE rid NOT IN (SELECT rid FROM uniq)),
gated AS (SELECT * FROM pend p WHERE EXISTS (SELECT 1 FROM aff a WHERE a.authorid = p.authorid AND a.institutionid = p.host_id)),
inst1 AS (SELECT rid FROM gated GROUP BY rid HAVING count(DISTINCT authorid) = 1),
instu AS (SELECT rid, name, authorid, match_type, 'round2_inst' AS source FROM gated WHERE rid IN (SELECT rid FROM inst1) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY {RANK}, authorid) = 1),
open_rows AS (SELECT rid, name, authorid, match_type FROM gated WHERE rid NOT IN (SELECT rid FROM inst1) UNION ALL SELECT rid, name, authorid, match_type FROM pend WHERE rid NOT IN (SELECT rid FROM gated)),
scored AS (SELECT o.*, {DOT.format(a='a.vec', b='r.vec')} AS sim FROM open_rows o, cnt JOIN uv a ON a.vec_id = (o.authorid // 3) % c JOIN uv r ON r.vec_id = (o.rid * 10 // 3) % c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY sim DESC, authorid, {RANK}) AS k FROM scored WHERE sim >= 0.8),
sem AS (SELECT a.rid, a.name, a.authorid, a.match_type, 'round3_semantic' AS source, a.sim FROM ranked a LEFT JOIN ranked b ON a.rid = b.rid AND b.k = 2 WHERE a.k = 1 AND (b.sim IS NULL OR round(a.sim - b.sim, 9) >= 0.01)),
np AS (SELECT authorid, count(DISTINCT paperid) AS n_papers FROM papers GROUP BY authorid),
fall AS (SELECT rid, name, authorid, match_type, CASE WHEN sim >= 0.8 THEN 'round4_semtie' ELSE 'round4_maxpapers' END AS source, coalesce(n_papers, 0) AS n_papers FROM scored LEFT JOIN np USING (authorid) WHERE rid NOT IN (SELECT rid FROM sem) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY (sim >= 0.8) DESC, coalesce(n_papers, 0) DESC, authorid, {RANK}) = 1),
fin0 AS (SELECT rid, name, authorid, match_type, source FROM uniq UNION ALL SELECT rid, name, authorid, match_type, source FROM instu UNION ALL SELECT rid, name, authorid, match_type, source FROM sem UNION ALL SELECT rid, name, authorid, match_type, source FROM fall),
fin AS (SELECT fin0.*, coalesce(n_papers, 0) AS n_papers FROM fin0 LEFT JOIN np USING (authorid))"""


def layers(spark, sf_dir) -> funnel.Layers:
    r = roles(spark, sf_dir)
    av = r.vectors_of(r.authors, "authorid", (F.col("authorid") / 3).cast("long"))
    rv = r.vectors_of(r.roster, "rid", (F.col("rid") * 10 / 3).cast("long"))
    return funnel.run(EU, r.roster, r.authors, r.details, r.affiliations, r.papers, av, rv)


ROW = "rid, name, authorid, match_type, source"
COLS = ["rid", "name", "authorid", "match_type", "source"]


@query("name_unique", f"WITH {FUNNEL} SELECT {ROW} FROM uniq")
def name_unique(spark, sf_dir):
    return layers(spark, sf_dir).unique.select(COLS)


@query("inst_unique", f"WITH {FUNNEL} SELECT {ROW} FROM instu")
def inst_unique(spark, sf_dir):
    return layers(spark, sf_dir).institution.select(COLS)


@query("semantic_pick", f"WITH {FUNNEL} SELECT {ROW}, round(sim, 6) AS sim FROM sem")
def semantic_pick(spark, sf_dir):
    return layers(spark, sf_dir).semantic.select(*COLS, F.round("sim", 6).alias("sim"))


@query("argmax_fallback", f"WITH {FUNNEL} SELECT {ROW}, n_papers FROM fall")
def argmax_fallback(spark, sf_dir):
    return layers(spark, sf_dir).fallback.select(*COLS, "n_papers")


@query("funnel_final", f"WITH {FUNNEL} SELECT {ROW}, n_papers FROM fin")
def funnel_final(spark, sf_dir):
    return layers(spark, sf_dir).final


@query("floor_split", f"WITH {FUNNEL} SELECT rid, authorid, n_papers, n_papers < 30 AS held FROM fin")
def floor_split(spark, sf_dir):
    matched, held = D.floor_split(layers(spark, sf_dir).final, EU.paper_floor)
    return matched.withColumn("held", F.lit(False)).unionByName(held.withColumn("held", F.lit(True))).select("rid", "authorid", "n_papers", "held")


@query("funnel_summary", f"WITH {FUNNEL} SELECT source, count(*) AS n, count(*) FILTER (WHERE n_papers < 30) AS held, round(avg(n_papers), 6) AS mean_papers FROM fin GROUP BY source")
def funnel_summary(spark, sf_dir):
    return layers(spark, sf_dir).final.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_papers") < 30).alias("held"), F.round(F.avg("n_papers"), 6).alias("mean_papers"))


TWO = f"""{KEYS}, u0 AS (SELECT rid FROM ea GROUP BY rid HAVING count(DISTINCT authorid) = 1),
u AS (SELECT rid, name, authorid, match_type, 'name_unique' AS source FROM ex WHERE rid IN (SELECT rid FROM u0) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY authorid) = 1),
g AS (SELECT ea.*, rk.host_id FROM ea JOIN rk USING (rid) WHERE rid NOT IN (SELECT rid FROM u) AND EXISTS (SELECT 1 FROM aff a WHERE a.authorid = ea.authorid AND a.institutionid = rk.host_id)),
i AS (SELECT rid, name, authorid, match_type, 'round2_inst' AS source FROM g WHERE rid IN (SELECT rid FROM g GROUP BY rid HAVING count(DISTINCT authorid) = 1) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY {RANK}, authorid) = 1),
np AS (SELECT authorid, count(DISTINCT paperid) AS n_papers FROM papers GROUP BY authorid)"""


@query("cn_two_layer", f"WITH {TWO} SELECT rid, name, authorid, match_type, source, coalesce(n_papers, 0) AS n_papers FROM (SELECT * FROM u UNION ALL SELECT * FROM i) LEFT JOIN np USING (authorid)")
def cn_two_layer(spark, sf_dir):
    r, rk, ak, alk = keys(spark, sf_dir)
    return funnel.two_layer(rk, ak, alk, r.roster.select("rid", "host_id"), r.affiliations, r.papers)


# ---- institutions -------------------------------------------------------------------------------------------------------------

INST_N = r"nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({x})), '&', ' and ', 'g'), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '')"


@query("inst_norm_keys", f"SELECT p_partkey, {INST_N.format(x='x')} AS nn, array_to_string(list_sort(list_filter(list_distinct(string_split({INST_N.format(x='x')}, ' ')), lambda t: NOT list_contains(['of', 'the', 'and', 'for', 'de', 'la', 'le', 'des', 'du', 'di', 'der', 'und', 'el', 'at'], t))), ' ') AS toks FROM (SELECT p_partkey, 'The Université of ' || p_name || ' & ' || p_type || ', ' || p_brand AS x FROM part)")
def inst_norm_keys(spark, sf_dir):
    x = F.concat(F.lit("The Université of "), F.col("p_name"), F.lit(" & "), F.col("p_type"), F.lit(", "), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", inst.norm_inst(x).alias("nn"), F.array_join(F.sort_array(inst.tokens(x)), " ").alias("toks"))


@query("host_parse", r"SELECT s_suppkey, regexp_replace(regexp_replace(s_name, '\s+', ' ', 'g'), ',+$', '') AS host, CASE s_nationkey % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'GR' ELSE 'DE' END AS cc FROM supplier")
def host_parse(spark, sf_dir):
    cc = F.element_at(F.array(F.lit("UK"), F.lit("EL"), F.lit("DE")), (F.col("s_nationkey") % 3 + 1).cast("int"))
    raw = F.concat(F.col("s_name"), F.lit(", [999,"), cc, F.lit("], Other [1,FR]"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", inst.host_name(raw).alias("host"), inst.host_country(raw).alias("cc"))


TIER = f"""q AS (SELECT s_suppkey, 'University of ' || n_name AS name, n_name || CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Tech' ELSE ' Big Other Place' END || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE ' University' END AS shown FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT s_suppkey, name, CASE WHEN s_suppkey % 3 = 0 THEN 'The University of ' || shown ELSE shown END AS shown FROM q)"""


@query("inst_jaccard_tier")
def inst_jaccard_tier(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 3
    shown = F.when(k == 0, F.concat(F.lit("The University of "), F.col("n_name"))).when(k == 1, F.concat(F.lit("University "), F.col("n_name"), F.lit(" Campus"))).otherwise(F.concat(F.lit("Big Other "), F.col("n_name")))
    result = F.array(F.struct(F.concat(F.lit("https://x/I"), F.col("s_suppkey")).alias("id"), shown.alias("display_name"), F.array().cast("array<string>").alias("alternatives"), F.lit(1.0).alias("relevance"), F.lit(None).cast("string").alias("ror")))
    hosts = s.select(F.concat(F.lit("The University of "), F.col("n_name"), F.lit(" "), F.col("s_suppkey").cast("string")).alias("name"), result.alias("results"))
    plain = hosts.withColumn("order", F.regexp_extract("name", r"(\d+)$", 1).cast("long")).withColumn("name", F.regexp_replace("name", r" \d+$", ""))
    return S.classify(R.keep_first(plain, ["name"], [F.asc("order")]).drop("order"))


@query("inst_variants")
def inst_variants(spark, sf_dir):
    x = F.concat(F.lit("Regents of the University of "), F.col("n_name"), F.lit(" - Main Campus"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(inst.variants(x)).alias("step", "variant"))


@query("bridge_finalize", "SELECT s_suppkey AS row_id, CASE WHEN s_suppkey % 2 = 0 THEN 'I' || s_suppkey WHEN s_suppkey % 3 = 0 THEN 'R' || s_suppkey WHEN s_nationkey < 5 THEN 'N' || s_nationkey WHEN s_nationkey < 10 THEN 'C' || s_nationkey END AS host_id, CASE WHEN s_suppkey % 2 = 0 THEN 'kept' WHEN s_suppkey % 3 = 0 THEN 'row_override' WHEN s_nationkey < 5 THEN 'name_override' WHEN s_nationkey < 10 THEN 'cached' ELSE 'unresolved' END AS how FROM supplier")
def bridge_finalize(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    bridge = s.select(F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, tag("I", "s_suppkey")).alias("host_id"))
    rows = s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("row_id"), tag("R", "s_suppkey").alias("host_id"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"))
    return S.finalise_bridge(bridge, rows, n.where("name < 5").select("name", tag("N", "name").alias("host_id")), n.where("name < 10").select("name", tag("C", "name").alias("host_id")))


# ---- evaluation -------------------------------------------------------------------------------------------------------------------


@query("recall_eval", f"WITH {KEYS}, {CAND}, p AS (SELECT rid, count(*) AS pool FROM cv GROUP BY rid) SELECT count(*) AS n_gold, count(c.rid) AS recalled, round(count(c.rid) / count(*), 6) AS recall, quantile_cont(pool, 0.5) AS pool_median, round(avg(pool), 6) AS pool_mean, round(quantile_cont(pool, 0.9), 6) AS pool_p90 FROM gold g LEFT JOIN cv c USING (rid, authorid) LEFT JOIN p ON p.rid = g.rid")
def recall_eval(spark, sf_dir):
    r, lists, members = pool(spark, sf_dir)
    out = E.recall(r.gold, lists, members=members)
    return out.select("n_gold", "recalled", F.round("recall", 6).alias("recall"), "pool_median", F.round("pool_mean", 6).alias("pool_mean"), F.round("pool_p90", 6).alias("pool_p90"))


@query("precision_by_source", f"WITH {FUNNEL} SELECT source, count(*) AS n, count(*) FILTER (WHERE fin.authorid = gold.authorid) AS correct, round(avg(CAST(fin.authorid = gold.authorid AS INT)), 6) AS precision FROM fin JOIN gold USING (rid) GROUP BY source")
def precision_by_source(spark, sf_dir):
    out = E.precision_by_source(roles(spark, sf_dir).gold, layers(spark, sf_dir).final)
    return out.withColumn("precision", F.round("precision", 6))


@query("error_classes", f"WITH {FUNNEL} SELECT CASE WHEN fin.authorid = g.authorid THEN 'correct' WHEN fin.authorid IS NULL THEN 'unanswered' ELSE 'disambig_wrong' END AS outcome, count(*) AS n FROM gold g LEFT JOIN fin USING (rid) GROUP BY 1")
def error_classes(spark, sf_dir):
    r, out = roles(spark, sf_dir), layers(spark, sf_dir)
    return E.error_classes(r.gold, out.among(r.gold), out.final, r.authors)


RULED = "WITH r AS (SELECT l.quality, l.toxic, n_chars, lang FROM documents JOIN labels l USING (doc_id))"


@query("rule_sweep", RULED + ", t AS (SELECT count(*) AS total FROM r), x AS (SELECT 'english' AS rule, count(*) FILTER (WHERE lang = 'en') AS n, count(*) FILTER (WHERE lang = 'en' AND quality = 1) AS correct FROM r UNION ALL SELECT 'long', count(*) FILTER (WHERE n_chars > 1000), count(*) FILTER (WHERE n_chars > 1000 AND quality = 1) FROM r UNION ALL SELECT 'clean', count(*) FILTER (WHERE toxic = 0 AND n_chars > 500), count(*) FILTER (WHERE toxic = 0 AND n_chars > 500 AND quality = 1) FROM r) SELECT rule, n, correct, round(correct / n, 6) AS precision, round(n / total, 6) AS coverage FROM x, t")
def rule_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rules = {"english": F.col("lang") == "en", "long": F.col("n_chars") > 1000, "clean": (F.col("toxic") == 0) & (F.col("n_chars") > 500)}
    out = E.rule_sweep(rows, F.col("quality") == 1, rules)
    return out.withColumn("precision", F.round("precision", 6)).withColumn("coverage", F.round("coverage", 6))


@query("margin_sweep", RULED + " SELECT s AS step, count(*) FILTER (WHERE n_chars >= s) AS n, count(*) FILTER (WHERE n_chars >= s AND quality = 1) AS correct FROM r, unnest([0, 20, 50, 100, 200, 500]) t(s) GROUP BY s")
def margin_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.margin_sweep(rows, "n_chars", F.col("quality") == 1, [0, 20, 50, 100, 200, 500])


GRID = "b AS (SELECT rid, authorid, sim, row_number() OVER (PARTITION BY rid ORDER BY sim DESC, authorid) AS k FROM scored), pr AS (SELECT rid, max(sim) AS s1, max(sim) FILTER (WHERE k = 2) AS s2, max(authorid) FILTER (WHERE k = 1) AS top FROM b WHERE k <= 2 GROUP BY rid)"


@query("threshold_grid", f"WITH {FUNNEL}, {GRID} SELECT CAST(t AS DOUBLE) AS threshold, CAST(m AS DOUBLE) AS margin, count(*) FILTER (WHERE s1 >= t AND (s2 IS NULL OR s2 < t OR round(s1 - s2, 9) >= m)) AS answered, count(*) FILTER (WHERE s1 >= t AND (s2 IS NULL OR s2 < t OR round(s1 - s2, 9) >= m) AND top = gold.authorid) AS correct FROM pr JOIN gold USING (rid), unnest([0.5, 0.62, 0.8]) a(t), unnest([0.0, 0.03]) c2(m) GROUP BY t, m")
def threshold_grid(spark, sf_dir):
    return E.threshold_grid(layers(spark, sf_dir).scored, roles(spark, sf_dir).gold, [0.5, 0.62, 0.8], [0.0, 0.03])


@query("top_is_gold", f"WITH {FUNNEL}, {GRID} SELECT count(*) AS n, count(*) FILTER (WHERE top = gold.authorid) AS top_is_gold FROM pr JOIN gold USING (rid)")
def top_is_gold(spark, sf_dir):
    return E.top_is_gold(layers(spark, sf_dir).scored, roles(spark, sf_dir).gold)


@query("oracle_ceiling", f"""WITH {KEYS}, {CAND}, n AS (SELECT authorid, fieldid, count(*) AS n FROM papers JOIN pf USING (paperid) GROUP BY ALL),
t3 AS (SELECT authorid, list(fieldid) AS f FROM (SELECT *, row_number() OVER (PARTITION BY authorid ORDER BY n DESC, fieldid) AS rk FROM n) WHERE rk <= 3 GROUP BY authorid),
np AS (SELECT authorid, count(DISTINCT paperid) AS n_papers FROM papers GROUP BY authorid),
j AS (SELECT cv.rid, cv.authorid, g.authorid AS gold, coalesce(list_has_any(t3.f, gt.f), false) AS ok, n_papers FROM cv JOIN gold g USING (rid) LEFT JOIN t3 ON t3.authorid = cv.authorid LEFT JOIN t3 gt ON gt.authorid = g.authorid LEFT JOIN np ON np.authorid = cv.authorid),
k AS (SELECT *, bool_or(ok) OVER (PARTITION BY rid) AS any_ok FROM j),
w AS (SELECT * FROM k WHERE ok OR NOT any_ok QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n_papers DESC NULLS LAST, authorid) = 1)
SELECT count(*) AS n, count(*) FILTER (WHERE authorid = gold) AS correct FROM w""")
def oracle_ceiling(spark, sf_dir):
    r, lists, members = pool(spark, sf_dir)
    n = A.field_counts(r.papers, r.paper_fields, r.fields)
    top = R.top_k(n, ["authorid"], [F.desc("n"), F.asc("fieldid")], 3)
    return E.oracle_fields(lists, r.gold, top, A.distinct_papers(r.papers), members)


@query("pool_buckets", f"WITH {KEYS}, {CAND}, p AS (SELECT rid, count(*) AS pool FROM cv GROUP BY rid) SELECT CASE WHEN pool <= 1 THEN '1' WHEN pool <= 5 THEN '2-5' WHEN pool <= 20 THEN '6-20' ELSE '>20' END AS bucket, count(*) AS n FROM p GROUP BY 1")
def pool_buckets(spark, sf_dir):
    _, lists, members = pool(spark, sf_dir)
    sizes = E.of_rows(lists.groupBy("rid").agg(F.count(F.lit(1)).alias("pool")), members)
    return sizes.groupBy(A.pool_bucket(F.col("pool")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("romanize_variants")
def romanize_variants(spark, sf_dir):
    from spindrift.functions import cjk

    readings = {"李": ["li"], "雷": ["lei"], "吕": ["lv"], "欧": ["ou"], "阳": ["yang"], "明": ["ming"], "单": ["dan"], "伟": ["wei"]}
    roster = spark.createDataFrame([(0, "李雷"), (1, "吕明"), (2, "欧阳明"), (3, "单伟明"), (4, "明·雷"), (5, None)], "rid long, name string")
    return cjk.variants(roster, readings)


@query("semantic_pick_deduped", f"WITH {FUNNEL}, one AS (SELECT * FROM scored WHERE sim >= 0.8 QUALIFY row_number() OVER (PARTITION BY rid, authorid ORDER BY {RANK}) = 1), rr AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY sim DESC, authorid) AS k FROM one) SELECT a.rid, a.name, a.authorid, a.match_type, 'round3_semantic' AS source, round(a.sim, 6) AS sim FROM rr a LEFT JOIN rr b ON a.rid = b.rid AND b.k = 2 WHERE a.k = 1 AND (b.sim IS NULL OR round(a.sim - b.sim, 9) >= 0.01)")
def semantic_pick_deduped(spark, sf_dir):
    """An author who is a candidate by two match types counts once, so it doesn't compete with itself."""
    out = D.semantic_pick(layers(spark, sf_dir).scored, EU.sem_thresh_v2, EU.sem_margin_v2, dedupe=True)
    return out.select(*COLS, F.round("sim", 6).alias("sim"))


NP = "np AS (SELECT authorid, count(DISTINCT paperid) AS n_papers FROM papers GROUP BY authorid)"


def pool_with_papers(spark, sf_dir) -> tuple[Roles, DataFrame, DataFrame]:
    r, lists, members = pool(spark, sf_dir)
    return r, lists.join(A.distinct_papers(r.papers), "authorid", "left"), members


@query("filter_sweep", f"WITH {KEYS}, {CAND}, {NP}, x AS (SELECT rid, authorid, n_papers, f FROM cv LEFT JOIN np USING (authorid), unnest([20, 30, 40]) t(f)), y AS (SELECT *, bool_or(n_papers >= f) OVER (PARTITION BY f, rid) AS any_ok FROM x), z AS (SELECT * FROM y WHERE n_papers >= f OR NOT any_ok QUALIFY row_number() OVER (PARTITION BY f, rid ORDER BY n_papers DESC NULLS LAST, authorid) = 1) SELECT f AS floor, count(*) AS n, count(*) FILTER (WHERE z.authorid = gold.authorid) AS correct FROM z JOIN gold USING (rid) GROUP BY f")
def filter_sweep(spark, sf_dir):
    r, lists, members = pool_with_papers(spark, sf_dir)
    return E.filter_sweep(lists, "n_papers", [20, 30, 40], "n_papers", r.gold, members)


@query("evidence_rules", f"WITH {KEYS}, {CAND}, {NP}, h AS (SELECT rid, authorid, n_papers FROM cv LEFT JOIN np USING (authorid) WHERE n_papers >= 35), u AS (SELECT rid, min(authorid) AS authorid FROM h GROUP BY rid HAVING count(DISTINCT authorid) = 1), p AS (SELECT rid, authorid FROM h QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n_papers DESC, authorid) = 1) SELECT 'unique' AS rule, count(*) AS answered, count(*) FILTER (WHERE u.authorid = gold.authorid) AS correct FROM u JOIN gold USING (rid) UNION ALL SELECT 'papers', count(*), count(*) FILTER (WHERE p.authorid = gold.authorid) FROM p JOIN gold USING (rid)")
def evidence_rules(spark, sf_dir):
    r, lists, members = pool_with_papers(spark, sf_dir)
    flag = F.col("n_papers") >= 35
    one = E.evidence_rule(lists, flag, r.gold, members=members).withColumn("rule", F.lit("unique"))
    return one.unionByName(E.evidence_rule(lists, flag, r.gold, "n_papers", members).withColumn("rule", F.lit("papers")))


@query("language_presence", "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY lang) AS share FROM n), k AS (SELECT *, bool_or(n >= 10 AND share >= 0.05) OVER (PARTITION BY lang) AS any_ok FROM s) SELECT lang, source, n FROM k WHERE (n >= 10 AND share >= 0.05) OR NOT any_ok QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) = 1")
def language_presence(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    kept = R.filter_or_all(n.withColumn("share", R.share(n, "lang", "n")), ["lang"], (F.col("n") >= 10) & (F.col("share") >= 0.05))
    return R.keep_first(kept, ["lang"], [F.desc("n"), F.asc("source")]).select("lang", "source", "n")


@query("nearest_top3", f"WITH {CENTROID}, s AS (SELECT vec_id, p.label, {DOT.format(a='e.embedding', b='p.vec')} / sqrt({DOT.format(a='e.embedding', b='e.embedding')}) AS sim FROM embeddings e, proto p) SELECT vec_id, label, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS INTEGER) AS rk FROM s QUALIFY rk <= 3")
def nearest_top3(spark, sf_dir):
    v = roles(spark, sf_dir).vectors
    return V.nearest(v, V.centroids(v, "label"), 3).select("vec_id", "label", "rk")


@query("assembled", f"WITH {FUNNEL} SELECT rid, roster.name, CAST(host_id AS VARCHAR) AS host_id, CAST(fin.authorid AS VARCHAR) AS author_id, source FROM roster LEFT JOIN (SELECT * FROM fin WHERE n_papers >= 30 AND source IN ('name_unique', 'round2_inst')) fin USING (rid)")
def assembled(spark, sf_dir):
    r = roles(spark, sf_dir)
    out = D.assemble(r.roster, layers(spark, sf_dir).final, EU.paper_floor, ["name_unique", "round2_inst"])
    return out.withColumn("host_id", F.col("host_id").cast("string")).withColumn("author_id", F.col("author_id").cast("string"))


@query("prototype_accuracy", f"WITH {FUNNEL}, b AS (SELECT rid, max(sim) FILTER (WHERE scored.authorid = gold.authorid) AS g, max(sim) FILTER (WHERE scored.authorid <> gold.authorid) AS o FROM scored JOIN gold USING (rid) GROUP BY rid HAVING g IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (WHERE round(g - coalesce(o, -9), 9) > 0) AS strict, count(*) FILTER (WHERE round(g - coalesce(o, -9), 9) = 0) AS ties, count(*) FILTER (WHERE round(g - coalesce(o, -9), 9) >= 0) AS loose FROM b")
def prototype_accuracy(spark, sf_dir):
    scored = layers(spark, sf_dir).scored.withColumn("sim", F.round("sim", 9))
    return E.prototype_accuracy(scored, roles(spark, sf_dir).gold)


@query("author_vectors")
def author_vectors(spark, sf_dir):
    from spindrift.functions.embed import HashEncoder
    from spindrift.functions.embed import author_vectors as build

    r = roles(spark, sf_dir)
    d = r.table("documents").select((F.col("doc_id") * 3).alias("paperid"), F.col("lang").alias("language"), names.document(F.col("source"), F.col("text")).alias("doc"))
    return build(r.papers, d, HashEncoder, 20)
