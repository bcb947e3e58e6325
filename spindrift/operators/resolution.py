"""Institution-name resolution over cached search results: fallback chain, tiers, precedence and bridge completion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import institutions as inst

JACCARD, COVER = 0.60, 0.80


def queries_of(hosts: DataFrame, region: str = "us", country: str | None = None) -> DataFrame:
    """name, step, query, cc: the name with its country, without, then each variant with it."""
    cc = F.lit(country) if country else F.col("cc")
    steps = F.concat(F.array(F.struct(F.col("name").alias("query"), cc.alias("cc")), F.struct(F.col("name").alias("query"), F.lit(None).cast("string").alias("cc"))), F.transform(inst.variants(F.col("name"), region), lambda v: F.struct(v.alias("query"), cc.alias("cc"))))
    return hosts.select("name", F.posexplode(steps).alias("step", "q")).select("name", "step", "q.query", "q.cc")


def first_results(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """name, results of the first step whose cached result (query, cc, results array) isn't empty; empty if none."""
    hit = queries.join(cache, (queries.query == cache.query) & queries.cc.eqNullSafe(cache.cc)).where(F.size("results") > 0)
    best = hit.groupBy("name").agg(F.min_by("results", "step").alias("results"))
    return queries.select("name").distinct().join(best, "name", "left")


def classify(found: DataFrame, region: str = "us") -> DataFrame:
    """name, id, matched_name, method of name, results (array of id, display_name, alternatives, relevance, ror).

    exact: the first result with a spelling whose normal form is a key of the name.  Else the first result: fuzzy if its
    best spelling has Jaccard and coverage enough, weak otherwise.  No result: method is null.
    """
    stop = inst.STOP_AT if region in ("us", "aus") else inst.STOP
    accents = region in ("us", "aus")
    r = found.select("name", inst.query_keys(F.col("name"), region).alias("keys"), inst.tokens(F.col("name"), stop, accents).alias("q"), F.posexplode_outer("results").alias("pos", "r"))
    spelling = F.concat(F.array("r.display_name"), F.coalesce("r.alternatives", F.array().cast("array<string>")))
    r = r.withColumn("spellings", F.array_compact(spelling))
    forms = F.flatten(F.transform("spellings", lambda s: inst.keys_eu(s) if region == "eu" else F.array_compact(F.array(inst.norm_inst(s, region != "cn")))))
    r = r.withColumn("exact", F.arrays_overlap("keys", forms))

    def closeness(s):
        t = inst.tokens(s, stop, accents)
        both = F.size(F.array_intersect(F.col("q"), t))
        return F.when((F.size(t) > 0) & (F.size("q") > 0), F.struct((both / F.size(F.array_union(F.col("q"), t))).alias("j"), (both / F.size("q")).alias("c")))

    r = r.withColumn("best", F.array_max(F.array_compact(F.transform("spellings", closeness))))
    w = Window.partitionBy("name").orderBy(F.desc(F.coalesce("exact", F.lit(False))), "pos")
    top = r.withColumn("rk", F.row_number().over(w)).where("rk = 1")
    method = F.when(F.col("r").isNull(), None).when(F.col("exact"), "exact").when((F.col("best.j") >= JACCARD) & (F.col("best.c") >= COVER), "fuzzy").otherwise("weak")
    return top.select("name", F.substring_index("r.id", "/", -1).alias("id"), F.col("r.display_name").alias("matched_name"), method.alias("method"))


def row_lookup(rows: DataFrame, overrides: DataFrame, resolved: DataFrame, failed: DataFrame, region: str = "us") -> DataFrame:
    """rid, id, method in the order: no name none, override, failed search pending, hit, no hit none."""
    r = rows.select("rid", "name", inst.override_key(F.col("name"), region).alias("k"))
    o = overrides.select(inst.override_key(F.col("name"), region).alias("k"), F.col("id").alias("oid"))
    r = r.join(o, "k", "left").join(failed.select("name", F.lit(True).alias("pending")), "name", "left").join(resolved.select("name", F.col("id").alias("hid"), F.col("method").alias("hm")), "name", "left")
    method = F.when(F.col("name").isNull(), "none").when(F.col("oid").isNotNull(), "override").when(F.col("pending"), "pending").otherwise(F.coalesce("hm", F.lit("none")))
    return r.select("rid", F.when(F.col("name").isNotNull(), F.coalesce("oid", F.when(F.col("pending").isNull(), F.col("hid")))).alias("id"), method.alias("method"))


def finalise_bridge(bridge: DataFrame, row_fixes: DataFrame, name_fixes: DataFrame, cached: DataFrame) -> DataFrame:
    """row_id, host_id, how: filled cells stay; else the fix of the row, of the name, the first cached result, or nothing."""
    b = bridge.join(row_fixes.select("row_id", F.col("host_id").alias("rf")), "row_id", "left").join(name_fixes.select("name", F.col("host_id").alias("nf")), "name", "left").join(cached.select("name", F.col("host_id").alias("ch")), "name", "left")
    how = F.when(F.col("host_id").isNotNull(), "kept").when(F.col("rf").isNotNull(), "row_override").when(F.col("nf").isNotNull(), "name_override").when(F.col("ch").isNotNull(), "cached").otherwise("unresolved")
    return b.select("row_id", F.coalesce("host_id", "rf", "nf", "ch").alias("host_id"), how.alias("how"))


def changed_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """Filled cells that a completion changed: must be empty."""
    return before.where("host_id IS NOT NULL").join(after.select("row_id", F.col("host_id").alias("now")), "row_id", "left").where(~F.col("host_id").eqNullSafe(F.col("now")))
