"""The funnel's decisions as relations: each keeps its rids in DataFrames, nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.vectors import dot
from spindrift.operators.linkage import Candidates, keyed, spread_join
from spindrift.operators.ranking import keep_first, top_k


def match_rank() -> Column:
    return F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "alias", 1).otherwise(2)


def unique_rids(candidates: DataFrame) -> DataFrame:
    """rid of groups with exactly one distinct author."""
    return candidates.groupBy("rid").agg(F.min("authorid").alias("lo"), F.max("authorid").alias("hi")).where("lo = hi").select("rid")


def one_per_rid(rows: DataFrame, source: str | Column) -> DataFrame:
    first = keep_first(rows, ["rid"], [match_rank().asc(), F.col("authorid").asc()])
    return first.withColumn("source", F.lit(source) if isinstance(source, str) else source)


def name_unique(candidates: Candidates) -> DataFrame:
    """Rows of rids with one author over exact and alias names and an exact hit."""
    return one_per_rid(candidates.unique(), "name_unique")


def institution_unique(gated: DataFrame) -> DataFrame:
    return one_per_rid(gated.join(unique_rids(gated), "rid", "left_semi"), "round2_inst")


def semantic_scores(candidates: DataFrame, author_vectors: DataFrame, row_vectors: DataFrame) -> DataFrame:
    """candidates with sim: the author's unit vector times the row's; null without either."""
    c = candidates.join(author_vectors.select("authorid", F.col("vec").alias("__a")), "authorid", "left").join(row_vectors.select("rid", F.col("vec").alias("__r")), "rid", "left")
    return c.withColumn("sim", product(F.col("__a"), F.col("__r"))).drop("__a", "__r")


def product(a: Column, b: Column) -> Column:
    sim = F.when(a.isNotNull() & b.isNotNull(), dot(a, b))
    return F.when(~F.isnan(sim), sim)


def scores_by_key(candidates: Candidates, rows: DataFrame, papers: DataFrame, row_vectors: DataFrame, author_vectors: DataFrame | None = None, author_fields: DataFrame | None = None, field_vectors: DataFrame | None = None) -> DataFrame:
    """All candidates of rows with sim and n_papers.  Vectors and counts are joined to an author once a key, and the pair
    is scored where the key's two sides meet, so no pair is shuffled."""
    authors = candidates.author_side(rows).join(papers, "authorid", "left")
    if author_fields is not None:
        each = author_fields.join(field_vectors.select("fieldid", "vec"), "fieldid").groupBy("authorid").agg(F.collect_list("vec").alias("__a"))
        sim = F.array_max(F.transform("__a", lambda v: product(v, F.col("__r"))))
    else:
        each, sim = author_vectors.select("authorid", F.col("vec").alias("__a")), product(F.col("__a"), F.col("__r"))
    own = keyed(rows).join(row_vectors.select("rid", F.col("vec").alias("__r")), "rid", "left")
    met = spread_join(own.select("rid", "name", "nn", "k", "__r"), authors.join(each, "authorid", "left"), "k")
    scored = met.select("rid", "name", "authorid", "nn", "n_papers", sim.alias("sim"), F.explode("found").alias("e"))
    scored = scored.where(F.col("e.nn").isNull() | (F.col("e.nn") == F.col("nn")))
    return scored.select("rid", "name", "authorid", "e.sci_name", "e.match_type", "sim", "n_papers")


def with_fallback(vectors: DataFrame, fallback: DataFrame) -> DataFrame:
    """authorid, vec: an author's own vector, else its fallback."""
    both = fallback.select("authorid", F.col("vec").alias("__fb")).join(vectors.select("authorid", "vec"), "authorid", "full")
    return both.select("authorid", F.coalesce("vec", "__fb").alias("vec"))


def max_field_scores(candidates: DataFrame, author_fields: DataFrame, field_vectors: DataFrame, row_vectors: DataFrame) -> DataFrame:
    """candidates with sim: the most similar of the author's fields."""
    f = author_fields.join(field_vectors.select("fieldid", F.col("vec").alias("__f")), "fieldid")
    pairs = candidates.select("rid", "authorid").distinct().join(f.select("authorid", "__f"), "authorid").join(row_vectors.select("rid", F.col("vec").alias("__r")), "rid")
    best = pairs.groupBy("rid", "authorid").agg(F.max(F.nanvl(dot(F.col("__f"), F.col("__r")), F.lit(None))).alias("sim"))
    return candidates.join(best, ["rid", "authorid"], "left")


def semantic_pick(scored: DataFrame, threshold: float, margin: float, dedupe: bool = False) -> DataFrame:
    """The best row of each rid if one alone passes the threshold or it leads the second by the margin.

    Faithful mode counts an author's rows of different match types apart; dedupe counts an author once.
    """
    passed = scored.where(F.coalesce(F.col("sim") >= threshold, F.lit(False)))
    if dedupe:
        passed = keep_first(passed, ["rid", "authorid"], [F.desc("sim"), match_rank().asc()])
    ranked = top_k(passed, ["rid"], [F.desc("sim"), F.asc("authorid"), match_rank().asc()], 2)
    second = F.max(F.when(F.col("rk") == 2, F.col("sim"))).over(Window.partitionBy("rid"))
    ranked = ranked.withColumn("__second", second)
    # compared at nine decimals, so that a margin that is met exactly isn't lost to the last bit of a sum
    good = F.col("__second").isNull() | (F.round(F.col("sim") - F.col("__second"), 9) >= margin)
    return ranked.where((F.col("rk") == 1) & good).drop("rk", "__second").withColumn("source", F.lit("round3_semantic"))


def argmax_fallback(rows: DataFrame, threshold: float) -> DataFrame:
    """One row for each rid of rows with sim and n_papers: passed first, then most papers, then the smallest id."""
    r = rows.withColumn("passed", F.coalesce(F.col("sim") >= threshold, F.lit(False))).withColumn("n_papers", F.coalesce("n_papers", F.lit(0)))
    best = keep_first(r, ["rid"], [F.desc("passed"), F.desc("n_papers"), F.asc("authorid"), match_rank().asc()])
    return best.withColumn("source", F.when(F.col("passed"), "round4_semtie").otherwise("round4_maxpapers"))


FINAL = ["rid", "name", "authorid", "match_type", "source"]


def finalise(papers: DataFrame, *layers: DataFrame) -> DataFrame:
    """One row a rid over the layers, the earliest layer first, with n_papers (0 without)."""
    out = None
    for i, layer in enumerate(layers):
        one = layer.select(*FINAL, F.lit(i).alias("__layer"))
        out = one if out is None else out.unionByName(one)
    out = keep_first(out, ["rid"], [F.asc("__layer"), match_rank().asc(), F.asc("authorid")]).drop("__layer")
    return out.join(papers, "authorid", "left").select(*FINAL, F.coalesce("n_papers", F.lit(0)).alias("n_papers"))


def floor_split(final: DataFrame, floor: int) -> tuple[DataFrame, DataFrame]:
    """(matched, held): held rows have fewer papers than the floor."""
    return final.where(F.col("n_papers") >= floor), final.where(F.col("n_papers") < floor)


def assemble(roster: DataFrame, final: DataFrame, floor: int, sources: list[str] | None = None) -> DataFrame:
    """Every roster row with author_id, blank where it has no answer of the listed sources or too few papers."""
    good = final.where(F.col("n_papers") >= floor)
    if sources:
        good = good.where(F.col("source").isin(*sources))
    return roster.join(good.select("rid", F.col("authorid").alias("author_id"), "source"), "rid", "left")
