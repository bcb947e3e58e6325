"""Recall, accuracy, precision by source, gating rules, threshold grids and ceilings in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.aggregates import distribution, rate


def of_rows(answers: DataFrame, members: DataFrame | None) -> DataFrame:
    """Answers of classes of rows (their cid in rid) as answers of the rows (members: rid, cid)."""
    return answers if members is None else answers.withColumnRenamed("rid", "cid").join(members, "cid").drop("cid")


def recall(gold: DataFrame, candidates: DataFrame, resolvable: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """n_gold, recalled, recall and pool statistics over the candidates of gold rids.

    With members (rid, cid) the candidates are those of classes, with cid in rid, here and in the sweeps below.
    """
    pool = candidates.select("rid", "authorid").distinct()
    asked = gold if members is None else gold.join(members, "rid").select("authorid", F.col("rid").alias("__r"), F.col("cid").alias("rid"))
    hit = asked.join(pool, ["rid", "authorid"], "left_semi").select(F.col("rid" if members is None else "__r").alias("rid"), F.lit(True).alias("hit"))
    sizes = of_rows(pool.groupBy("rid").agg(F.count(F.lit(1)).alias("pool")), members)
    rows = gold.join(hit, "rid", "left").join(sizes, "rid", "left")
    if resolvable is not None:
        rows = rows.join(resolvable.select("authorid").distinct(), "authorid", "left_semi")
    return rows.agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("recalled"), rate(F.col("hit")).alias("recall"), F.percentile("pool", F.lit(0.5)).alias("pool_median"), F.avg("pool").alias("pool_mean"), F.percentile("pool", F.lit(0.9)).alias("pool_p90"))


def precision_by_source(gold: DataFrame, final: DataFrame) -> DataFrame:
    rows = final.join(gold.select("rid", F.col("authorid").alias("gold")), "rid")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("authorid") == F.col("gold")).alias("correct"), rate(F.col("authorid") == F.col("gold")).alias("precision"))


def error_classes(gold: DataFrame, candidates: DataFrame, final: DataFrame, known: DataFrame) -> DataFrame:
    """outcome, n of gold rows: correct, unresolvable_gold, not_recalled, disambig_wrong or unanswered.  Of the candidates
    only gold pairs count, so those are enough."""
    pool = candidates.select("rid", "authorid").distinct().withColumn("in_pool", F.lit(True))
    rows = gold.join(pool, ["rid", "authorid"], "left").join(final.select("rid", F.col("authorid").alias("answer")), "rid", "left")
    rows = rows.join(known.select("authorid").distinct().withColumn("known", F.lit(True)), "authorid", "left")
    outcome = F.when(F.col("answer") == F.col("authorid"), "correct").when(F.col("known").isNull(), "unresolvable_gold").when(F.col("in_pool").isNull(), "not_recalled").when(F.col("answer").isNull(), "unanswered").otherwise("disambig_wrong")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def rule_sweep(rows: DataFrame, correct: Column, rules: dict[str, Column]) -> DataFrame:
    """rule, n, correct, precision, coverage of every rule, counted together in one pass."""
    each = []
    for name, rule in rules.items():
        ok = F.coalesce(rule, F.lit(False))
        each.append(F.struct(F.lit(name).alias("rule"), F.count_if(ok).alias("n"), F.count_if(ok & F.coalesce(correct, F.lit(False))).alias("correct")))
    one = rows.agg(F.count(F.lit(1)).alias("total"), F.array(*each).alias("r"))
    out = one.select("total", F.explode("r").alias("r")).select("r.*", "total")
    return out.select("rule", "n", "correct", (F.col("correct") / F.nullif(F.col("n"), F.lit(0))).alias("precision"), (F.col("n") / F.nullif(F.col("total"), F.lit(0))).alias("coverage"))


def margin_sweep(rows: DataFrame, margin: str, correct: Column, steps: list[int]) -> DataFrame:
    """step, n, correct of rows whose margin reaches the step."""
    each = rows.select(F.col(margin).alias("m"), F.coalesce(correct, F.lit(False)).alias("ok"), F.explode(F.array(*map(F.lit, steps))).alias("step"))
    return each.groupBy("step").agg(F.count_if(F.col("m") >= F.col("step")).alias("n"), F.count_if((F.col("m") >= F.col("step")) & F.col("ok")).alias("correct"))


def threshold_grid(scored: DataFrame, gold: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """threshold, margin, answered, correct: the semantic pick replayed on the grid.

    Two rows of each rid, the best and the second, decide every cell, so the grid multiplies rids and not candidates.
    """
    from spindrift.operators.ranking import top_k

    best = top_k(scored.where(F.col("sim").isNotNull()), ["rid"], [F.desc("sim"), F.asc("authorid")], 2)
    pair = best.groupBy("rid").agg(F.max("sim").alias("s1"), F.max(F.when(F.col("rk") == 2, F.col("sim"))).alias("s2"), F.max(F.when(F.col("rk") == 1, F.col("authorid"))).alias("top"))
    pair = pair.join(gold.select("rid", F.col("authorid").alias("gold")), "rid")
    grid = pair.select("*", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(m).alias("margin")) for t in thresholds for m in margins))).alias("g")).select("*", "g.*")
    alone = F.col("s2").isNull() | (F.col("s2") < F.col("threshold"))
    good = (F.col("s1") >= F.col("threshold")) & (alone | (F.round(F.col("s1") - F.col("s2"), 9) >= F.col("margin")))
    return grid.groupBy("threshold", "margin").agg(F.count_if(good).alias("answered"), F.count_if(good & (F.col("top") == F.col("gold"))).alias("correct"))


def compare(rows: DataFrame, value: str, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(value).alias("n"), *distribution(value))


def top_is_gold(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """n, top_is_gold: how often the most similar candidate is the right one."""
    from spindrift.operators.ranking import keep_first

    best = keep_first(scored.where(F.col("sim").isNotNull()), ["rid"], [F.desc("sim"), F.asc("authorid")])
    rows = best.join(gold.select("rid", F.col("authorid").alias("gold")), "rid")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("authorid") == F.col("gold")).alias("top_is_gold"))


def oracle_fields(candidates: DataFrame, gold: DataFrame, top_fields: DataFrame, papers: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """n, correct: arg-max papers among candidates that share a top field with the gold author, all if none does."""
    from spindrift.operators.ranking import filter_or_all, keep_first

    sets = top_fields.groupBy("authorid").agg(F.sort_array(F.collect_set("fieldid")).alias("f"))
    g = gold.select("rid", F.col("authorid").alias("gold")).join(sets.select(F.col("authorid").alias("gold"), F.col("f").alias("gf")), "gold", "left")
    g = g.select("rid", "gold", F.coalesce("gf", F.array().cast("array<string>")).alias("gf"))
    pool = candidates.select("rid", "authorid").distinct()
    # rows of one class and one set of gold fields have the same answer
    asked = g if members is None else g.join(members, "rid").select("gold", "gf", F.col("cid").alias("rid"))
    rows = pool.join(asked.select("rid", "gf").distinct(), "rid").join(sets, "authorid", "left").join(papers, "authorid", "left")
    kept = filter_or_all(rows, ["rid", "gf"], F.arrays_overlap("f", "gf"))
    best = keep_first(kept, ["rid", "gf"], [F.desc_nulls_last("n_papers"), F.asc("authorid")]).select("rid", "gf", "authorid").join(asked, ["rid", "gf"])
    return best.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("authorid") == F.col("gold")).alias("correct"))


def evidence_rule(rows: DataFrame, flag: Column, gold: DataFrame, papers: str | None = None, members: DataFrame | None = None) -> DataFrame:
    """answered, correct: rids with one flagged candidate, or, with a count of papers, the flagged one that has most."""
    from spindrift.operators.ranking import keep_first

    hit = rows.where(F.coalesce(flag, F.lit(False)))
    if papers:
        picks = keep_first(hit, ["rid"], [F.desc_nulls_last(papers), F.asc("authorid")]).select("rid", "authorid")
    else:
        picks = hit.groupBy("rid").agg(F.min("authorid").alias("authorid"), F.max("authorid").alias("hi")).where("authorid = hi").select("rid", "authorid")
    out = of_rows(picks, members).join(gold.select("rid", F.col("authorid").alias("gold")), "rid")
    return out.agg(F.count(F.lit(1)).alias("answered"), F.count_if(F.col("authorid") == F.col("gold")).alias("correct"))


def filter_sweep(rows: DataFrame, value: str, floors: list[float], order: str, gold: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """floor, n, correct: arg-max of `order` among candidates whose value reaches the floor, among all if none does."""
    from spindrift.operators.ranking import filter_or_all, keep_first

    each = rows.withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    kept = filter_or_all(each, ["floor", "rid"], F.col(value) >= F.col("floor"))
    best = keep_first(kept, ["floor", "rid"], [F.desc_nulls_last(order), F.asc("authorid")])
    return of_rows(best, members).join(gold.select("rid", F.col("authorid").alias("gold")), "rid").groupBy("floor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("authorid") == F.col("gold")).alias("correct"))


def prototype_accuracy(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """n, strict, ties, loose: the right candidate's best score above, equal to, or not below the best of the others."""
    rows = scored.where(F.col("sim").isNotNull()).join(gold.select("rid", F.col("authorid").alias("gold")), "rid")
    best = rows.groupBy("rid").agg(F.max(F.when(F.col("authorid") == F.col("gold"), F.col("sim"))).alias("g"), F.max(F.when(F.col("authorid") != F.col("gold"), F.col("sim"))).alias("o")).where("g IS NOT NULL")
    other = F.coalesce("o", F.lit(float("-inf")))
    return best.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("g") > other).alias("strict"), F.count_if(F.col("g") == other).alias("ties"), F.count_if(F.col("g") >= other).alias("loose"))
