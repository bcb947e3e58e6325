"""Diagnostics around the evaluation: addressable rows, label filters, flips, recommendations, worklists and ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators.ranking import filter_or_all, keep_first


def resolvable(gold: DataFrame, known: DataFrame) -> DataFrame:
    """gold with resolvable: whether its author is known at all."""
    flag = known.select("authorid").distinct().withColumn("resolvable", F.lit(True))
    return gold.join(flag, "authorid", "left").withColumn("resolvable", F.coalesce("resolvable", F.lit(False)))


def host_survivors(gold: DataFrame, candidates: DataFrame, gated: DataFrame) -> DataFrame:
    """gold with in_pool and survives: whether its author is a candidate, and still one behind the institution gate."""
    mark = lambda rows, name: rows.select("rid", "authorid").distinct().withColumn(name, F.lit(True))
    both = gold.join(mark(candidates, "in_pool"), ["rid", "authorid"], "left").join(mark(gated, "survives"), ["rid", "authorid"], "left")
    return both.select("rid", "authorid", F.col("in_pool").isNotNull().alias("in_pool"), F.col("survives").isNotNull().alias("survives"))


def addressable(gold: DataFrame, gated: DataFrame) -> DataFrame:
    """The gold rows whose author survives the institution gate."""
    return gold.join(gated.select("rid", "authorid").distinct(), ["rid", "authorid"], "left_semi")


def first_text(rows: DataFrame, by: str, text: str, order: str) -> DataFrame:
    """by, text: the first text of each group that isn't null, by an explicit order."""
    return rows.where(F.col(text).isNotNull()).groupBy(by).agg(F.min_by(text, order).alias(text))


def label_filter_sweep(candidates: DataFrame, labels: DataFrame, wanted: DataFrame, papers: DataFrame, gold: DataFrame, ks: list[int], members: DataFrame | None = None) -> DataFrame:
    """k, n, correct: most papers among candidates that have the row's wanted label (rid, fieldid) among their top k
    labels (authorid, fieldid, rk), among all if none has it.  With members (rid, cid) the candidates are those of
    classes, with cid in rid; rows of one class and one wanted label have the same answer."""
    pool = candidates.select("rid", "authorid").distinct()
    rids = pool.select("rid").distinct() if members is None else members
    of = rids.join(wanted.select("rid", "fieldid"), "rid", "left").select("rid", F.col("rid" if members is None else "cid").alias("cid"), F.col("fieldid").alias("label"))
    classes = of.select(F.col("cid").alias("rid"), "label").distinct()
    rows = pool.join(papers, "authorid", "left").join(classes, "rid").join(labels.withColumnRenamed("fieldid", "label"), ["authorid", "label"], "left")
    each = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    kept = filter_or_all(each, ["k", "rid", "label"], F.col("rk") <= F.col("k"))
    best = keep_first(kept, ["k", "rid", "label"], [F.desc_nulls_last("n_papers"), F.asc("authorid")]).select("k", F.col("rid").alias("c"), F.col("label").alias("l"), "authorid")
    answers = of.join(best, (F.col("c") == F.col("cid")) & F.col("l").eqNullSafe(F.col("label"))).select("k", "rid", "authorid")
    rows = answers.join(gold.select("rid", F.col("authorid").alias("gold")), "rid")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("authorid") == F.col("gold")).alias("correct"))


def flips(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """kept_right, kept_wrong, gained, lost: answers (rid, authorid) that a change of rule turned right or wrong."""
    rows = gold.join(before.select("rid", F.col("authorid").alias("b")), "rid").join(after.select("rid", F.col("authorid").alias("a")), "rid")
    was, now = F.col("b") == F.col("authorid"), F.col("a") == F.col("authorid")
    return rows.agg(F.count_if(was & now).alias("kept_right"), F.count_if(~was & ~now).alias("kept_wrong"), F.count_if(~was & now).alias("gained"), F.count_if(was & ~now).alias("lost"))


def gold_margin(values: DataFrame, answers: DataFrame, gold: DataFrame, value: str) -> DataFrame:
    """rid, margin: the right author's value (authorid, value) less the answered one's, where the answer is wrong."""
    v = lambda name: values.select(F.col("authorid").alias(name), F.col(value).alias(f"{name}_value"))
    rows = gold.select("rid", F.col("authorid").alias("gold")).join(answers.select("rid", F.col("authorid").alias("pred")), "rid").where("gold <> pred")
    rows = rows.join(v("gold"), "gold", "left").join(v("pred"), "pred", "left")
    return rows.select("rid", (F.coalesce("gold_value", F.lit(0)) - F.coalesce("pred_value", F.lit(0))).alias("margin"))


def recommended(grid: DataFrame, least: float, order: list[Column] | None = None) -> DataFrame:
    """Of a threshold grid (threshold, margin, answered, correct) the cell that answers most at a precision of `least`."""
    rows = grid.where(F.col("answered") > 0).withColumn("precision", F.col("correct") / F.col("answered")).where(F.col("precision") >= least)
    return rows.orderBy(*(order or [F.desc("answered"), F.desc("precision"), F.asc("threshold"), F.asc("margin")])).limit(1)


def language_rules(counts: DataFrame, by: str, holder: str, n: str, floors: list[int], shares: list[float]) -> DataFrame:
    """rule, value, by, holder: groups with one holder left whose n reaches a floor, or whose share of its own n does."""
    from spindrift.operators.ranking import share

    rows = counts.withColumn("share", share(counts, holder, n))
    each = [F.struct(F.lit("floor").alias("rule"), F.lit(float(f)).alias("value"), (F.col(n) >= f).alias("ok")) for f in floors]
    each += [F.struct(F.lit("share").alias("rule"), F.lit(float(s)).alias("value"), (F.col("share") >= s).alias("ok")) for s in shares]
    hit = rows.select(by, holder, F.explode(F.array(*each)).alias("r")).select(by, holder, "r.*").where("ok")
    one = hit.groupBy("rule", "value", by).agg(F.min(holder).alias(holder), F.max(holder).alias("hi"))
    return one.where(F.col(holder) == F.col("hi")).drop("hi")


def worklist(roster: DataFrame, pool: DataFrame, final: DataFrame) -> DataFrame:
    """rid, pool, sole, of pool (rid, pool: its number of candidates): unanswered rows with candidates, the smallest pools first to look up; sole holders stand alone."""
    return roster.select("rid").join(final.select("rid"), "rid", "left_anti").join(pool, "rid").select("rid", "pool", (F.col("pool") == 1).alias("sole"))


def ceilings(gold: DataFrame, candidates: DataFrame, gated: DataFrame, final: DataFrame) -> DataFrame:
    """n_gold, in_pool, behind_gate, answered_right: what any rule could reach at each step, and what was."""
    rows = host_survivors(gold, candidates, gated).join(final.select("rid", F.col("authorid").alias("answer")), "rid", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_gold"), F.count_if("in_pool").alias("in_pool"), F.count_if("survives").alias("behind_gate"), F.count_if(F.col("answer") == F.col("authorid")).alias("answered_right"))


def field_mapping(rows: DataFrame, prototypes: DataFrame, text: str = "field_text") -> DataFrame:
    """rid, text, label of each row, for looking at: the label that its text names, null where none does."""
    known = prototypes.select(F.col("label"), F.lower("label").alias("__k")).distinct()
    return rows.select("rid", text).join(known, F.lower(F.trim(text)) == F.col("__k"), "left").select("rid", text, "label")


def prototype_of(rows: DataFrame, prototypes: DataFrame, text: str = "field_text", vec: str = "vec") -> DataFrame:
    """rid, label, sim: the prototype that a row's text names, else the nearest one to its vector."""
    from spindrift.functions.vectors import nearest

    named = field_mapping(rows, prototypes, text).where("label IS NOT NULL").select("rid", "label", F.lit(None).cast("double").alias("sim"))
    rest = rows.join(named.select("rid"), "rid", "left_anti").select("rid", F.col(vec).alias("vec"))
    return named.unionByName(nearest(rest, prototypes.select("label", "vec"), 1, "rid").select("rid", "label", "sim"))


def labelled_texts(spark, path: str, split: str | None = None) -> DataFrame:
    """A labelled-text dataset (text, label, split) from a Parquet folder, one split of it if named."""
    df = spark.read.parquet(path)
    return (df.where(F.col("split") == split) if split else df).select("text", "label")
