"""Quality rules as a bitmask ledger: every rule is evaluated once, policies are masks over the stored bits.

`ledger` adds the measurements and `fail_bits` (bit i set: rule i failed) to each document with DataFrame functions
only, in one pass and without a shuffle.  `apply_policy` turns the bits into a verdict by a versioned mask, so a new
policy needs no second look at the text; `ablation` counts by bitwise aggregation what each rule of a policy adds.

Null, empty or blank texts have no words: every measurement is 0 and `too_few_words` fails.  Repeated rows are judged
alike; extra columns pass through, except that columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import SPACES

SYMBOLS = "#*$%&|<>"

#: name -> failing condition over the measurements.  The position is the bit and never changes; new rules go last.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "long_words": "word_chars > 15 * n_words",
    "short_words": "word_chars < 2 * n_words",
}
BIT = {name: i for i, name in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


BASE = ("too_few_words", "repeated_windows")
#: version -> rules that reject.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbol_heavy", "repeated_lines"),
    "v2": (*BASE, "symbol_heavy", "repeated_lines", "long_words", "short_words"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """The maximal runs without ASCII white space, in order."""
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def repeat_words(w: Column) -> Column:
    """How many words stand in a 3-word window that the array w has twice or more.

    The windows are sorted with their positions, so equal ones are neighbours; linear memory, no shuffle, no join.
    """
    windows = F.zip_with(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)), F.slice(w, 3, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    ranked = F.sort_array(F.filter(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda x: x["g"].isNotNull()))

    def starts(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
        return F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))

    covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(let(ranked, starts), covered)).cast("long")


def let(value: Column, f) -> Column:
    """f(value) with value computed once, however often f names it (an optimiser must not copy it)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def measures(text: Column) -> Column:
    """A struct of MEASURES."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
        return F.struct(
            let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))).alias("w"),
            F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        )

    return let(F.coalesce(text, F.lit("")), of)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES and fail_bits (bigint); the text column goes on unchanged."""
    kept = [c for c in docs.columns if c not in (*MEASURES, "fail_bits")]
    found = docs.select(*kept, measures(F.col(text)).alias("__m"))
    out = found.select(
        *kept,
        *(F.col(f"__m.{g}{c}").alias(c) for g, c in (("w.", "n_words"), ("", "word_chars"), ("", "n_symbols"), ("l.", "n_lines"), ("l.", "n_dup_lines"), ("w.", "n_repeat_words"))),
    )
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, version: str = "v2", column: str = "kept") -> DataFrame:
    """led with a verdict: true where no rule of the policy failed."""
    return led.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(mask_of(*POLICIES[version])).cast("long")) == 0)


def ablation(led: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of the policy: documents that fail it, and those that no other rule of the policy rejects."""
    mask = mask_of(*POLICIES[version])
    under = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    counts = led.select(under.alias("b")).groupBy("b").count()
    rows = [F.struct(F.lit(n).alias("rule"), F.lit(1 << BIT[n]).cast("long").alias("bit")) for n in POLICIES[version]]
    return (
        counts.select("b", "count", F.explode(F.array(*rows)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("b").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("b") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"),
        )
    )
