"""The four-layer funnel and its two-layer variant as one DAG: name, institution, semantics, papers."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators import decisions as D
from spindrift.operators import linkage as L
from spindrift.operators.aggregates import distinct_papers
from spindrift.session import RegionConfig, layer


class Layers:
    """The layers, each computed when it is first asked for."""

    def __init__(self, config, roster, authors, details, affiliations, papers, author_vectors, row_vectors, same=None, title=False, author_fields=None, field_vectors=None, fallback_vectors=None):
        self.config, self.affiliations, self.papers, self.same, self.row_vectors = config, affiliations, papers, same, row_vectors
        self.fields = {"author_fields": author_fields, "field_vectors": field_vectors} if config.score == "v1" else {}
        self.vectors = author_vectors if config.score == "v1" or fallback_vectors is None else D.with_fallback(author_vectors, fallback_vectors)
        roster = layer(roster)
        self.hosts = roster.select("rid", "host_id")
        aliases = L.alias_keys(details) if config.use_alias else None
        self.names = L.Candidates(L.roster_keys(roster, title, config.guard_empty_name), L.author_keys(authors), aliases, config.use_fuzzy)

    @cached_property
    def at(self) -> DataFrame:
        return layer(L.published_at(self.affiliations, self.hosts))

    @cached_property
    def again(self) -> DataFrame:
        return layer(self.names.homonyms(self.hosts, self.at, self.same))

    @property
    def candidates(self) -> DataFrame:
        """All pairs, made anew where they are asked for; `among` and `pools` answer without them."""
        return self.names.pairs().unionByName(self.again)

    def among(self, asked: DataFrame) -> DataFrame:
        """Those of some pairs (rid, authorid) that are candidates."""
        return self.names.among(asked).unionByName(asked.join(self.again, ["rid", "authorid"], "left_semi").select("rid", "authorid")).distinct()

    def pools(self) -> DataFrame:
        """rid, pool: how many authors are candidates of a row."""
        sizes = self.names.lists().groupBy("cid").agg(F.count(F.lit(1)).alias("pool"))
        more = self.again.groupBy("rid").agg(F.countDistinct("authorid").alias("more"))
        return self.names.members.join(sizes, "cid").join(more, "rid", "left").select("rid", (F.col("pool") + F.coalesce("more", F.lit(0))).alias("pool"))

    @cached_property
    def unique(self) -> DataFrame:
        """Unique names; those whose homonyms published at the host are re-opened."""
        return layer(D.name_unique(self.names).join(self.again.select("rid").distinct(), "rid", "left_anti"))

    @cached_property
    def pending(self) -> DataFrame:
        return self.names.rows.join(self.unique.select("rid"), "rid", "left_anti")

    @cached_property
    def gated(self) -> DataFrame:
        more = self.again.join(self.hosts.where("host_id IS NOT NULL"), "rid").join(self.at, ["authorid", "host_id"], "left_semi")
        return layer(self.names.gated(self.pending.join(self.hosts, "rid"), self.at).unionByName(more.select(*L.COLUMNS, "host_id")))

    @cached_property
    def institution(self) -> DataFrame:
        return layer(D.institution_unique(self.gated))

    @cached_property
    def ties(self) -> DataFrame:
        return self.gated.join(self.institution.select("rid"), "rid", "left_anti").drop("host_id")

    @cached_property
    def nowhere(self) -> DataFrame:
        return layer(self.pending.join(self.gated.select("rid").distinct(), "rid", "left_anti"))

    @cached_property
    def counts(self) -> DataFrame:
        """authorid, n_papers of whoever may be answered."""
        ids = [x.select("authorid") for x in (self.unique, self.gated, self.names.author_side(self.nowhere))]
        return layer(distinct_papers(self.papers, ids[0].unionByName(ids[1]).unionByName(ids[2])))

    @cached_property
    def scored_ties(self) -> DataFrame:
        if self.fields:
            rows = D.max_field_scores(self.ties, **self.fields, row_vectors=self.row_vectors)
        else:
            rows = D.semantic_scores(self.ties, self.vectors, self.row_vectors)
        return layer(rows.join(self.counts, "authorid", "left").select(*L.COLUMNS, "sim", "n_papers"))

    @cached_property
    def scored_papers(self) -> DataFrame:
        """scored with n_papers.  The rows that no gate narrows are not stored: they are as many as their names' pairs."""
        return self.scored_ties.unionByName(D.scores_by_key(self.names, self.nowhere, self.counts, self.row_vectors, self.vectors, **self.fields))

    @property
    def scored(self) -> DataFrame:
        return self.scored_papers.drop("n_papers")

    @cached_property
    def semantic(self) -> DataFrame:
        threshold, margin = self.config.thresholds
        return layer(D.semantic_pick(self.scored, threshold, margin, self.config.dedupe_before_margin))

    @cached_property
    def fallback(self) -> DataFrame:
        rest = self.scored_papers.join(self.semantic.select("rid"), "rid", "left_anti")
        return layer(D.argmax_fallback(rest, self.config.thresholds[0]))

    @cached_property
    def final(self) -> DataFrame:
        return D.finalise(self.counts, self.unique, self.institution, self.semantic, self.fallback)


def run(config: RegionConfig, roster: DataFrame, authors: DataFrame, details: DataFrame, affiliations: DataFrame, papers: DataFrame, author_vectors: DataFrame | None, row_vectors: DataFrame, same=None, title: bool = False, author_fields: DataFrame | None = None, field_vectors: DataFrame | None = None, fallback_vectors: DataFrame | None = None) -> Layers:
    """roster: rid, name, host_id.  same(a, b) compares two names for re-opened homonyms; None accepts the key.

    Score v2 takes author_vectors, with fallback_vectors for authors that have none; v1 takes author_fields (authorid,
    fieldid) and field_vectors.
    """
    return Layers(config, roster, authors, details, affiliations, papers, author_vectors, row_vectors, same, title, author_fields, field_vectors, fallback_vectors)


def two_layer(keys: DataFrame, people: DataFrame, aliases: DataFrame, hosts: DataFrame, affiliations: DataFrame, papers: DataFrame) -> DataFrame:
    """Only unique names and unique institutions are answered; n_papers is information, ties stay blank."""
    found = L.Candidates(keys, people, aliases)
    hosts = layer(hosts)
    unique = layer(D.name_unique(found))
    pending = found.rows.join(unique.select("rid"), "rid", "left_anti").join(hosts, "rid")
    institution = layer(D.institution_unique(layer(found.gated(pending, L.published_at(affiliations, hosts)))))
    return D.finalise(distinct_papers(papers, unique.select("authorid").unionByName(institution.select("authorid"))), unique, institution)


def rescue(roster: DataFrame, answered: DataFrame, authors: DataFrame, hosts: DataFrame, affiliations: DataFrame, papers: DataFrame, floor: int, anchored=None, same=None) -> tuple[DataFrame, DataFrame]:
    """(matched, low confidence) for unanswered rows: surname recall, host gate, name tests; alone or most papers; floor."""
    from spindrift.operators.ranking import keep_first

    open_rows = L.unmatched(roster, answered)
    pool = L.surname_recall(open_rows, authors, hosts, affiliations)
    count = distinct_papers(papers, pool)
    ok = F.lit(True) if anchored is None else anchored(F.col("tokens"), F.col("c_tokens"))
    if same is not None:
        ok = ok & same(F.array_join("tokens", " "), F.col("sci_name"))
    pool = pool.withColumn("passes", ok).join(count, "authorid", "left").withColumn("n_papers", F.coalesce("n_papers", F.lit(0)))
    best = keep_first(pool, ["rid"], [F.desc("passes"), F.desc("n_papers"), F.asc("authorid")])
    sizes = pool.groupBy("rid").agg(F.count_if("passes").alias("n_pass"), F.count(F.lit(1)).alias("n_cand"))
    best = best.join(sizes, "rid")
    source = F.when(F.col("n_pass") == 1, "rescue_host_unique").otherwise("rescue_maxpapers")
    rows = best.select("rid", "authorid", "n_papers", "n_cand", "n_pass", "passes", source.alias("source"))
    matched = rows.where(F.col("passes") & (F.col("n_papers") >= floor))
    low = rows.where(~F.col("passes") | (F.col("n_papers") < floor)).withColumn("reason", F.when(~F.col("passes"), "host_ok_fuzzy_fail").otherwise("lowpaper"))
    return matched, low


def report(final: DataFrame, floor: int) -> str:
    """A short Markdown summary from small aggregates."""
    by = final.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_papers") < floor).alias("held")).orderBy("source").collect()
    lines = ["# Match summary", "", "| source | rows | held |", "|---|---:|---:|", *(f"| {r['source']} | {r['n']} | {r['held']} |" for r in by)]
    return "\n".join([*lines, "", f"Total {sum(r['n'] for r in by)}, held below {floor} papers {sum(r['held'] for r in by)}."]) + "\n"


def swapped_roster(rows: DataFrame, by_year: bool = False) -> DataFrame:
    """rid, name, inst, field of rows (rid, name, a, b, year): columns put right by their marks or by year, then rows
    without either anchor dropped; numbers given before stay."""
    from spindrift.functions import institutions as inst

    own, field = inst.swap_by_marks(F.col("a"), F.col("b"))
    if by_year:
        own, field = inst.swap_by_year(F.col("a"), F.col("b"), F.col("year")), inst.swap_by_year(F.col("b"), F.col("a"), F.col("year"))
    return rows.select("rid", "name", own.alias("inst"), field.alias("field")).where("inst IS NOT NULL OR field IS NOT NULL")
