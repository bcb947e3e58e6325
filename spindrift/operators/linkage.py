"""Candidate generation and gates.  Roster-sized sides are left to adaptive execution, which broadcasts by measured size."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import names
from spindrift.session import layer

COLUMNS = ["rid", "name", "authorid", "sci_name", "match_type"]
#: Parts over which the authors of one key are dealt where all pairs are made.
SALTS = 8


def many(rows: DataFrame) -> int:
    """A number of tasks for work that is much larger than its input."""
    spark = rows.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left and right joined on a key of large groups: the right rows of a key are dealt over SALTS parts, which left's
    rows meet all, in a number of tasks that small inputs don't reduce, since the pairs are many more than they."""
    n = many(left)
    own = left.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).repartition(n, key, "__s")
    dealt = right.withColumn("__s", F.pmod(F.xxhash64("authorid"), F.lit(SALTS)).cast("int")).repartition(n, key, "__s")
    return own.join(dealt, [key, "__s"]).drop("__s")


def with_keys(rows: DataFrame, name: Column) -> DataFrame:
    """rows with nn, ws and fl; the normal form is computed once and the other keys come from it."""
    n = rows.withColumn("nn", names.norm(name))
    return n.withColumn("ws", names.sorted_of(F.col("nn"))).withColumn("fl", names.ends_of(F.col("nn")))


def author_keys(authors: DataFrame) -> DataFrame:
    """authorid, sci_name, nn, ws, fl: all keys of the display names."""
    own = authors.select("authorid", F.col("display_name").alias("sci_name"))
    return with_keys(own.repartition(many(own), "authorid"), F.col("sci_name"))


def alias_keys(details: DataFrame) -> DataFrame:
    """authorid, sci_name, nn, ws of every alternative name (a JSON array; malformed gives none)."""
    own = details.select("authorid", "display_name_alternatives")
    each = own.repartition(many(own), "authorid").select("authorid", F.explode(F.from_json("display_name_alternatives", "array<string>")).alias("sci_name"))
    return with_keys(each, F.col("sci_name")).drop("fl")


def roster_keys(roster: DataFrame, title: bool = False, guard_empty: bool = False) -> DataFrame:
    """rid, name, nn, ws, fl; titles stripped and empty names set aside if the region says so."""
    out = with_keys(roster.where(F.col("name").isNotNull()).select("rid", "name"), names.strip_title(F.col("name")) if title else F.col("name"))
    return out.where("nn <> ''") if guard_empty else out


def key_join(roster: DataFrame, authors: DataFrame, key: str, match_type: str) -> DataFrame:
    found = spread_join(roster.select("rid", "name", key), authors.select("authorid", "sci_name", key), key)
    return found.select("rid", "name", "authorid", "sci_name", F.lit(match_type).alias("match_type"))


def or_equi_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], by_name: bool = False) -> DataFrame:
    """Distinct rows that agree on any of the column pairs: a union of hash joins, never a nested loop.

    by_name: the columns follow from the names, so the sides are made distinct and a later join leaves out what an
    earlier one finds, in place of making the pairs distinct.
    """
    if by_name:
        left = left.select("rid", "name", *(a for a, _ in pairs)).distinct()
        right = right.select("authorid", "sci_name", *(b for _, b in pairs)).distinct()
    out = None
    for i, (a, b) in enumerate(pairs):
        found = spread_join(left.withColumn("__k", F.col(a)), right.withColumn("__k", F.col(b)), "__k")
        for c, d in pairs[:i] if by_name else []:
            found = found.where(~F.col(c).eqNullSafe(F.col(d)) | F.col(c).isNull())
        one = found.select("rid", "name", "authorid", "sci_name")
        out = one if out is None else out.unionByName(one)
    return out if by_name else out.distinct()


def alias_match(roster: DataFrame, aliases: DataFrame) -> DataFrame:
    """Pairs of equal nn or ws.  ws is made of nn's tokens, so equal nn have equal ws and one join finds all."""
    return key_join(roster.select("rid", "name", "ws").distinct(), aliases.select("authorid", "sci_name", "ws").distinct(), "ws", "alias")


def fuzzy_match(roster: DataFrame, authors: DataFrame, found: DataFrame) -> DataFrame:
    """First-and-last-token candidates of the rows that have none yet."""
    return key_join(roster.join(found.select("rid").distinct(), "rid", "left_anti"), authors, "fl", "fuzzy")


def build_index(authors: DataFrame, aliases: DataFrame, path: str) -> None:
    """The prepared name index: authorid, sci_name, nn, ws by kind."""
    rows = authors.select(F.lit("exact").alias("kind"), "authorid", "sci_name", "nn", "ws").unionByName(aliases.select(F.lit("alias").alias("kind"), "authorid", "sci_name", "nn", "ws"))
    rows.write.mode("overwrite").partitionBy("kind").parquet(path)


def index_match(roster: DataFrame, index: DataFrame, kind: str) -> DataFrame:
    """Candidates of one kind over the index; only that kind's files are read."""
    own = index.where(F.col("kind") == kind)
    if kind == "alias":
        return alias_match(roster, own)
    return key_join(roster, own, "nn", kind)


def published_at(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """authorid, host_id: distinct pairs of the hosts in question."""
    e = edges.where(F.col("institutionid").isNotNull()).select("authorid", F.col("institutionid").alias("host_id"))
    return e.join(hosts.where(F.col("host_id").isNotNull()).select("host_id").distinct(), "host_id", "left_semi").distinct()


class Candidates:
    """The candidates of a roster (rid, name, nn, ws, fl) by their keys: exact, alias, and fuzzy for rows without either.

    A name that many authors share makes many pairs, so pairs are made only behind the institution gate, for pairs in
    question, or for rows that need them all; what a row's whole list decides comes from aggregates of its keys.
    """

    def __init__(self, keys: DataFrame, people: DataFrame, aliases: DataFrame | None = None, fuzzy: bool = False):
        self.keys, self.fuzzy = layer(keys), fuzzy
        self.people = layer(people.select("authorid", "sci_name", "nn", "ws", "fl"))
        self.aliases = None if aliases is None else layer(aliases.select("authorid", "sci_name", "ws").distinct())

    @cached_property
    def rows(self) -> DataFrame:
        """keys with the least and largest author of their exact (e_lo, e_hi) and of their alias names (a_lo, a_hi)."""
        ends = lambda t, key, x: t.groupBy(key).agg(F.min("authorid").alias(f"{x}_lo"), F.max("authorid").alias(f"{x}_hi"))
        out = self.keys.join(ends(self.people, "nn", "e"), "nn", "left")
        if self.aliases is not None:
            return layer(out.join(ends(self.aliases, "ws", "a"), "ws", "left").withColumn("named", F.coalesce("e_lo", "a_lo").isNotNull()))
        return layer(out.withColumn("a_lo", F.nullif("e_lo", "e_lo")).withColumn("a_hi", F.nullif("e_hi", "e_hi")).withColumn("named", F.col("e_lo").isNotNull()))

    def unique(self) -> DataFrame:
        """Exact rows of the rows with one author over exact and alias names and an exact hit."""
        one = F.col("e_lo").isNotNull() & (F.least("e_lo", "a_lo") == F.greatest("e_hi", "a_hi"))
        found = self.rows.where(one).select("rid", "name", "nn", F.col("e_lo").alias("authorid")).join(self.people.select("authorid", "sci_name", "nn"), ["nn", "authorid"])
        return found.select("rid", "name", "authorid", "sci_name", F.lit("exact").alias("match_type"))

    def pairs(self, rows: DataFrame | None = None) -> DataFrame:
        """Every candidate of the rows (of all): as many as there are."""
        rows = self.rows if rows is None else rows
        out = key_join(rows, self.people, "nn", "exact")
        if self.aliases is not None:
            out = out.unionByName(alias_match(rows, self.aliases))
        return out.unionByName(key_join(rows.where("NOT named"), self.people, "fl", "fuzzy")) if self.fuzzy else out

    def gated(self, rows: DataFrame, at: DataFrame) -> DataFrame:
        """The candidates of rows (with host_id) who published there (at: authorid, host_id), with host_id."""
        rows = rows.where(F.col("host_id").isNotNull())

        def found(own: DataFrame, authors: DataFrame, key: str, match_type: str) -> DataFrame:
            there = authors.join(own.select(key).distinct(), key, "left_semi").join(at, "authorid")
            both = own.select("rid", "name", key, "host_id").join(there.select("authorid", "sci_name", key, "host_id"), [key, "host_id"])
            return both.select(*COLUMNS[:-1], F.lit(match_type).alias("match_type"), "host_id")

        out = found(rows, self.people, "nn", "exact")
        if self.aliases is not None:
            out = out.unionByName(found(rows.select("rid", "name", "ws", "host_id").distinct(), self.aliases, "ws", "alias"))
        return out.unionByName(found(rows.where("NOT named"), self.people, "fl", "fuzzy")) if self.fuzzy else out

    def homonyms(self, hosts: DataFrame, at: DataFrame, same=None) -> DataFrame:
        """Further authors of a named row's first and last token who published at its host: key and gate first, the
        pairwise comparison (a UDF of two names) last, on what is left."""
        rows = self.rows.where("named").join(hosts.where(F.col("host_id").isNotNull()), "rid").select("rid", "name", "nn", "ws", "fl", "host_id")
        there = self.people.select("authorid", "sci_name", "fl").join(rows.select("fl").distinct(), "fl", "left_semi").join(at, "authorid")
        found = rows.join(there, ["fl", "host_id"]).join(self.people.select("authorid", "nn"), ["authorid", "nn"], "left_anti")
        if self.aliases is not None:
            found = found.join(self.aliases.select("authorid", "ws"), ["authorid", "ws"], "left_anti")
        if same is not None:
            found = found.where(same("name", "sci_name"))
        return found.select("rid", "name", "authorid", "sci_name", F.lit("fuzzy").alias("match_type")).distinct()

    def among(self, asked: DataFrame) -> DataFrame:
        """Those of some pairs (rid, authorid) that are candidates, once each."""
        k = asked.select("rid", "authorid").join(self.rows, "rid")
        out = k.join(self.people.select("authorid", "nn"), ["authorid", "nn"], "left_semi").select("rid", "authorid")
        if self.aliases is not None:
            out = out.unionByName(k.join(self.aliases.select("authorid", "ws"), ["authorid", "ws"], "left_semi").select("rid", "authorid"))
        if self.fuzzy:
            out = out.unionByName(k.where("NOT named").join(self.people.select("authorid", "fl"), ["authorid", "fl"], "left_semi").select("rid", "authorid"))
        return out.distinct()

    @cached_property
    def members(self) -> DataFrame:
        """rid, cid: rows of one normal form, and if need be of one first and last token, have the same candidates."""
        if not self.fuzzy:
            return self.rows.select("rid", F.col("nn").alias("cid"))
        return self.rows.select("rid", F.concat(F.when(F.col("named"), F.lit("n")).otherwise(F.lit("f")), F.when(F.col("named"), F.col("nn")).otherwise(F.col("fl"))).alias("cid"))

    def lists(self) -> DataFrame:
        """cid, authorid: the distinct candidates of each of `members`' classes, each list once however many rows have it."""
        mark = lambda c, x: F.concat(F.lit(x), F.col(c)).alias("cid") if self.fuzzy else F.col(c).alias("cid")
        named = self.rows.where("named").select("nn", "ws").distinct()
        out = named.select("nn").distinct().join(self.people, "nn").select(mark("nn", "n"), "authorid")
        if self.aliases is not None:
            out = out.unionByName(named.join(self.aliases, "ws").select(mark("nn", "n"), "authorid"))
        if self.fuzzy:
            out = out.unionByName(self.rows.where("NOT named").select("fl").distinct().join(self.people, "fl").select(mark("fl", "f"), "authorid"))
        return out.distinct()

    def author_side(self, rows: DataFrame) -> DataFrame:
        """k, authorid, found (nn, sci_name, match_type of each): the authors behind the keys of rows (see `keyed`)."""
        wanted = keyed(rows).select("k").distinct()
        entry = lambda t, key, x, nn, m: t.select(F.concat(F.lit(x), F.col(key)).alias("k"), "authorid", F.struct(nn.alias("nn"), "sci_name", F.lit(m).alias("match_type")).alias("e"))
        none = F.lit(None).cast("string")
        out = entry(self.people, "ws", "w", F.col("nn"), "exact")
        if self.aliases is not None:
            out = out.unionByName(entry(self.aliases, "ws", "w", none, "alias"))
        if self.fuzzy:
            out = out.unionByName(entry(self.people, "fl", "f", none, "fuzzy"))
        return out.join(wanted, "k", "left_semi").groupBy("k", "authorid").agg(F.collect_list("e").alias("found"))


def keyed(rows: DataFrame) -> DataFrame:
    """rows with k, the key that all their candidates share: the sorted tokens, or the first and last of unnamed rows."""
    return rows.withColumn("k", F.when(F.col("named"), F.concat(F.lit("w"), F.col("ws"))).otherwise(F.concat(F.lit("f"), F.col("fl"))))


def in_either(rows: DataFrame, first: str, second: str, ids: DataFrame) -> DataFrame:
    """Rows whose first or second key is among ids: two semi joins and a union that counts a row once."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
    a = rows.join(ids, F.col(first) == F.col("__id"), "left_semi")
    rest = rows.join(ids, F.col(first) == F.col("__id"), "left_anti").join(ids, F.col(second) == F.col("__id"), "left_semi")
    return a.unionByName(rest)


def surname_recall(roster: DataFrame, authors: DataFrame, hosts: DataFrame, edges: DataFrame, anchored=None) -> DataFrame:
    """rid, authorid, sci_name, tokens, c_tokens of authors whose last token is a surname candidate of the row and who
    published at its host; the gate comes before any pairwise test."""
    rows = roster.select("rid", names.clean_tokens(F.col("name")).alias("tokens"))
    keys = rows.select("rid", "tokens", F.explode(names.surname_candidates(F.col("tokens"))).alias("last"))
    people = authors.select("authorid", F.col("display_name").alias("sci_name"), names.surname(F.col("display_name")).alias("last"))
    found = keys.join(people, "last").join(hosts.where(F.col("host_id").isNotNull()), "rid")
    found = found.join(published_at(edges, hosts), ["authorid", "host_id"], "left_semi")
    found = found.select("rid", "host_id", "authorid", "sci_name", "tokens", names.clean_tokens(F.col("sci_name")).alias("c_tokens")).distinct()
    return found.where(anchored(F.col("tokens"), F.col("c_tokens"))) if anchored else found


def propagate(resolved: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows without an answer take the answer (authorid) of a resolved row of the same key: the one with the largest rid."""
    known = resolved.join(rows, "rid").groupBy(*key).agg(F.max_by("authorid", "rid").alias("authorid"))
    return rows.join(resolved.select("rid"), "rid", "left_anti").join(known, key).select("rid", *key, "authorid")


def unmatched(roster: DataFrame, *answered: DataFrame) -> DataFrame:
    for a in answered:
        roster = roster.join(a.select("rid").distinct(), "rid", "left_anti")
    return roster


def prefer(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: the first source's answer, else the second's; keys without either go."""
    both = first.select(key, F.col(value).alias("__a")).join(second.select(key, F.col(value).alias("__b")), key, "full_outer")
    return both.select(key, F.coalesce("__a", "__b").alias(value)).where(F.col(value).isNotNull())


def lookup(ids: DataFrame, table: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """Every id with the table's columns and found (boolean)."""
    own = table.select(key.alias("__k"), *columns)
    out = ids.join(own, F.col(ids.columns[0]) == F.col("__k"), "left")
    return out.withColumn("found", F.col("__k").isNotNull()).drop("__k")
