"""Pairwise name comparison: the one place of the linkage that needs Python, over Arrow batches of blocked pairs.

A name becomes a list of tokens once; a pair is then judged by RULES, each of which says yes, no or nothing (None), in
order.  Equivalent given names come from the caller, as groups or as files of comma-separated rows; none are built in.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters that count as a hyphen.
HYPHENS = "­‐‑‒–—―−"
SEPARATED = str.maketrans(dict.fromkeys(HYPHENS + "-", " "))
PEOPLE = re.compile(r"[;/]| and ")


def nickname_groups(spark: SparkSession, path: str) -> list[list[str]]:
    """The groups of a file with one comma-separated group a line; blank lines and lines that begin with # don't count."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')")
    return [[name.strip() for name in r.value.split(",")] for r in lines.toLocalIterator()]


def nickname_table(groups: Iterable[Iterable[str]]) -> dict[str, frozenset[str]]:
    """name -> the union of the groups that hold it."""
    out: dict[str, frozenset[str]] = {}
    for group in groups:
        names = frozenset(n for n in (g.strip().lower() for g in group) if n)
        out |= {n: out.get(n, frozenset()) | names for n in names}
    return out


@lru_cache(1 << 16)
def tokens(name: str) -> tuple[str, ...]:
    """The comparable tokens of a name: Latin letters without marks, initials with their dot.  What stands before the
    first comma goes to the end, what stands after a second is dropped.  Empty if nothing Latin is left."""
    marked = unicodedata.normalize("NFKD", name.translate(SEPARATED)).lower().replace("ß", "ss")
    kept = "".join(c for c in marked if "a" <= c <= "z" or c in ",." or c.isspace() and c.isascii())
    last, comma, first = kept.strip().partition(",")
    turned_round = f"{first.split(',')[0]} {last}" if comma else kept
    return tuple(re.findall(r"[a-z]+\.?", turned_round))


class Pair:
    """Two token lists, aligned: as many equal tokens as the ends share, and what stands before them."""

    def __init__(self, left: tuple[str, ...], right: tuple[str, ...], nick: dict, exact: bool):
        self.left, self.right, self.nick, self.exact = left, right, nick, exact

    def fits(self, a: str, b: str) -> bool:
        """Whether two tokens at one place can be one name: an initial or beginning of the other, or a nickname.  Exact
        comparison takes only initials."""
        x, y = a.rstrip("."), b.rstrip(".")
        initial = min(len(x), len(y)) == 1
        begins = x[: len(y)] == y[: len(x)]
        return a == b or (begins if initial else not self.exact and (begins or y in self.nick.get(x, ())))

    def identical(self) -> bool | None:
        return True if self.left == self.right else None

    def lengths(self) -> bool | None:
        return False if self.exact and len(self.left) != len(self.right) else None

    def contained(self) -> bool | None:
        """One of several tokens within the other.  The right one counts in exact comparison too: a known quirk that
        results depend on."""
        a, b = " ".join(self.left), " ".join(self.right)
        return True if " " in b and b in a or not self.exact and " " in a and a in b else None

    def aligned(self) -> bool:
        """Every pair of places before the shared end fits, and places enough are matched or only initials are left."""
        ends = sum(1 for _ in takewhile(lambda t: t[0] == t[1], zip(reversed(self.left), reversed(self.right), strict=False)))
        heads = [t[: len(t) - ends] for t in (self.left, self.right)]
        places = min(map(len, heads))
        if not all(self.fits(x, y) for x, y in zip(*heads, strict=False)):
            return False
        enough = places + ends >= max(2, min(len(self.left), len(self.right)))
        return enough or all(len(t.rstrip(".")) == 1 for head in heads for t in head[places:])


RULES = (Pair.identical, Pair.lengths, Pair.contained, Pair.aligned)


def names_match(a: str | None, b: str | None, nick: dict, exact: bool = False) -> bool:
    """Only the first person of a list counts; names that leave nothing to compare match anything."""
    left, right = tokens(PEOPLE.split(str(a))[0]), tokens(str(b))
    if not left or not right:
        return True
    pair = Pair(left, right, nick, exact)
    return next(verdict for rule in RULES if (verdict := rule(pair)) is not None)


def fuzzy_ok(a: str, b: str, nick: dict) -> bool:
    """As they are, or with either turned round."""
    turned = {x: " ".join(str(x).split()[::-1]) for x in (a, b)}
    return names_match(a, b, nick) or names_match(turned[a], b, nick) or names_match(a, turned[b], nick)


def match_udf(groups: Iterable[Iterable[str]] = (), mode: str = "match", exact: bool = False):
    """A UDF (a, b) -> boolean over Arrow batches; mode is match or fuzzy (turned names too).  Null names compare as empty."""
    nick = nickname_table(groups)

    @F.arrow_udf("boolean")
    def f(a: pa.Array, b: pa.Array) -> pa.Array:
        one = (lambda x, y: names_match(x, y, nick, exact)) if mode == "match" else (lambda x, y: fuzzy_ok(x, y, nick))
        seen: dict = {}
        out = []
        for pair in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if pair not in seen:
                seen[pair] = one(pair[0] or "", pair[1] or "")
            out.append(seen[pair])
        return pa.array(out, pa.bool_())

    return f


def anchored(roster: Column, candidate: Column, nick: dict | None = None) -> Column:
    """Token arrays: every initial of the candidate is an initial of the roster name, and one full token of the candidate
    equals, starts, continues or is a nickname of a roster token; an empty candidate passes.  Stays in the JVM."""
    entries = [x for k, v in sorted((nick or {}).items()) for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))]
    known = lambda f, e: F.coalesce(F.array_contains(F.try_element_at(F.create_map(*entries), e), f), F.lit(False)) if entries else F.lit(False)
    initials = F.transform(roster, lambda t: F.substring(t, 1, 1))
    firsts = F.forall(candidate, lambda t: (F.length(t) > 1) | F.array_contains(initials, t))
    alike = lambda f, e: F.startswith(f, e) | F.startswith(e, f) | known(f, e)
    strong = F.exists(candidate, lambda f: (F.length(f) > 1) & F.exists(roster, lambda e: alike(f, e)))
    return (F.size(candidate) == 0) | (firsts & strong)
