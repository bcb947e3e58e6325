"""Name keys and text expressions as Columns: everything stays in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hyphen and dash family that separates name parts.
HYPHENS = r"[\x{2D}\x{AD}\x{2010}-\x{2015}\x{2212}]"


@lru_cache(1)
def accent_map() -> tuple[str, str]:
    """(accented, base): BMP characters whose canonical decomposition is one base character and marks."""
    accented, base = [], []
    for code in range(0xC0, 0x10000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xF8FF:
            continue
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and not unicodedata.combining(parts[0]) and all(unicodedata.category(x)[0] == "M" for x in parts[1:]):
            accented.append(c)
            base.append(parts[0])
    return "".join(accented), "".join(base)


def strip_accents(x: Column) -> Column:
    """Canonical decomposition without marks; ligatures, stroked letters and eszett stay."""
    return F.regexp_replace(F.translate(x, *accent_map()), r"\p{M}+", "")


def lower(x: Column) -> Column:
    """Lower case with every capital sigma to the same small one."""
    return F.lower(F.translate(x, "Σ", "σ"))


def trim_blanks(x: Column) -> Column:
    return F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+$", "")


def norm(x: Column, strip_periods: bool = False) -> Column:
    """The name key: hyphens to blanks, no accents, lower case, trimmed, white space collapsed (in this order)."""
    x = F.regexp_replace(x, HYPHENS, " ")
    if strip_periods:
        x = F.regexp_replace(x, r"\.", " ")
    return F.regexp_replace(trim_blanks(lower(strip_accents(x))), r"\s+", " ")


def first_last(x: Column) -> Column:
    """First and last token of norm(x) with a bar between; a lone bar for an empty name."""
    return ends_of(norm(x))


def ends_of(n: Column) -> Column:
    return F.concat(F.regexp_extract(n, r"^([^ ]*)", 1), F.lit("|"), F.regexp_extract(n, r"([^ ]*)$", 1))


def word_set(x: Column, strip_periods: bool = False) -> Column:
    """The tokens of norm(x) in order of their bytes."""
    return sorted_of(norm(x, strip_periods))


def sorted_of(n: Column) -> Column:
    return F.array_join(F.sort_array(F.split(n, " ")), " ")


#: Academic titles that lead a name.
TITLES = "a/prof assoc/prof em/prof emer/prof adj/prof adj/assoc/prof hon/prof asst/prof professor prof emeritus adjunct adj assistant asst associate assoc honorary hon dr".split()


def strip_title(x: Column) -> Column:
    """Without the run of academic titles at the start, each followed by white space."""
    return F.regexp_replace(x, r"(?i)^(?:(?:" + "|".join(TITLES) + r")\.?\s+)+", "")


def camel_split(x: Column) -> Column:
    """A blank between a small and a capital letter that follow one another."""
    return F.regexp_replace(x, r"(\p{Ll})(\p{Lu})", "$1 $2")


def surname(x: Column) -> Column:
    """The last token of the camel-split, normalised name."""
    return F.element_at(F.split(norm(camel_split(x)), " "), -1)


#: What name cleaning drops.
HONORIFICS = "dr prof professor mr mrs ms ing".split()
MARRIED = "geb geborne geborene ep epouse nee verw".split()
SUFFIXES = "jr sr ii iii iv".split()


def clean_tokens(x: Column) -> Column:
    """Array of name tokens without bracketed nicknames, honorifics, marriage marks and suffixes."""
    s = lower(strip_accents(F.regexp_replace(x, r"\([^)]*\)", " ")))
    s = F.regexp_replace(s, HYPHENS, " ")
    for words, end in ((HONORIFICS, r"\b\.?"), (MARRIED, r"\b\.?"), (SUFFIXES, r"\b")):
        s = F.regexp_replace(s, r"\b(?:" + "|".join(words) + ")" + end, " ")
    return F.array_remove(F.split(F.regexp_replace(F.translate(s, ",.", "  "), r"\s+", " "), " "), "")


def reversed_name(x: Column) -> Column:
    return F.array_join(F.reverse(F.array_remove(F.split(x, r"\s+"), "")), " ")


def surname_candidates(tokens: Column) -> Column:
    """Last, last but one and first token, distinct."""
    n = F.size(tokens)
    picks = F.array(F.get(tokens, n - 1), F.get(tokens, n - 2), F.get(tokens, F.lit(0)))
    return F.array_distinct(F.filter(picks, lambda t: t.isNotNull()))


def id_digits(x: Column) -> Column:
    """An id without its address prefix and leading letter."""
    return F.regexp_extract(F.trim(x), r"(?i)^(?:.*/)?a?(.*)$", 1)


def norm_panel(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "&", "and"), r"\s+", " "))


def first_text(*options: Column) -> Column:
    """The first option that holds something besides blanks."""
    return F.coalesce(*(F.when(F.trim(o) != "", F.trim(o)) for o in options))


def title_then_program(abstract: Column, title: Column, program: Column, directorate: Column) -> Column:
    """Abstract, else title with the programme, else programme, else directorate."""
    both = F.when(F.trim(title) != "", F.concat_ws(" | ", F.trim(title), F.when(F.trim(program) != "", F.trim(program))))
    return F.coalesce(F.when(F.trim(abstract) != "", F.trim(abstract)), both, F.when(F.trim(program) != "", F.trim(program)), F.when(F.trim(directorate) != "", F.trim(directorate)))


def panel_text(panel: Column, domain: Column) -> Column:
    """The panel without its code, else the domain without its suffix; a dash means missing."""
    given = lambda c: F.when((F.trim(c) != "") & (F.trim(c) != "-"), F.trim(c))
    return F.coalesce(F.regexp_replace(given(panel), r"^[A-Z]{2}[0-9]+\s*-\s*", ""), F.regexp_replace(given(domain), r"\s*\([A-Z]{2}\)\s*$", ""))


def field_code_text(summary: Column, label: Column) -> Column:
    """The summary, else the field label without its number."""
    return F.coalesce(F.when(F.trim(summary) != "", F.trim(summary)), F.nullif(F.regexp_replace(F.trim(label), r"^[0-9]+\s*-\s*", ""), F.lit("")))


def invert(tokens: Column) -> Column:
    """Map of each token that isn't empty to its ascending positions: tokens are sorted within the row and cut into runs,
    so nothing is exploded.  Inner arrays are bound by a lambda, which computes them once."""

    def bound(x: Column, f) -> Column:
        return F.get(F.transform(F.array(x), f), F.lit(0))

    def of_sorted(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["t"] != F.get(s, i - 1)["t"]))

        def of_runs(a: Column) -> Column:
            entry = lambda lo, k: F.struct(F.get(s, lo)["t"].alias("t"), F.transform(F.slice(s, lo + 1, F.coalesce(F.get(a, k + 1), F.size(s)) - lo), lambda x: x["p"]).alias("ps"))
            return F.map_from_entries(F.transform(a, entry))

        return bound(first, of_runs)

    placed = F.transform(tokens, lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    kept = F.filter(placed, lambda x: x["t"] != "")
    return bound(F.array_sort(kept), lambda s: F.when(F.size(s) > 0, of_sorted(s)))


def deinvert(x: Column) -> Column:
    """The text of {"token": [positions]}; null for malformed or empty input."""
    parsed = F.from_json(x, "map<string,array<int>>")
    pairs = F.flatten(F.transform(F.map_entries(parsed), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t")))))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda s: s["t"]), " ")
    return F.nullif(text, F.lit(""))


def document(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit("")))


def number_or_zero(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))
