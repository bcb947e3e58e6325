"""Romanised variants of Han names.  Readings come from a table that the caller supplies (character -> syllables)."""

from __future__ import annotations

import re
import uuid
from itertools import islice, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Surnames of two characters, and surnames whose reading differs from the character's usual one.
COMPOUND = {
    "欧阳", "太史", "端木", "上官", "司马", "东方", "独孤", "南宫", "万俟", "闻人", "夏侯", "诸葛",
    "尉迟", "公羊", "赫连", "澹台", "皇甫", "宗政", "濮阳", "公冶", "太叔", "申屠", "公孙", "慕容",
    "仲孙", "钟离", "长孙", "宇文", "司徒", "鲜于", "司空", "闾丘", "子车", "亓官", "司寇", "巫马",
    "公西", "颛孙", "壤驷", "公良", "漆雕", "乐正", "宰父", "谷梁", "拓跋", "夹谷", "轩辕", "令狐",
    "段干", "百里", "呼延", "东郭", "南门", "羊舌", "微生", "公户", "公玉", "公仪", "梁丘", "公仲",
    "公上", "公门", "公山", "公坚", "左丘", "公伯", "西门", "第五", "东门", "南荣",
}
SURNAME_READINGS = {
    "单": ["shan"], "曾": ["zeng"], "仇": ["qiu"], "区": ["ou"], "查": ["zha"], "解": ["xie"],
    "覃": ["qin", "tan"], "华": ["hua"], "任": ["ren"], "燕": ["yan"], "乐": ["yue", "le"], "种": ["chong"],
    "折": ["she"], "员": ["yun"], "冼": ["xian"], "缪": ["miao", "miu"], "隗": ["kui", "wei"], "都": ["du"],
    "阚": ["kan"], "过": ["guo"], "繁": ["pi", "fan"], "召": ["shao"], "谌": ["shen", "chen"], "尉": ["wei"],
    "朴": ["piao"], "翟": ["zhai", "di"], "郗": ["xi", "chi"], "秘": ["bi"],
}
DOTS = re.compile("[·•･]")


def han(name: str | None) -> str:
    return "".join(c for c in name or "" if "一" <= c <= "鿿")


class Readings:
    """Latin spellings of characters by a table (character -> syllables, the usual one first)."""

    def __init__(self, table: dict[str, list[str]], all_readings: bool = False):
        self.table, self.all = table, all_readings

    @staticmethod
    def spelt(syllables: list[str]) -> list[str]:
        """v stands for a rounded vowel that is written u, v or yu; tones and other signs go."""
        plain = filter(None, (re.sub("[^a-z]", "", s.lower()) for s in syllables))
        return [s.replace("v", vowel) for s in plain for vowel in (("u", "v", "yu") if "v" in s else ("",))]

    def usual(self, char: str) -> list[str]:
        return self.spelt(self.table.get(char, [])[:1])

    def surname(self, name: str) -> list[str]:
        """One character by the fixed table and its usual reading; two joined and spaced."""
        if len(name) == 1:
            return list(dict.fromkeys(self.spelt(SURNAME_READINGS.get(name, [])) + self.usual(name)))
        found = (c for c in product(*map(self.usual, name)) if c)
        return list(dict.fromkeys(sep.join(c) for c in found for sep in ("", " ")))

    def given(self, name: str, cap: int) -> list[tuple[str, ...]]:
        """Syllable lists, cap of them at most; characters without a reading are left out."""
        each = [sorted(set(self.spelt(self.table.get(c, [])[: None if self.all else 1]))) for c in name]
        each = [x for x in each if x]
        return list(islice(product(*each), cap)) if each else []


def parted(name: str) -> tuple[str, str]:
    """(surname, given name): two characters of three or more are a surname if they are a compound one."""
    own = han(name)
    cut = 1 + (len(own) > 2 and own[:2] in COMPOUND)
    return own[:cut], own[cut:]


def shapes(syllables: tuple[str, ...], initials: bool) -> set[str]:
    """A given name's joined and spaced forms, and its initials: the first, joined and spaced."""
    letters = [s[0] for s in syllables]
    return {sep.join(x) for x in [syllables, *[letters] * initials] for sep in ("", " ")} | set(letters[:1] * initials)


def romanize(name: str | None, readings: dict[str, list[str]], all_readings: bool = False, cap: int = 8, initials: bool = True) -> list[str]:
    """Distinct spellings, sorted: both orders, given name joined, spaced and as initials; dotted names by segment."""
    read = Readings(readings, all_readings)
    segments = DOTS.split(name or "")
    if len(segments) > 1:
        spelt = [x for x in ("".join(next(iter(read.usual(c)), "") for c in han(s)) for s in segments) if x]
        return sorted({" ".join(spelt), " ".join(spelt[::-1])} - {""})
    surname, given = parted(name or "")
    last = read.surname(surname) if surname else []
    first = {g for syllables in read.given(given, cap) for g in shapes(syllables, initials)}
    return sorted({f"{a} {b}" for pair in product(first, last) for a, b in (pair, pair[::-1])} if first else set(last))


def han_form(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, r"[^\x{4E00}-\x{9FFF}]", ""), F.lit(""))


def variants(roster: DataFrame, readings: dict[str, list[str]], name: str = "name", cap: int = 8) -> DataFrame:
    """rid, variant, kind (roman, initial if it has a one-letter token, chinese) of each roster row."""

    @F.udtf(returnType="variant string, kind string")
    class Variants:
        def eval(self, name: str):
            for v in romanize(name, readings, cap=cap):
                yield v, "initial" if any(len(t) == 1 for t in v.split()) else "roman"
            if han(name):
                yield han(name), "chinese"

    # the table function is registered under a name of its own, so that callers don't meet
    spark, own = roster.sparkSession, f"name_variants_{uuid.uuid4().hex}"
    spark.udtf.register(own, Variants)
    return spark.sql(f"SELECT r.rid, v.variant, v.kind FROM {{roster}} r, LATERAL {own}(r.name) v", roster=roster.select("rid", F.col(name).alias("name")))
