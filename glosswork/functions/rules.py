"""Pure functions of the rule language as columns (tests, affixes, lists, clips)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(caseless: bool, *columns: Column) -> list[Column]:
    return [F.lower(c) for c in columns] if caseless else list(columns)


def equal(a: Column, b: Column, caseless: bool = False) -> Column:
    a, b = _fold(caseless, a, b)
    return a == b


def begins_with(a: Column, prefix: Column, caseless: bool = False) -> Column:
    a, prefix = _fold(caseless, a, prefix)
    return F.startswith(a, prefix)


def ends_with(a: Column, suffix: Column, caseless: bool = False) -> Column:
    a, suffix = _fold(caseless, a, suffix)
    return F.endswith(a, suffix)


def contains_substring(a: Column, part: Column, caseless: bool = False) -> Column:
    a, part = _fold(caseless, a, part)
    return F.contains(a, part)


def begins_with_list(a: Column, items: list[str], caseless: bool = False) -> Column:
    return F.exists(F.array(*map(F.lit, items)), lambda x: begins_with(a, x, caseless))


def ends_with_list(a: Column, items: list[str], caseless: bool = False) -> Column:
    return F.exists(F.array(*map(F.lit, items)), lambda x: ends_with(a, x, caseless))


def in_list(a: Column, items: list[str], caseless: bool = False) -> Column:
    return F.lower(a).isin([i.lower() for i in items]) if caseless else a.isin(items)


def lit_tag(dotted: str) -> str:
    """``a.b`` as ``<a><b>``."""
    return "".join(f"<{t}>" for t in dotted.split("."))


def clip_lemma(unit: Column) -> Column:
    """The lemma, with a queue after the tags moved to its end."""
    return F.concat(F.regexp_extract(unit, r"^((?:\\.|[^<\\])*)", 1), F.regexp_extract(unit, r"(#(?:\\.|[^<\\])*)$", 1))


def clip_tags(unit: Column) -> Column:
    return F.regexp_extract(unit, r"((?:<[^>]*>)+)", 1)


def clip_attribute(unit: Column, tags: list[str]) -> Column:
    """The first of the given tag strings (dotted) in the unit; longer ones are tried first."""
    alternatives = "|".join(lit_tag(t) for t in sorted(tags, key=len, reverse=True))
    return F.regexp_extract(unit, f"({alternatives})", 1)
