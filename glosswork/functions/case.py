"""Letter case of words: recognising it, applying it, as columns and as plain functions.

A word is ``aa`` (first letter lower), ``AA`` (first and last upper) or ``Aa``. A word of one upper
case letter is ``Aa`` so that applying its case leaves longer words readable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def getcase(word: str) -> str:
    if not word or not word[0].isupper():
        return "aa"
    return "AA" if len(word) > 1 and word[-1].isupper() else "Aa"


def apply_case(case: str, word: str) -> str:
    """The word in a case; characters one by one, so lengths stay."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in word)
    if case == "AA":
        return "".join(c.upper() if len(c.upper()) == 1 else c for c in word)
    if case == "Aa":
        for i, c in enumerate(low):
            if c.isalnum():
                return low[:i] + (c.upper() if len(c.upper()) == 1 else c) + low[i + 1 :]
    return low


def copycase(source: str, target: str) -> str:
    return apply_case(getcase(source), target) if source else target


def copycase_lemmas(case: str, unit: str) -> str:
    """Re-case the lemma parts of ``lemma<tags># rest``, leaving tags and what follows them."""
    head, bracket, rest = unit.partition("<")
    return apply_case(case, head) + bracket + rest


def getcase_col(word: Column) -> Column:
    first, last = F.substring(word, 1, 1), F.substring(word, -1, 1)
    upper = lambda c: (c == F.upper(c)) & (c != F.lower(c))
    return F.when(~upper(first) | (F.length(word) == 0), "aa").when((F.length(word) > 1) & upper(last), "AA").otherwise("Aa")


def _by_character(word: Column, change) -> Column:
    """Characters changed one by one, but for those whose change is longer."""
    return F.array_join(F.transform(F.split(word, ""), lambda c: F.when(F.length(change(c)) == 1, change(c)).otherwise(c)), "")


def apply_case_col(case: Column, word: Column) -> Column:
    low = _by_character(word, F.lower)
    before = F.length(F.regexp_extract(low, r"^([^\p{L}\p{N}]*)", 1))
    first = _by_character(F.substr(low, before + 1, F.lit(1)), F.upper)
    capital = F.concat(F.substr(low, F.lit(1), before), first, F.substr(low, before + 2))
    return F.when(case == "AA", _by_character(word, F.upper)).when(case == "Aa", capital).otherwise(low)


def copycase_col(source: Column, target: Column) -> Column:
    return F.when(F.length(source) > 0, apply_case_col(getcase_col(source), target)).otherwise(target)
