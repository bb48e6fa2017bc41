"""Multiple translations: every combination of the alternatives of a matched window of words."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stream import Unit, parse, split_outside_tags
from .transfer import RuleSet


def alternatives(unit: Unit) -> list[str]:
    """The target sides of a unit source/target/target..., or the source."""
    parts = split_outside_tags(unit.body)
    return parts[1:] or parts


def expand(text: str, rules: RuleSet) -> str:
    """``[{]a[|]b.[][}]`` for each window that a rule matches and that has several translations.

    A window's alternatives are the product of its words'; words outside of windows, and windows
    with one translation, are written plainly.
    """
    units = parse(text)
    forms = [split_outside_tags(u.body)[0] if u.body is not None else "" for u in units]
    out, at = [], 0
    while at < len(units) - 1:
        found = rules.longest(forms, at, set())
        n = found[1] if found else 1
        window = units[at : at + n]
        gaps = [u.blank for u in window[1:]]
        lines = ["".join(("" if k == 0 else gaps[k - 1]) + f"^{t}$" for k, t in enumerate(chosen)) for chosen in product(*map(alternatives, window))]
        out.append(window[0].blank)
        out.append(lines[0] if len(lines) == 1 or not found else "[{]" + "[|]".join(lines) + ".[][}]")
        at += n
    return "".join(out) + units[-1].blank


def expand_rows(tokens: DataFrame, column: str = "translations") -> DataFrame:
    """One row for each translation of each token: successive explodes instead of a product."""
    return tokens.withColumn("translation", F.explode(column)).drop(column)
