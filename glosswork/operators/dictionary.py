"""Rows of dictionaries and rule sources: variants, default translations, lexical choice, edit machines."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Attributes that name the variants of an entry, on both sides, the left, the right.
VARIANTS = ("v", "vl", "vr")


def keep_language(entries: DataFrame, language: str, column: str = "langs") -> DataFrame:
    """Entries without languages, and those that name this one."""
    return entries.where(F.col(column).isNull() | (F.size(column) == 0) | F.array_contains(column, language))


def keep_all_requested(rules: DataFrame, requested: list[str], column: str = "v") -> DataFrame:
    """Rules without a set, and those whose set has all requested variants."""
    wanted = F.array(*map(F.lit, requested)).cast("array<string>")
    return rules.where(F.col(column).isNull() | (F.size(F.array_except(wanted, F.col(column))) == 0))


def keep_any_requested(nodes: DataFrame, requested: list[str], column: str = "v") -> DataFrame:
    """Nodes without a set, and those whose set meets the requested one."""
    wanted = F.array(*map(F.lit, requested)).cast("array<string>")
    return nodes.where(F.col(column).isNull() | F.arrays_overlap(F.col(column), wanted))


def mark_variants(entries: DataFrame, variant: str, side: str = "v") -> DataFrame:
    """The variants of a side rewritten: the wanted one where an entry has it, else ``other``; none stay none."""
    if side not in VARIANTS:
        raise ValueError(side)
    held = F.when(F.array_contains(side, variant), F.array(F.lit(variant))).otherwise(F.array(F.lit("other")))
    return entries.withColumn(side, F.when(F.col(side).isNotNull() & (F.size(side) > 0), held).otherwise(F.col(side)))


def default_translations(entries: DataFrame) -> DataFrame:
    """Of each source lemma with several translations the one marked default, else the first.

    entries: (source, target, position, is_default); adds ``chosen``.
    """
    order = Window.partitionBy("source").orderBy(F.col("is_default").desc_nulls_last(), "position", "target")
    return entries.withColumn("chosen", F.row_number().over(order) == 1)


def lexical_choice(entries: DataFrame, bilingual: bool = False) -> DataFrame:
    """Lemmas by sense: ``lemma__sense`` for all senses but the default, which keeps the lemma.

    A monolingual dictionary has the marked lemmas for the plain ones, a bilingual one has both sides.
    """
    name = F.when(F.col("sense").isNull() | (F.col("sense") == "D"), F.col("source")).otherwise(F.concat("source", F.lit("__"), "sense"))
    rows = entries.withColumn("marked", name)
    return rows.select("marked", "target") if bilingual else rows.select("marked").distinct()


def expand_macros(xml: str) -> str:
    """Rules with macros written out: ``<macro n npar>`` bodies for ``<macro n><with-param>...``.

    In a body, ``$1``, ``$2`` ... in attributes stand for the parameters' ``v``.
    """
    root = ET.fromstring(xml)
    macros = {m.get("n"): m for m in root.iter("def-macro")}

    def filled(node: ET.Element, given: list[str]) -> ET.Element:
        def text(value: str) -> str:
            for k in range(len(given), 0, -1):
                value = value.replace(f"${k}", given[k - 1])
            return value

        out = ET.Element(node.tag, {k: text(v) for k, v in node.attrib.items()})
        out.text, out.tail = node.text and text(node.text), node.tail
        for child in node:
            out.extend(expanded(child, given))
        return out

    def expanded(node: ET.Element, given: list[str]) -> list[ET.Element]:
        if node.tag == "macro":
            if node.get("n") not in macros:
                raise ValueError(f"undefined macro {node.get('n')}")
            own = [p.get("v", "") for p in node.iter("with-param")]
            return [x for child in macros[node.get("n")] for x in expanded(child, own)]
        return [] if node.tag in ("def-macro", "def-macros") else [filled(node, given)]

    return ET.tostring(expanded(root, [])[0], encoding="unicode")


def edit_machine(alphabet: str, distance: int = 1, swaps: bool = True, weight: float = 1.0) -> list[tuple[int, int, str, str, float]]:
    """Transitions (from, to, input, output, weight) of a transducer that allows ``distance`` edits.

    States 0..distance count edits; a swap of neighbours is one edit and goes through states of its own.
    """
    out, extra = [], distance + 1
    for d in range(distance + 1):
        out += [(d, d, c, c, 0.0) for c in alphabet]
        if d == distance:
            break
        out += [(d, d + 1, c, "", weight) for c in alphabet]
        out += [(d, d + 1, "", c, weight) for c in alphabet]
        out += [(d, d + 1, a, b, weight) for a, b in product(alphabet, repeat=2) if a != b]
        if swaps:
            for a, b in product(alphabet, repeat=2):
                if a != b:
                    out += [(d, extra, a, b, weight), (extra, d + 1, b, a, 0.0)]
                    extra += 1
    return out


def accepts(machine: list[tuple[int, int, str, str, float]], distance: int, source: str, target: str) -> float | None:
    """The least weight at which the machine turns one word into another, or None."""
    best = {(0, 0, 0): 0.0}
    todo = [(0, 0, 0)]
    by_state: dict[int, list] = {}
    for t in machine:
        by_state.setdefault(t[0], []).append(t)
    while todo:
        state, i, j = todo.pop()
        for _, to, a, b, w in by_state.get(state, ()):
            if source.startswith(a, i) and target.startswith(b, j):
                key, value = (to, i + len(a), j + len(b)), best[state, i, j] + w
                if value < best.get(key, float("inf")):
                    best[key] = value
                    todo.append(key)
    ends = [v for (s, i, j), v in best.items() if s <= distance and i == len(source) and j == len(target)]
    return min(ends) if ends else None
