"""Tagger specifications: coarse labels, rules on their sequences, classification of readings."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from ..functions.stream import Unit, parse, readings, split_outside_tags

#: Labels that every specification has (fixed values).
PREDEFINED = ("TAG_LPAR", "TAG_RPAR", "TAG_LQUEST", "TAG_CM", "TAG_SENT", "TAG_kEOF", "TAG_kUNDEF")
UNDEFINED, END = "TAG_kUNDEF", "TAG_kEOF"


def _pattern(lemma: str | None, tags: str) -> str:
    head = re.escape(lemma) if lemma else r"(?:\\.|[^<+])*"
    return head + "".join(r"(?:<[^>]+>)*" if t == "*" else re.escape(f"<{t}>") for t in tags.split(".") if t)


@dataclass
class TagSpec:
    labels: list[str] = field(default_factory=lambda: list(PREDEFINED))
    patterns: list[tuple[str, re.Pattern]] = field(default_factory=list)
    closed: set[str] = field(default_factory=lambda: set(PREDEFINED))
    forbid: list[tuple[str, str]] = field(default_factory=list)
    enforce: dict[str, list[str]] = field(default_factory=dict)
    prefer: list[re.Pattern] = field(default_factory=list)
    discard: list[re.Pattern] = field(default_factory=list)
    memo: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, xml: str) -> "TagSpec":
        root, spec, items = ET.fromstring(xml), cls(), {}
        for label in root.iter("def-label"):
            name = label.get("name")
            spec.labels.append(name)
            if label.get("closed") == "true":
                spec.closed.add(name)
            items[name] = "|".join(f"(?:{_pattern(i.get('lemma'), i.get('tags', ''))})" for i in label.iter("tags-item"))
            spec.patterns.append((name, re.compile(items[name])))
        for multi in root.iter("def-mult"):
            name = multi.get("name")
            spec.labels.append(name)
            if multi.get("closed") == "true":
                spec.closed.add(name)
            rows = []
            for sequence in multi.iter("sequence"):
                parts = []
                for e in sequence:
                    if e.tag == "label-item" and e.get("label") not in items:
                        raise ValueError(f"undefined label {e.get('label')}")
                    parts.append(f"(?:{items[e.get('label')] if e.tag == 'label-item' else _pattern(e.get('lemma'), e.get('tags', ''))})")
                rows.append(r"\+".join(parts))
            spec.patterns.append((name, re.compile("|".join(f"(?:{r})" for r in rows))))

        def known(e: ET.Element) -> str:
            if e.get("label") not in spec.labels:
                raise ValueError(f"undefined label {e.get('label')}")
            return e.get("label")

        for sequence in root.iterfind("forbid/label-sequence"):
            a, b = map(known, sequence.iter("label-item"))
            spec.forbid.append((a, b))
        for rule in root.iterfind("enforce-rules/enforce-after"):
            if rule.get("label") not in spec.labels:
                raise ValueError(f"undefined label {rule.get('label')}")
            spec.enforce[rule.get("label")] = [known(e) for e in rule.iter("label-item")]
        spec.prefer = [re.compile(_pattern(None, p.get("tags", ""))) for p in root.iterfind("preferences/prefer")]
        spec.discard = [re.compile(_pattern(None, d.get("tags", ""))) for d in root.iterfind("discard-on-ambiguity/discard")]
        return spec

    @property
    def open_class(self) -> list[str]:
        return sorted(set(self.labels) - self.closed)

    def coarse(self, reading: str) -> str:
        """The label of a reading: the longest match over its joined morphemes, the first label of
        equally long ones; undefined unless the match ends at a boundary of morphemes."""
        if reading not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            best, label = 0, UNDEFINED
            for name, pattern in self.patterns:
                m = pattern.match(reading)
                if m and m.end() > best and (m.end() == len(reading) or reading[m.end()] in "+#"):
                    best, label = m.end(), name
            self.memo[reading] = label
        return self.memo[reading]

    def analyse(self, unit: Unit) -> dict[str, str]:
        """The labels of a unit with the reading kept for each; unwanted ones go while others remain."""
        surface, found = readings(unit.body)
        for pattern in self.discard:
            rest = [r for r in found if not pattern.fullmatch(r)]
            found = rest or found[:1]
        out: dict[str, str] = {}
        for reading in found:
            label = self.coarse(reading)
            if label not in out or any(p.fullmatch(reading) for p in self.prefer):
                out[label] = reading
        return out

    def tokens(self, text: str) -> list[tuple[str, dict[str, str]]]:
        return [(split_outside_tags(u.body)[0], self.analyse(u)) for u in parse(text) if u.body is not None]
