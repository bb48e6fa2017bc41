"""The annotated stream: reading it into units, writing it back.

    unit  := "^" body "$"                 body: surface/reading..., or source/target[/reference]
    chunk := "^" name tags "{" stream "}$"
    blank := anything between units: text, [superblank], [[word-bound blank]] before a unit

A backslash escapes the next character everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_ESCAPED = r"\\.|"
#: One item of the stream: escape, word-bound blank, superblank, unit, or another character.
ITEM = re.compile(
    r"(?P<escape>\\.)"
    r"|(?P<wblank>\[\[(?:\\.|(?!\]\]).)*\]\])"
    r"|(?P<super>\[(?:\\.|[^\]\\])*\])"
    r"|(?P<unit>\^(?P<body>(?:\\.|[^\\${^])*)(?:\{(?P<content>(?:\\.|(?!\}\$).)*)\})?(?P<tail>(?:\\.|[^\\$^])*)\$)"
    r"|(?P<other>.)",
    re.DOTALL,
)
#: A unit with the blank before it, in text without escapes, superblanks and word-bound blanks.
_PLAIN = re.compile(r"([^^]*)\^([^${^]*)(?:\{((?:(?!\}\$).)*)\})?([^$^]*)\$", re.DOTALL)
#: What has to be escaped in text.
SPECIAL = re.compile(r"[\[\]{}^$/\\@<>]")


class StreamError(ValueError):
    pass


@dataclass
class Unit:
    """A unit with what stands before it; the end of a segment is a unit without a body."""

    blank: str
    body: str | None
    wblank: str = ""
    content: str | None = None  # of a chunk, between its braces

    def render(self) -> str:
        if self.body is None:
            return self.blank
        chunk = "" if self.content is None else "{" + self.content + "}"
        return f"{self.blank}{wrap(self.wblank)}^{self.body}{chunk}$"


def wrap(wblank: str) -> str:
    return f"[[{wblank}]]" if wblank else ""


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def _plain(text: str) -> list[Unit] | None:
    """As parse, in one scan; None if the text isn't that simple."""
    if "\\" in text or "[" in text or "{}" in text:
        return None
    found = _PLAIN.findall(text)
    if text.count("^") != len(found) + (sum([c.count("^") for _, _, c, _ in found]) if "{" in text else 0):
        return None  # a unit doesn't end
    out = [Unit(blank, body + tail, "", content or None) for blank, body, content, tail in found]
    out.append(Unit(text[_end(text, found) :], None))
    return out


def _end(text: str, found: list[tuple[str, str, str, str]]) -> int:
    return sum([len(a) + len(b) + (len(c) + 2 if c else 0) + len(d) + 2 for a, b, c, d in found])


def parse(text: str) -> list[Unit]:
    """The units of a segment; the last one has no body and holds the trailing blank."""
    simple = _plain(text)
    if simple is not None:
        return simple
    out, blank, pending = [], [], ""
    for m in ITEM.finditer(text):
        if m["unit"] is not None:
            if pending:
                blank.pop()
            out.append(Unit("".join(blank), m["body"] + (m["tail"] or ""), pending, m["content"]))
            blank, pending = [], ""
            continue
        pending = m["wblank"][2:-2] if m["wblank"] and m["wblank"] != "[[/]]" else ""
        blank.append(m[0])
    out.append(Unit("".join(blank), None))
    return out


def render(units: list[Unit]) -> str:
    return "".join(u.render() for u in units)


def split_outside_tags(body: str, mark: str = "/") -> list[str]:
    """The parts between unescaped marks that aren't inside a tag."""
    parts, start, depth, i = [], 0, 0, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 1
        elif c == "<":
            depth += 1
        elif c == ">":
            depth = max(0, depth - 1)
        elif c == mark and not depth:
            parts.append(body[start:i])
            start = i + 1
        i += 1
    return [*parts, body[start:]]


@dataclass(frozen=True)
class Morpheme:
    lemma: str
    tags: tuple[str, ...]
    queue: str = ""

    def render(self) -> str:
        return self.lemma + self.queue + "".join(f"<{t}>" for t in self.tags)


_MORPHEME = re.compile(r"((?:\\.|[^\\<#]|#(?! ))*)((?:#(?:\\.|[^\\<])*)?)((?:<[^>]*>)*)((?:#(?:\\.|[^\\<])*)?)$", re.DOTALL)


def morphemes(reading: str) -> list[Morpheme]:
    """A reading's morphemes; a queue after the tags of the last belongs to the first lemma."""
    out, queue = [], ""
    for part in split_outside_tags(reading, "+"):
        m = _MORPHEME.match(part)
        if not m:
            raise StreamError(f"not a morpheme: {part!r}")
        queue = m[4] or queue
        out.append(Morpheme(m[1], tuple(re.findall("<([^>]*)>", m[3])), m[2]))
    if queue:
        out[0] = Morpheme(out[0].lemma, out[0].tags, out[0].queue + queue)
    return out


def readings(body: str) -> tuple[str, list[str]]:
    """The surface and the readings of a unit's body; an unknown word (``*``) has none."""
    surface, *rest = split_outside_tags(body)
    return surface, [r for r in rest if not r.startswith("*")]


def segments(text: str) -> Iterator[str]:
    """What NUL characters part; each is a unit of work of its own."""
    yield from text.split("\0")
