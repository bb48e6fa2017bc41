"""Filters over annotated streams, segment by segment, and their DataFrame forms.

Each function takes one segment and returns one, so it serves batch and streaming alike. ``on``
applies any of them to a column in Arrow batches; several fuse into one call (see ``fused``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.case import getcase
from ..functions.stream import ITEM, Morpheme, StreamError, Unit, morphemes, parse, readings, render, split_outside_tags, wrap

Segment = Callable[[str], str]


def fused(*steps: Segment) -> Segment:
    def run(text: str) -> str:
        for step in steps:
            text = step(text)
        return text

    return run


def on(column: Column | str, step: Segment) -> Column:
    """The step over a text column; a null stays null."""

    @F.arrow_udf("string")
    def apply(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else step(t) for t in texts.to_pylist()], pa.string())

    return apply(F.col(column) if isinstance(column, str) else column)


def apply(df: DataFrame, step: Segment, column: str = "stream") -> DataFrame:
    return df.withColumn(column, on(column, step))


# pretransfer


def pretransfer(text: str, compounds: bool = False, no_surface: bool = False) -> str:
    """Move queues before the tags, split joined morphemes into units (with ``compounds`` also ``~``).

    Every piece of a split unit gets its word-bound blank. ``no_surface`` drops the surface form.
    """
    out = []
    for unit in parse(text):
        if unit.body is None:
            out.append(unit.blank)
            continue
        body = unit.body
        parts = split_outside_tags(body)
        if no_surface and len(parts) > 1:
            body, parts = "/".join(parts[1:]), parts[1:]
        surface, reading = (parts[0] + "/", "/".join(parts[1:])) if len(parts) > 1 else ("", body)
        pieces = _split_reading(reading, compounds)
        mark = wrap(unit.wblank)
        joined = pieces[0][1]
        line = f"{unit.blank}{mark}^{surface}{joined}$"
        for gap, piece in pieces[1:]:
            line += f"{gap}{mark}^{piece}$"
        out.append(line)
    return "".join(out)


def _split_reading(reading: str, compounds: bool) -> list[tuple[str, str]]:
    if "<" not in reading or reading.startswith("*"):
        return [("", reading)]
    parts, queue = [], ""
    for k, joined in enumerate(split_outside_tags(reading, "+")):
        for n, part in enumerate(split_outside_tags(joined, "~") if compounds else [joined]):
            m = re.match(r"((?:\\.|[^\\<])*)((?:<[^>]*>)*)(.*)$", part, re.DOTALL)
            lemma, tags, rest = m[1], m[2], m[3]
            if rest.startswith("#") and tags:
                queue, rest = rest, ""
            elif not compounds:
                rest = rest.replace("~", "")
            parts.append(("" if n else " " if k else "", lemma + tags + rest))
    if queue:
        m = re.match(r"((?:\\.|[^\\<])*)(.*)$", parts[0][1], re.DOTALL)
        parts[0] = (parts[0][0], m[1] + queue + m[2])
    return parts


# posttransfer and cleanstream


def posttransfer(text: str) -> str:
    return re.sub(" +", " ", text)


def posttransfer_col(text: Column) -> Column:
    return F.regexp_replace(text, " +", " ")


def cleanstream(text: str, newline: bool = False, keep_blanks: bool = False) -> str:
    """Only the units, with a separator for each run of anything else.

    A superblank gives one, as does other text before a unit; with ``newline`` each unit has one, and
    the end. With ``keep_blanks`` superblanks stay. A closing mark that belongs to no unit goes.
    """
    separator = "\n" if newline else " "
    out, buffered = [], False
    for m in ITEM.finditer(text):
        if m["unit"] is not None:
            out += [separator] * (buffered or newline) + [m["unit"]]
            buffered = False
        elif m["super"] or m["wblank"]:
            out += [separator, m[0]] if keep_blanks else [separator]
        else:
            buffered = buffered or m[0] != "$"
    return "".join(out) + separator * newline


# word-bound blanks


def join_wblanks(*blanks: str) -> str:
    """The items of several word-bound blanks, each once, in order."""
    items = [i.strip() for b in blanks for i in b.split(";") if i.strip()]
    return "; ".join(dict.fromkeys(items))


def attach_wblanks(text: str) -> str:
    """Give every unit the items of all ``[[a]]...[[/]]`` spans that it is in."""
    out, stack = [], []
    for m in ITEM.finditer(text):
        if m["wblank"] is not None:
            inner = m["wblank"][2:-2]
            if inner == "/":
                if stack:
                    stack.pop()
            else:
                stack.append(inner)
        elif m["unit"] is not None:
            out.append(wrap(join_wblanks(*stack)) + m["unit"])
        else:
            out.append(m[0])
    return "".join(out)


def detach_wblanks(text: str) -> str:
    """Close each unit's word-bound blank after the unit, ``[[a]]^...$[[/]]``."""
    return "".join(f"{u.render()}[[/]]" if u.wblank else u.render() for u in parse(text))


# capitals


def extract_caps(text: str, keep_surface: bool = False) -> str:
    """Keep the first reading and note the cases of surface and lemma in the word-bound blank."""
    out = []
    for unit in parse(text):
        if unit.body is None:
            out.append(unit.blank)
            continue
        surface, *rest = split_outside_tags(unit.body)
        reading = rest[0] if rest else surface
        lemmas = reading
        if ">+" in reading:  # the case of a compound runs to its last morpheme's first tag
            last = reading.rindex(">+") + 2
            cut = reading.find("<", last)
            lemmas = re.sub("<[^>]*>", "", reading[: cut if cut >= 0 else len(reading)])
        lemma = lemmas.split("<", 1)[0]
        note = f"c:{getcase(surface)}/{getcase(lemma)}"
        unit.wblank = f"{unit.wblank}; {note}" if unit.wblank else note
        unit.body = f"{surface}/{reading}" if keep_surface else reading
        out.append(unit.render())
    return "".join(out)


# readings


def discard(body: str, unwanted: list[re.Pattern]) -> str:
    """Drop readings that match a discard pattern while more than one remains."""
    surface, *rest = split_outside_tags(body)
    for pattern in unwanted:
        for reading in list(rest):
            if len(rest) > 1 and pattern.fullmatch(reading):
                rest.remove(reading)
    return "/".join([surface, *rest])


def prefer(candidates: list[str], preferred: list[re.Pattern]) -> str:
    """Of readings of one coarse tag: the one that a prefer rule names, else the first."""
    return next((r for p in preferred for r in candidates if p.fullmatch(r)), candidates[0])


def discard_readings(text: str, unwanted: list[re.Pattern]) -> str:
    units = parse(text)
    for unit in units:
        if unit.body is not None:
            unit.body = discard(unit.body, unwanted)
    return render(units)


def choose(unit: Unit, reading: str | None, show_surface: bool = False, mark: bool = False, first: bool = False) -> str:
    """A unit's output: the chosen reading, or all with it first; unknown words keep their star."""
    surface, all_readings = readings(unit.body)
    if not all_readings or reading is None:
        return f"^{surface + '/' if show_surface else ''}*{surface}$"
    rest = [r for r in all_readings if r != reading] if first else []
    head = "=" if mark and len(all_readings) > 1 else ""
    return "^" + head + (surface + "/" if show_surface else "") + "/".join([reading, *rest]) + "$"


def check_segment(text: str) -> None:
    """Raise StreamError for a unit that doesn't end or a word-bound blank with no unit after it."""
    for m in ITEM.finditer(text):
        if m["other"] == "^":
            raise StreamError(f"a unit that doesn't end at {m.start()}")
    units = parse(text)
    if any(re.search(r"\[\[(?!/\]\])", u.blank) for u in units):
        raise StreamError("a word-bound blank without a unit")


def with_setvar(text: str, settings: dict[str, str]) -> str:
    return "".join(f"[<STREAMCMD:SETVAR:{k}={v}>]" for k, v in sorted(settings.items())) + text


def without_setvar(text: str) -> tuple[str, dict[str, str]]:
    found = dict(re.findall(r"\[<STREAMCMD:SETVAR:([^=>]*)=([^>]*)>\]", text))
    return re.sub(r"\[<STREAMCMD:SETVAR:[^>]*>\]", "", text), found


#: Characters of streams whose units are built at once.
TOGETHER = 500_000


@lru_cache(1 << 16)
def _analyses(body: str) -> tuple[str, list[str], list[list[Morpheme]]]:
    surface, found = readings(body)
    return surface, found, [morphemes(r) for r in found]


def _lists(lengths: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(list(accumulate(lengths, initial=0)), pa.int32()), values)


def _unit_columns(units: list[Unit]) -> list[pa.Array]:
    """blank, wblank, surface, unknown, raw, readings of the units."""
    known = [("", [], []) if u.body is None else _analyses(u.body) for u in units]
    marks = [[x.strip() for x in u.wblank.split(";") if x.strip()] if u.body is not None and u.wblank else [] for u in units]
    own = [m for _, _, parsed in known for m in parsed]
    each = [m for some in own for m in some]
    tags = _lists([len(m.tags) for m in each], pa.array([t for m in each for t in m.tags], pa.string()))
    parts = pa.StructArray.from_arrays([pa.array([m.lemma for m in each], pa.string()), tags, pa.array([m.queue for m in each], pa.string())], names=["lemma", "tags", "queue"])
    found = pa.StructArray.from_arrays([pa.array([r for _, some, _ in known for r in some], pa.string()), _lists([*map(len, own)], parts)], names=["raw", "morphemes"])
    return [
        pa.array([u.blank for u in units], pa.string()),
        _lists([*map(len, marks)], pa.array([x for some in marks for x in some], pa.string())),
        pa.array([None if u.body is None else k[0] for u, k in zip(units, known)], pa.string()),
        pa.array([u.body is not None and "/*" in u.body for u in units], pa.bool_()),
        pa.array([u.body for u in units], pa.string()),
        _lists([len(k[1]) for k in known], found),
    ]


def tokens_of(df: DataFrame, column: str = "stream") -> DataFrame:
    """One row a unit: pos, blank, wblank, surface, unknown, raw, readings (with their morphemes).

    Units are built column by column and leave a few segments at a time; what a task holds beside its
    input doesn't follow the number of rows.
    """
    morpheme = "struct<lemma:string,tags:array<string>,queue:string>"
    unit = f"pos int, blank string, wblank array<string>, surface string, unknown boolean, raw string, readings array<struct<raw:string,morphemes:array<{morpheme}>>>"
    rest = [c for c in df.columns if c != column]
    names = [*rest, "pos", "blank", "wblank", "surface", "unknown", "raw", "readings"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, units, chars = batch.column(0), [], [], 0
            for row in range(batch.num_rows):
                text = texts[row].as_py()
                if text is not None:
                    own = parse(text)
                    rows.append((row, len(own)))
                    units += own
                    chars += len(text)
                if units and (chars > TOGETHER or row == batch.num_rows - 1):
                    at = pa.array([r for r, n in rows for _ in range(n)], pa.int64())
                    pos = pa.array([k for _, n in rows for k in range(n)], pa.int32())
                    held = [batch.column(k + 1).take(at) for k in range(len(rest))]
                    for start in range(0, len(units), 20_000):
                        stop = min(start + 20_000, len(units))
                        columns = [x.slice(start, stop - start) for x in (*held, pos)]
                        yield pa.RecordBatch.from_arrays([*columns, *_unit_columns(units[start:stop])], names=names)
                    rows, units, chars = [], [], 0

    kept = df.select(*[F.col(f"`{c}`") for c in rest])
    schema = StructType([*kept.schema.fields, *StructType.fromDDL(unit).fields])
    return df.select(F.col(f"`{column}`"), *[F.col(f"`{c}`") for c in rest]).mapInArrow(split, schema)


def streams_of(tokens: DataFrame, keys: list[str], column: str = "stream") -> DataFrame:
    """The inverse of tokens_of: the rows of a segment joined in order."""
    mark = F.when(F.size("wblank") > 0, F.concat(F.lit("[["), F.array_join("wblank", "; "), F.lit("]]"))).otherwise("")
    text = F.concat("blank", F.when(F.col("raw").isNotNull(), F.concat(mark, F.lit("^"), "raw", F.lit("$"))).otherwise(""))
    rows = tokens.withColumn("_text", text).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "_text"))).alias("_u"))
    return rows.select(*keys, F.array_join(F.transform("_u", lambda x: x["_text"]), "").alias(column))
