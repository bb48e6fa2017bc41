"""Chat formatting by a grammar round trip.

A conversation is rendered into one string, the string is parsed again by a deterministic parser,
and the turns recovered are compared to the source. Where they differ, conflicting content (control
strings and backslashes inside texts) is escaped, and the round is repeated until they are the same.

    conversation := turn*
    turn         := "<s>[INST] " text " [/INST]"          role user
                  | " " text " </s>"                      role assistant
                  | "[SYS] " text " [/SYS]"               role system
                  | "[ROLE] " text " [NAMED] " text " [/ROLE]"   any other role: name, text

Inside a text, a backslash makes the next character ordinary; everything else stands for itself.

Defined results: a null text or role is empty; rows come by (turn, role, text), null turns first, so
equal rows are kept and their order doesn't matter; rows of a null conv_id are one conversation; an
empty table gives only the conversations that the caller adds. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[NAMED]", "[/ROLE]")
_CONTROL = "|".join(map(re.escape, CONTROLS))
_SPECIAL = re.compile(rf"\\|{_CONTROL}")
_END = re.compile(rf"\\(?s:.)|({_CONTROL})")
#: Opening, closing control strings of a role.
FRAMES = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("[SYS] ", " [/SYS]")}


class ParseError(ValueError):
    pass


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The string of (role, text) turns, already escaped, and the spans of assistant texts."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, tail = FRAMES.get(role) or (f"[ROLE] {role} [NAMED] ", " [/ROLE]")
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(text)))
        parts += [head, text, tail]
        at += len(head) + len(text) + len(tail)
    return "".join(parts), spans


def parse(line: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered string, texts unescaped; ParseError if it is none."""

    def upto(start: int, close: str) -> tuple[str, int]:
        """The text from start up to the first control string, which must be that in ``close``."""
        for m in _END.finditer(line, start):
            if m[1] is not None:
                stop = m.start() - 1
                if m[1] != close.strip() or stop < start or line[stop] != " ":
                    raise ParseError(f"{m[1]} at {m.start()}")
                after = m.end() + close.endswith(" ")
                if close.endswith(" ") and line[m.end() : after] != " ":
                    raise ParseError(f"no blank at {m.end()}")
                return unescape(line[start:stop]), after
        raise ParseError(f"the text at {start} doesn't end")

    at, turns = 0, []
    while at < len(line):
        for role, (head, tail) in FRAMES.items():
            if line.startswith(head, at):
                text, at = upto(at + len(head), tail)
                turns.append((role, text))
                break
        else:
            if not line.startswith("[ROLE] ", at):
                raise ParseError(f"no turn at {at}")
            role, at = upto(at + 7, " [NAMED] ")
            text, at = upto(at, " [/ROLE]")
            turns.append((role, text))
    return turns


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A string that parses back to exactly ``turns``, and the spans under the loss mask."""
    held = list(turns)
    for attempt in ("plain", "conflicts escaped", "escaped and compared"):
        line, spans = render(held)
        try:
            if parse(line) == turns:
                return line, spans
        except ParseError:
            pass
        held = [(r if r in FRAMES else escape(r), escape(t)) for r, t in turns]
    raise ParseError(f"no rendering of {len(turns)} turns parses back ({attempt})")


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of the table's rows; a conversation is the unit that must be held whole."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of conversations given as rows (conv_id, turn, role, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, masks = [], []
            for turns in batch.column(1):
                line, spans = format_turns([(t["role"], t["text"]) for t in turns.as_py()])
                lines.append(line)
                masks.append([{"start": a, "end": b} for a, b in spans])
            mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.string()), pa.array(masks, mask)], names=["conv_id", "formatted", "loss_spans"])

    return conversations_of(rows).mapInArrow(work, "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, from the formatted strings alone."""
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for line, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(line)
                masked = "".join(unescape(line[s["start"] : s["end"]]) for s in spans)
                source = "".join(f"{role}\n{text}\n" for role, text in turns)
                out.append((len(turns), hashlib.sha256(source.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(line)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, list(kinds.values())[1:])]], names=list(kinds))

    return formatted.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_report(rows: DataFrame) -> DataFrame:
    """The digests of every conversation in ``rows``."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_conversations(rows))
