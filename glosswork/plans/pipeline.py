"""Pipelines as objects: declared steps that compose into one pass over a segment.

Steps that run on the same segments are fused, so a segment crosses to Python once, whatever the
number of steps. Rewriting changes the list of steps before it runs.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..operators.streamops import Segment, apply, attach_wblanks, detach_wblanks, fused

Factory = Callable[..., Segment]


@dataclass(frozen=True)
class Step:
    program: str
    files: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pipeline:
    name: str
    steps: tuple[Step, ...]
    install: bool = False

    def prefix(self, upto: int) -> "Pipeline":
        """The pipeline up to a step, for looking at what stands between."""
        return replace(self, steps=self.steps[:upto])

    def debug(self) -> list["Pipeline"]:
        return [replace(self.prefix(k), name=f"{self.name}-{self.steps[k - 1].program}") for k in range(1, len(self.steps) + 1)]

    def line(self) -> str:
        return " | ".join(" ".join([s.program, *s.flags, *s.files]) for s in self.steps)


#: Steps that carry word-bound blanks only when told so, and those that analyse or generate.
ANALYSERS, GENERATORS, RESTORERS = ("analyse",), ("generate",), ("restore-caps",)


def with_word_blanks(pipeline: Pipeline) -> Pipeline:
    """Segment-wise steps; word-bound blanks attached after analysis and detached after generation.

    A transfer step that looks words up itself becomes a lookup and a transfer of joined pairs.
    Capital restoration closes word-bound blanks itself, so nothing is detached after it.
    """
    out: list[Step] = []
    programs = [s.program for s in pipeline.steps]
    for step in pipeline.steps:
        flags = step.flags if "-z" in step.flags else (*step.flags, "-z")
        if step.program == "transfer" and "-b" not in step.flags and len(step.files) == 3:
            out += [Step("lookup", step.files[2:], ("-z", "-b")), Step("transfer", step.files[:2], (*flags, "-b"))]
        else:
            out.append(replace(step, flags=flags))
        if step.program in ANALYSERS and "wblank-attach" not in programs:
            out.append(Step("wblank-attach", (), ("-z",)))
        if step.program in GENERATORS and "wblank-detach" not in programs and not any(p in RESTORERS for p in programs):
            out.append(Step("wblank-detach", (), ("-z",)))
    return replace(pipeline, steps=tuple(out))


def read_modes(xml: str) -> list[Pipeline]:
    """``<modes><mode name install><pipeline><program name><file name/>...`` as pipelines."""
    out = []
    for mode in ET.fromstring(xml).iter("mode"):
        steps = []
        for program in mode.iter("program"):
            name, *flags = program.get("name", "").split()
            steps.append(Step(name, tuple(f.get("name") for f in program.iter("file")), tuple(flags)))
        out.append(Pipeline(mode.get("name"), tuple(steps), mode.get("install") == "yes"))
    return out


def write_modes(pipelines: list[Pipeline], untrimmed: bool = False) -> dict[str, str]:
    """A line for each pipeline, with its debugging prefixes; ``untrimmed`` adds those that only analyse."""
    out = {}
    for p in pipelines:
        out[p.name] = p.line()
        for d in p.debug()[:-1]:
            out.setdefault(d.name, d.line())
        if untrimmed and p.steps:
            out[f"{p.name}-untrimmed"] = p.prefix(1).line()
    return out


@dataclass
class Registry:
    """What a program's name stands for: a function of (files, flags) that gives a segment function."""

    factories: dict[str, Factory] = field(default_factory=lambda: {"wblank-attach": lambda files, flags: attach_wblanks, "wblank-detach": lambda files, flags: detach_wblanks})

    def register(self, name: str, factory: Factory) -> None:
        self.factories[name] = factory

    def compile(self, pipeline: Pipeline) -> Segment:
        missing = [s.program for s in pipeline.steps if s.program not in self.factories]
        if missing:
            raise KeyError(f"no program named {', '.join(missing)}")
        return fused(*[self.factories[s.program](s.files, s.flags) for s in pipeline.steps])

    def run(self, df: DataFrame, pipeline: Pipeline, column: str = "stream") -> DataFrame:
        return apply(df, self.compile(pipeline), column)
