"""Averaged perceptron tagging: feature templates as closures, beam search, training.

A sentence is a list of tokens, each with its surface and its analyses (lists of morphemes). The
features of a choice are lists of strings built by templates from the sentence, the position and the
choices made so far. A template language in XML compiles to the same closures.
"""

from __future__ import annotations

import math
import random
import xml.etree.ElementTree as ET
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stream import Morpheme, morphemes, parse, readings

Analysis = tuple[Morpheme, ...]
BEAM = 4


@dataclass(frozen=True)
class Token:
    surface: str
    analyses: tuple[Analysis, ...]


@dataclass
class Context:
    """Where a template looks: a token and a morpheme (wordoid), and the analyses chosen so far."""

    sentence: list[Token]
    chosen: list[Analysis]
    token: int
    wordoid: int = 0
    variables: dict = field(default_factory=dict)

    def morpheme(self, token: int, wordoid: int) -> Morpheme | None:
        if 0 <= token < len(self.chosen) and self.chosen[token]:
            own = self.chosen[token]
            return own[wordoid] if -len(own) <= wordoid < len(own) else None
        return None


class Skip(Exception):
    """The template gives no feature here."""


Closure = Callable[[Context], object]


class Templates:
    """Compiled templates: each gives the values whose products are its features."""

    def __init__(self, xml: str, coarse: Callable[[str], str] | None = None) -> None:
        self.xml, self.coarse = xml, coarse
        root = ET.fromstring(xml)
        self.beam = int(root.findtext("beam-width") or root.get("beam-width") or BEAM)
        self.sets = {d.get("n"): frozenset(i.get("v") for i in d) for d in root.iter("def-set")}
        self.strings = {d.get("n"): d.get("v") for d in root.iter("def-str")}
        self.macros = {d.get("n"): d for d in root.iter("def-macro")}
        gate = root.find("global-pred")
        self.gate = self._compile(gate[0]) if gate is not None else None
        self.features = [(k, [self._compile(e) for e in feature]) for k, feature in enumerate(root.iter("feat"))]
        #: Where each part of each feature looks, if that is one place near the word
        self.places = [[_place(e) for e in feature] for feature in root.iter("feat")]
        self.written = [[ET.tostring(e).strip() for e in feature] for feature in root.iter("feat")]

    def __reduce__(self):
        return Templates, (self.xml, self.coarse)

    def of(self, context: Context) -> Iterator[tuple[str, ...]]:
        if self.gate is not None and not self.gate(context):
            return
        for number, parts in self.features:
            try:
                values = [p(context) for p in parts]
            except Skip:
                continue
            columns = [[str(x) for x in v] if isinstance(v, (list, tuple, frozenset)) else [str(v)] for v in values if v is not None]
            for chosen in product(*columns):
                yield (str(number), *chosen)

    def _compile(self, e: ET.Element, bound: dict | None = None) -> Closure:
        of = partial(self._compile, bound=bound)
        args = [of(c) for c in e] if e.tag not in ("macro", "for-each") else []
        tag = e.tag
        if tag in ("out", "out-many"):
            return args[0]
        if tag == "pred":

            def gate(c: Context) -> None:
                if not args[0](c):
                    raise Skip

            return gate
        if tag == "macro":
            given = {p.get("n"): of(p[0]) for p in e}
            body = self.macros[e.get("n")]
            return self._compile(body[-1], {**(bound or {}), **given})
        if tag == "var":
            name = e.get("n")
            return bound[name] if bound and name in bound else lambda c: c.variables[name]
        if tag == "for-each":
            name, items = e.get("n"), of(e[0])
            body = of(e[1])

            def each(c: Context) -> list:
                out = []
                for item in items(c):
                    c.variables[name] = item
                    out.append(body(c))
                c.variables.pop(name, None)
                return out

            return each
        constants = {"int": lambda: int(e.get("v")), "str": lambda: e.get("v", self.strings.get(e.get("n"), "")), "set": lambda: self.sets[e.get("n")]}
        if tag in constants:
            value = constants[tag]()
            return lambda c: value
        operation = _OPERATIONS.get(tag)
        if operation is None:
            raise ValueError(f"unknown element <{tag}>")
        return lambda c: operation(self, c, [a(c) for a in args])


def _address(c: Context, args: list) -> tuple[int, int]:
    return args[0] if args and isinstance(args[0], tuple) else (c.token, c.wordoid)


def _morpheme(t: Templates, c: Context, args: list) -> Morpheme:
    if args and isinstance(args[0], Morpheme):
        return args[0]
    found = c.morpheme(*_address(c, args))
    if found is None:
        raise Skip
    return found


def _surface(t: Templates, c: Context, args: list) -> str:
    at = args[0] if args and isinstance(args[0], int) else _address(c, args)[0]
    if not 0 <= at < len(c.sentence):
        raise Skip
    return c.sentence[at].surface


def _adjust(t: Templates, c: Context, args: list) -> tuple[int, int]:
    """An address moved over the ends of tokens until its wordoid is within one."""
    token, wordoid = args[0]
    while 0 <= token < len(c.chosen):
        n = len(c.chosen[token])
        if 0 <= wordoid < n:
            break
        token, wordoid = (token - 1, wordoid + len(c.chosen[token - 1]) if token else wordoid) if wordoid < 0 else (token + 1, wordoid - n)
    return token, wordoid


def _ambiguity(t: Templates, c: Context, args: list) -> list[str]:
    at = args[0] if args and isinstance(args[0], int) else c.token
    if not 0 <= at < len(c.sentence):
        raise Skip
    return sorted({m.tags[0] for a in c.sentence[at].analyses for m in a[:1] if m.tags})


def _subscript(t: Templates, c: Context, args: list):
    if not -len(args[0]) <= args[1] < len(args[0]):
        raise Skip
    return args[0][args[1]]


_OPERATIONS: dict[str, Callable] = {
    # integers
    "sentlen": lambda t, c, a: len(c.sentence),
    "pathlen": lambda t, c, a: len(c.chosen),
    "tokaddr": lambda t, c, a: c.token,
    "wrdidx": lambda t, c, a: c.wordoid,
    "add": lambda t, c, a: (a[0][0] + a[1], a[0][1] + (a[2] if len(a) > 2 else 0)) if isinstance(a[0], tuple) else sum(a),
    "toklen": lambda t, c, a: len(c.chosen[a[0] if a else c.token]),
    "strlen": lambda t, c, a: len(a[0]),
    "arrlen": lambda t, c, a: len(a[0]),
    # booleans
    "and": lambda t, c, a: all(a),
    "or": lambda t, c, a: any(a),
    "not": lambda t, c, a: not a[0],
    "eq": lambda t, c, a: a[0] == a[1],
    "neq": lambda t, c, a: a[0] != a[1],
    "lt": lambda t, c, a: a[0] < a[1],
    "lte": lambda t, c, a: a[0] <= a[1],
    "gt": lambda t, c, a: a[0] > a[1],
    "gte": lambda t, c, a: a[0] >= a[1],
    "streq": lambda t, c, a: a[0] == a[1],
    "strin": lambda t, c, a: a[0] in a[1],
    "sethasany": lambda t, c, a: bool(set(a[0]) & set(a[1])),
    "sethasall": lambda t, c, a: set(a[0]) <= set(a[1]),
    # strings and arrays
    "ex-surf": _surface,
    "ex-lemma": lambda t, c, a: _morpheme(t, c, a).lemma,
    "ex-coarse": lambda t, c, a: t.coarse(_morpheme(t, c, a).render()) if t.coarse else "".join(_morpheme(t, c, a).tags[:1]),
    "ex-tags": lambda t, c, a: list(_morpheme(t, c, a).tags),
    "ex-ambgset": _ambiguity,
    "lower": lambda t, c, a: a[0].lower(),
    "join": lambda t, c, a: (a[1] if len(a) > 1 else "").join(a[0]),
    "slice": lambda t, c, a: a[0][slice(*a[1:])],
    "subscript": _subscript,
    "filterin": lambda t, c, a: [x for x in a[0] if x in a[1]],
    "hassubstr": lambda t, c, a: a[1] in a[0],
    # wordoids and addresses
    "ex-wordoid": _morpheme,
    "ex-wordoids": lambda t, c, a: list(c.chosen[a[0] if a else c.token]),
    "wrdaddr": lambda t, c, a: (c.token, c.wordoid),
    "addr-of-ints": lambda t, c, a: (a[0], a[1]),
    "adjust": _adjust,
    "clamp": lambda t, c, a: (min(max(a[0][0], 0), len(c.chosen) - 1), max(a[0][1], 0)),
}

#: Templates that serve without a file: tag, lemma, word, neighbours' tags, endings.
DEFAULT = """<metatag beam-width="4">
  <feat><out><ex-coarse/></out><out><ex-lemma/></out></feat>
  <feat><out><join><ex-tags/><str v="."/></join></out></feat>
  <feat><out><join><ex-tags/><str v="."/></join></out><out><lower><ex-surf/></lower></out></feat>
  <feat><out><ex-coarse/></out><out><ex-coarse><addr-of-ints><add><tokaddr/><int v="-1"/></add><int v="-1"/></addr-of-ints></ex-coarse></out></feat>
  <feat><out><ex-coarse/></out><out><ex-coarse><addr-of-ints><add><tokaddr/><int v="-1"/></add><int v="-1"/></addr-of-ints></ex-coarse></out>
    <out><ex-coarse><addr-of-ints><add><tokaddr/><int v="-2"/></add><int v="-1"/></addr-of-ints></ex-coarse></out></feat>
  <feat><out><ex-coarse/></out><out><lower><ex-surf><add><tokaddr/><int v="1"/></add></ex-surf></lower></out></feat>
  <feat><out><ex-coarse/></out><out><slice><lower><ex-surf/></lower><int v="-3"/></slice></out></feat>
  <feat><out><ex-coarse/></out><out-many><ex-ambgset><add><tokaddr/><int v="1"/></add></ex-ambgset></out-many></feat>
</metatag>"""


def features(templates: Templates, sentence: list[Token], chosen: list[Analysis]) -> Iterator[tuple[str, ...]]:
    """The features of the last chosen analysis, over all its morphemes."""
    at = len(chosen) - 1
    for wordoid in range(len(chosen[at])):
        yield from templates.of(Context(sentence, chosen, at, wordoid))


def _offset(e: ET.Element) -> int | None:
    """The constant that an expression adds to the token's address; None if it is anything else."""
    if e.tag == "tokaddr" and not len(e):
        return 0
    if e.tag == "add" and [x.tag for x in e] == ["tokaddr", "int"]:
        return int(e[1].get("v"))
    return None


def _place(e: ET.Element) -> tuple[str, int] | None:
    """The one place that a part of a feature reads, ("chosen" or "token", offset); None if there are others."""
    if e.tag in ("ex-coarse", "ex-tags", "ex-lemma"):
        if not len(e):
            return "chosen", 0
        at = _offset(e[0][0]) if len(e) == 1 and e[0].tag == "addr-of-ints" and len(e[0]) == 2 and e[0][1].tag == "int" else None
        return ("chosen", at) if at is not None and at < 0 else None
    if e.tag in ("ex-surf", "ex-ambgset"):
        at = 0 if not len(e) else _offset(e[0]) if len(e) == 1 else None
        return ("token", at) if at is not None else None
    if e.tag in ("out", "out-many", "lower", "join", "slice") and len(e) and all(x.tag in ("int", "str") for x in e[1:]):
        return _place(e[0])
    return None


class Near:
    """The scores of a model whose features look at constant distances, remembered by what the weights can tell apart.

    A part's values that no weight has are left out, so most words look alike. Scores are exact sums,
    as those of the plain way.
    """

    def __init__(self, model: Perceptron) -> None:
        self.weights, self.ids, self.parts = model.weights, {}, []
        known: dict[tuple[str, int, int], set[str]] = defaultdict(set)
        for f in model.weights:
            for at, value in enumerate(f[1:]):
                known[f[0], len(f) - 1, at].add(value)
        for (number, closures), places in zip(model.templates.features, model.templates.places):
            self.parts.append([(place, closure, known[str(number), len(places), at]) for at, (place, closure) in enumerate(zip(places, closures))])
        reads = [{x[0] for x in feature} for feature in self.parts]
        self.late = [k for k, r in enumerate(reads) if any(kind == "chosen" and at < 0 for kind, at in r)]
        self.early = [k for k in range(len(reads)) if k not in self.late]
        self.back = max([-at for r in reads for kind, at in r if kind == "chosen"], default=0)
        self.around = sorted({at for k in self.early for kind, at in reads[k] if kind == "token"})
        self.written = model.templates.written
        #: What is known of choices before by their tags alone, if nothing else is read of them
        self.by_tags: dict | None = {} if model.templates.coarse is None and not any(b"ex-lemma" in x for k in self.late for x in self.written[k]) else None
        self.seen: dict[int, tuple] = {}
        self.cuts: list[list] = []
        self.terms: dict = {}
        self.sums: dict = {}

    @staticmethod
    def fits(t: Templates) -> bool:
        late = [p for p in t.places if any(x is not None and x[0] == "chosen" and x[1] < 0 for x in p)]
        return t.gate is None and all(x is not None for p in t.places for x in p) and all(x[0] == "chosen" for p in late for x in p)

    def _values(self, closure: Closure, context: Context) -> list[str]:
        try:
            v = closure(context)
        except Skip:
            return []
        return [str(x) for x in v] if isinstance(v, (list, tuple, frozenset)) else [str(v)]

    def _cut(self, kind: str, at: int, what: Token | Analysis, features: list[int]) -> int:
        """A number for what the parts of the features read at a place; equal ones are alike to the weights."""
        tags = None
        if features is self.late and self.by_tags is not None:
            tags = at, tuple([m.tags for m in what])
            if tags in self.by_tags:
                return self.by_tags[tags]
        rounds = []
        for wordoid in range(len(what) if kind == "chosen" and at == 0 else 1):
            if kind == "chosen":
                context = Context([], [what, *[()] * -at], -at, wordoid)
            else:
                context = Context([*[Token("", ())] * max(0, at), what], [], max(0, -at))
            own, got = [], {}
            for k in features:
                for p, (place, closure, known) in enumerate(self.parts[k]):
                    if place == (kind, at):
                        written = self.written[k][p]
                        if written not in got:
                            got[written] = self._values(closure, context)
                        own.append((k, p, tuple([x for x in got[written] if x in known])))
            rounds.append(tuple(own))
        found = self.ids.setdefault(tuple(rounds), len(self.ids))
        if found == len(self.cuts):
            self.cuts.append(rounds)
        if tags:
            self.by_tags[tags] = found
        return found

    def _token(self, token: Token) -> tuple:
        """The token (held, so that its id stays its own), its choices, its numbers as a neighbour, and those of a word that isn't chosen."""
        past = lambda a: tuple([self._cut("chosen", -d, a, self.late) for d in range(1, self.back + 1)])
        choices = [(a, self._cut("chosen", 0, a, self.early), self._cut("chosen", 0, a, self.late), past(a)) for a in token.analyses] if len(token.analyses) > 1 else []
        only = token.analyses[0] if token.analyses else ()
        if len(self.seen) > 100_000:
            self.seen.clear()
        found = self.seen[id(token)] = (token, choices, [self._cut("token", d, token, self.early) for d in self.around], None if choices else (only, past(only)))
        return found

    def _found(self, features: list[int], own: int, others: tuple[int, ...]) -> tuple[float, ...]:
        """The weights of the features of a choice, from the numbers of what they read."""
        cut, out = self.cuts, []
        fixed = {(k, p): v for o in others if o >= 0 for k, p, v in cut[o][0]}
        for rounds in cut[own]:
            values = fixed | {(k, p): v for k, p, v in rounds}
            for k in features:
                for chosen in product(*[values.get((k, p), ()) for p in range(len(self.parts[k]))]):
                    out.append(self.weights.get((str(k), *chosen), 0.0))
        return tuple(sorted(x for x in out if x))

    def tag(self, sentence: list[Token], width: int) -> list[Analysis]:
        back, terms, sums, seen = self.back, self.terms, self.sums, self.seen
        for remembered in (terms, sums):
            if len(remembered) > 500_000:
                remembered.clear()
        held = [seen.get(id(t)) or self._token(t) for t in sentence]
        n, places = len(held), list(enumerate(self.around))
        agenda: list[tuple] = [(0.0, None, (None,) * back)]  # score, (path before, choice), last choices' numbers
        for k, (_, found, _, single) in enumerate(held):
            if single:
                only, past = single
                agenda = [(s, (path, only), (past, *h)[:back]) for s, path, h in agenda]
                continue
            near = tuple([held[k + d][2][at] if 0 <= k + d < n else -1 for at, d in places])
            choices = []
            for a, own, late, past in found:
                key = (own, near)
                by_word = terms.get(key)
                if by_word is None:
                    by_word = terms[key] = self._found(self.early, own, near)
                choices.append((a, by_word, late, past))
            grown = []
            for s, path, h in agenda:
                for a, by_word, late, past in choices:
                    key = (by_word, late, h)
                    score = sums.get(key)
                    if score is None:
                        by_path = self._found(self.late, late, tuple([x[d] if x else -1 for d, x in enumerate(h)]))
                        score = sums[key] = math.fsum((*by_word, *by_path))
                    grown.append((s + score, (path, a), (past, *h)[:back]))
            grown.sort(key=lambda x: -x[0])
            agenda = grown[:width]
        path, out = max(agenda, key=lambda x: x[0])[1], []
        while path is not None:
            path, a = path
            out.append(a)
        return out[::-1]


@dataclass
class Perceptron:
    templates: Templates
    weights: dict[tuple[str, ...], float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"templates": self.templates, "weights": self.weights}

    def score(self, sentence: list[Token], chosen: list[Analysis]) -> float:
        return math.fsum(self.weights.get(f, 0.0) for f in features(self.templates, sentence, chosen))

    def beam(self, sentence: list[Token], gold: list[Analysis] | None = None) -> tuple[list[Analysis], int]:
        """The best path, or with ``gold`` the best one when the gold path leaves the beam.

        Words with one analysis or none go to all paths unscored. Ties go to the older path, then
        to the earlier analysis.
        """
        agenda: list[tuple[float, list[Analysis]]] = [(0.0, [])]
        for k, token in enumerate(sentence):
            if len(token.analyses) <= 1:
                only = token.analyses[0] if token.analyses else ()
                agenda = [(s, [*path, only]) for s, path in agenda]
                continue
            grown = [(s + self.score(sentence, [*path, a]), [*path, a]) for s, path in agenda for a in token.analyses]
            grown.sort(key=lambda x: -x[0])
            agenda = grown[: self.templates.beam]
            if gold is not None and not any(path == gold[: k + 1] for _, path in agenda):
                return agenda[0][1], k + 1
        return max(agenda, key=lambda x: x[0])[1], len(sentence)

    def tag(self, sentence: list[Token]) -> list[Analysis]:
        """The best path; the weights are taken to stay as they are from the first sentence on."""
        if not Near.fits(self.templates):
            return self.beam(sentence)[0]
        near = self.__dict__.get("_near")
        if near is None or near.weights is not self.weights:
            near = self._near = Near(self)
        return near.tag(sentence, self.templates.beam)


def train(sentences: Iterable[tuple[list[Token], list[Analysis]]], templates: Templates, iterations: int = 5, seed: int = 0, start: dict[tuple[str, ...], float] | None = None) -> Perceptron:
    """Averaged weights, from those of ``start``; the average advances with updates, and early ones end a sentence."""
    data = list(sentences)
    model = Perceptron(templates, dict(start or {}))
    totals: dict[tuple[str, ...], float] = defaultdict(float)
    since: dict[tuple[str, ...], int] = dict.fromkeys(model.weights, 0)
    updates, order = 0, random.Random(seed)

    def add(feature: tuple[str, ...], change: float) -> None:
        old = model.weights.get(feature, 0.0)
        totals[feature] += (updates - since.get(feature, updates)) * old
        since[feature] = updates
        model.weights[feature] = old + change

    for _ in range(iterations):
        order.shuffle(data)
        for sentence, gold in data:
            guess, upto = model.beam(sentence, gold)
            if guess[:upto] == gold[:upto]:
                continue
            updates += 1
            for k in range(upto):
                if len(sentence[k].analyses) > 1:
                    for f in features(templates, sentence, gold[: k + 1]):
                        add(f, 1.0)
                    for f in features(templates, sentence, guess[: k + 1]):
                        add(f, -1.0)
    updates += 1
    for f in list(model.weights):
        add(f, 0.0)
    model.weights = {f: t / updates for f, t in totals.items() if t}
    return model


def train_distributed(rows: DataFrame, templates: Templates, rounds: int = 3, seed: int = 0) -> Perceptron:
    """Parameter mixing: each partition of (untagged, tagged) sentences trains by itself, weights are
    averaged by an aggregation, and the next round starts from their mean. The driver and each task hold
    one set of weights, and a task the sentences of its partition."""
    weights: dict[tuple[str, ...], float] = {}
    parts = max(1, rows.rdd.getNumPartitions())
    for r in range(rounds):

        def work(batches: Iterator[pa.RecordBatch], start=weights, number=r) -> Iterator[pa.RecordBatch]:
            pairs = [(sentence_of(u), gold_of(t)) for b in batches for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            both = train(pairs, templates, 1, seed + number, start).weights
            yield pa.RecordBatch.from_arrays([pa.array([list(f) for f in both], pa.list_(pa.string())), pa.array(list(both.values()), pa.float64())], names=["feature", "w"])

        mixed = rows.select("untagged", "tagged").mapInArrow(work, "feature array<string>, w double").groupBy("feature").agg((F.sum("w") / parts).alias("w"))
        weights = {tuple(x["feature"]): x["w"] for x in mixed.toLocalIterator()}
    return Perceptron(templates, weights)


@lru_cache(100_000)
def _read(body: str) -> tuple[Token, dict[Analysis, str]]:
    """A unit's token, and the first reading of each analysis as it is written."""
    surface, found = readings(body)
    analyses = tuple(tuple(morphemes(r)) for r in found)
    return Token(surface, analyses), dict(zip(reversed(analyses), reversed(found)))


def sentence_of(text: str) -> list[Token]:
    return [_read(u.body)[0] for u in parse(text) if u.body is not None]


def gold_of(text: str) -> list[Analysis]:
    return [t.analyses[0] if t.analyses else () for t in sentence_of(text)]


def tag_text(text: str, model: Perceptron) -> str:
    """The stream with each unit's reading chosen; unknown words keep their star."""
    units = parse(text)
    read = [_read(u.body) for u in units if u.body is not None]
    chosen = iter(zip(read, model.tag([token for token, _ in read])))
    out = []
    for u in units:
        if u.body is None:
            out.append(u.blank)
            continue
        (token, written), analysis = next(chosen)
        out.append(f"{u.blank}^{written[analysis] if analysis in written else '*' + token.surface}$")
    return "".join(out)


def trace(model: Perceptron, spark) -> DataFrame:
    """The weights as a table, for looking at them."""
    return spark.createDataFrame([(list(f), w) for f, w in sorted(model.weights.items())], "feature array<string>, w double")
