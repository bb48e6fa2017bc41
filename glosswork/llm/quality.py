"""Quality by weak supervision: a label model over heuristics, then a hashed linear scorer.

Overlapping heuristic labellers vote for clean, against it, or not at all. Expectation-maximisation
over the counts of all vote patterns (at most 3 to the number of labellers, whatever the size of the
corpus) estimates how often each labeller votes how in either class, and so the posterior of every
pattern. A linear scorer over hashed features of the whole text learns those posteriors from at most
``most_docs`` documents, in the order of a hash of their ids (a documented bound); votes, pattern
counts and scores cover all documents. Each text is read once: its votes and its features, of which
only those that aren't zero are kept, go to a table. No gold label is read.

Defined results: null and empty texts, and texts without words, have no features: every labeller
abstains, and they score below one half; repeated rows get equal scores; an empty table gives an
empty table. Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

MOST_DOCS = 8000
DIMENSIONS = 1024
ROUNDS = 100

#: Classes of bytes: letters by case, digits, blanks, line ends, other bytes of UTF-8, each ASCII mark.
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = 6 if _c >= 128 else 1 if _s.islower() else 2 if _s.isupper() else 3 if _s.isdigit() else 5 if _s in "\n\r" else 4 if _s in " \t\x0b\x0c" else 7 if _c < 32 or _c == 127 else 0
_MARKS = [c for c in range(256) if _CLASS[c] == 0]
_CLASS[_MARKS] = 8 + np.arange(len(_MARKS))
_CLASSES = int(_CLASS.max()) + 1
_MARK_SET = {chr(c): int(_CLASS[c]) for c in _MARKS}
_PLAIN_MARKS = [_MARK_SET[c] for c in ".,;:?'\"()-"]
#: Spreads pairs of classes over the dimensions that the named statistics leave.
_SPREAD = ((np.arange(_CLASSES * _CLASSES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(DIMENSIONS - 64) + np.uint64(64)

STATISTICS = ("odd_marks", "shouted", "repeated_next", "distinct", "top_word", "sentence", "word_length", "exclaimed", "letters")


def statistics(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The named statistics of a text, and its hashed features; None without words."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return None
    kinds = _CLASS[np.frombuffer(data, np.uint8)]
    pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES)
    single = np.bincount(kinds, minlength=_CLASSES)
    n, size = len(words), len(data)
    marks = single[8:].sum()
    letters = single[1] + single[2] + single[6]
    # as words repeat more in longer texts, the share of distinct ones is taken over runs of 200
    runs = [words[i : i + 200] for i in range(0, n, 200)]
    counts = [Counter(r) for r in runs]
    distinct = sum(map(len, counts)) / n
    top = sum(max(c.values()) for c in counts) / n
    same = sum(map(bytes.__eq__, words, words[1:])) / n
    ends = single[_MARK_SET["."]] + single[_MARK_SET["?"]] + single[_MARK_SET["!"]]
    named = np.array([(marks - single[_PLAIN_MARKS].sum()) / n, single[2] / max(1, letters), same, distinct, top, n / (1 + ends), letters / n, single[_MARK_SET["!"]] / n, letters / size])
    hashed = np.zeros(DIMENSIONS)
    np.add.at(hashed, _SPREAD.astype(np.int64), pairs)
    hashed[64:] = np.log1p(200 * hashed[64:] / size)
    # each statistic in steps of its logarithm, and a constant
    steps = np.clip((np.log2(named + 2.0**-6) + 6) / 2, 0, 6).astype(int)
    hashed[np.arange(len(named)) * 7 + steps] = 1.0
    hashed[63] = 1.0
    return named, hashed


@dataclass(frozen=True)
class Labeller:
    """Votes clean (1) where the statistic is within ``clean``, junk (0) where within ``junk``."""

    name: str
    statistic: str
    clean: tuple[float, float]
    junk: tuple[float, float]

    def vote(self, values: np.ndarray) -> int:
        x = values[STATISTICS.index(self.statistic)]
        return 1 if self.clean[0] <= x <= self.clean[1] else 0 if self.junk[0] <= x <= self.junk[1] else -1


_BIG = float("inf")
LABELLERS = (
    Labeller("few odd marks", "odd_marks", (0, 0.05), (0.3, _BIG)),
    Labeller("mostly lower case", "shouted", (0, 0.15), (0.5, 1)),
    Labeller("no stuttering", "repeated_next", (0, 0.08), (0.3, 1)),
    Labeller("varied words", "distinct", (0.45, 1), (0, 0.3)),
    Labeller("no word rules", "top_word", (0, 0.2), (0.35, 1)),
    Labeller("ordinary sentences", "sentence", (2, 40), (120, _BIG)),
    Labeller("ordinary words", "word_length", (3, 9), (0, 2)),
    Labeller("calm", "exclaimed", (0, 0.1), (0.5, _BIG)),
    Labeller("made of letters", "letters", (0.74, 1), (0, 0.62)),
)


def pattern_of(values: np.ndarray | None) -> int:
    """The votes as a number to base 3: 0 none, 1 junk, 2 clean."""
    code = 0
    for labeller in LABELLERS:
        code = code * 3 + (0 if values is None else labeller.vote(values) + 1)
    return code


def votes_of(patterns: np.ndarray) -> np.ndarray:
    digits = [patterns // 3**k % 3 for k in range(len(LABELLERS) - 1, -1, -1)]
    return np.stack(digits, axis=1)


@dataclass
class LabelModel:
    """Vote rates by class, labeller and vote, and the share of clean documents."""

    rates: np.ndarray
    share: float

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> "LabelModel":
        """EM; it starts from the votes' majorities, which also fixes which class is which."""
        votes = votes_of(patterns)
        clean, junk = (votes == 2).sum(axis=1), (votes == 1).sum(axis=1)
        posterior = np.where(junk > 0, np.where(junk >= 2, 0.05, 0.35), np.where(clean > 0, 0.95, 0.3))
        model = None
        for _ in range(rounds):
            weights = np.stack([counts * (1 - posterior), counts * posterior])
            rates = np.stack([[np.bincount(votes[:, k], weights=w, minlength=3) for k in range(votes.shape[1])] for w in weights])
            # one pseudo-vote of each kind
            rates = (rates + 1) / (rates + 1).sum(axis=2, keepdims=True)
            model = cls(rates, float((weights[1].sum() + 1) / (counts.sum() + 2)))
            new = model.posterior(patterns)
            if np.abs(new - posterior).max(initial=0.0) < 1e-9:
                break
            posterior = new
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = votes_of(patterns)
        cast = votes > 0  # abstaining says nothing, so that what many abstain from isn't a class
        said = self.rates[:, :, 1:] / self.rates[:, :, 1:].sum(axis=2, keepdims=True)
        logs = np.log(said)[:, np.arange(votes.shape[1]), np.maximum(votes - 1, 0)]
        odds = np.where(cast, logs[1] - logs[0], 0).sum(axis=1) + np.log(self.share / (1 - self.share))
        out = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        return np.where(cast.any(axis=1), out, 0.25)


def learn(features: np.ndarray, target: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic curve over the features for soft targets, by accelerated descent."""
    features = np.asarray(features, np.float64)
    n = max(1, len(features))
    limit = (features**2).sum(axis=1).max(initial=1.0) / 4 + ridge
    weights = np.zeros(features.shape[1])
    ahead, pace = weights.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ ahead, -30, 30)))
        new = ahead - (features.T @ (p - target) / n + ridge * ahead) / limit
        after = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = new + (pace - 1) / after * (new - weights)
        weights, pace = new, after
    return weights


def packed(features: np.ndarray) -> bytes:
    """The features that aren't zero: their numbers, then their values in half precision."""
    at = np.flatnonzero(features)
    return at.astype("<u2").tobytes() + features[at].astype("<f2").tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 4
    return np.frombuffer(data, "<u2", n), np.frombuffer(data, "<f2", n, 2 * n).astype(np.float64)


def read_column(text: Column) -> Column:
    kind = pa.struct([("pattern", pa.int32()), ("features", pa.binary())])

    @F.arrow_udf("struct<pattern:int,features:binary>")
    def read(texts: pa.Array) -> pa.Array:
        found = (statistics(t.as_py()) for t in texts)
        return pa.array([{"pattern": pattern_of(f and f[0]), "features": f and packed(f[1])} for f in found], kind)

    return read(text)


def score_column(weights: np.ndarray, features: Column) -> Column:
    @F.arrow_udf("double")
    def score(cells: pa.Array) -> pa.Array:
        out = []
        for cell in cells:
            if (data := cell.as_py()) is None:
                out.append(0.0)
                continue
            at, values = unpacked(data)
            out.append(float(1 / (1 + np.exp(-np.clip(values @ weights[at], -500, 500)))))
        return pa.array(out, pa.float64())

    return score(features)


def score_documents(docs: DataFrame, most_docs: int = MOST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, posterior (of the label model), score, predicted (1: clean), keep of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), read_column(F.col(text_col)).alias("r"))
    rows = cut_lineage(rows.select("doc_id", "r.pattern", "r.features"))
    # at most 3 ** 9 rows
    seen = sorted((r["pattern"], r["n"]) for r in rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect())
    patterns, counts = np.array([p for p, _ in seen], np.int64), np.array([n for _, n in seen], float)
    model = LabelModel.fit(patterns, counts)
    posterior = dict(zip(patterns.tolist(), model.posterior(patterns).tolist()))
    # a row's own votes and features, as an id may have rows of different texts
    key = F.md5(F.concat(F.lit("quality:"), F.col("doc_id").cast("string")).cast("binary"))
    chosen = rows.where("pattern > 0 and doc_id is not null").orderBy(key, "doc_id", "pattern", "features").limit(most_docs)
    learned = list(zip(*(c.to_pylist() for c in chosen.select("pattern", "features").toArrow().columns)))
    features = np.zeros((len(learned), DIMENSIONS))
    for x, (_, data) in zip(features, learned):
        at, values = unpacked(data)
        x[at] = values
    weights = learn(features, np.array([posterior[p] for p, _ in learned]))
    lookup = F.create_map(*[x for p, v in posterior.items() for x in (F.lit(p), F.lit(v))]) if posterior else None
    prior = F.element_at(lookup, F.col("pattern")) if lookup is not None else F.lit(None).cast("double")
    scored = rows.select("doc_id", prior.alias("posterior"), score_column(weights, F.col("features")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= 0.5).alias("keep"))
