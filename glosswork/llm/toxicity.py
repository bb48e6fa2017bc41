"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models of word pairs, one of toxic and one of ordinary texts, are fitted on
labelled documents. Each estimates a word after the one before it: discounted pair counts, then
discounted numbers of distinct words that come before it in the class, then the same numbers over
both classes, a backoff that the classes share. Discounts come from all counts of a class. Estimates
of its own a class keeps, as in a pruned backoff model, only for expressions whose numbers of texts
differ between the classes beyond chance; all others, and so all rare ones, are left to the shared
backoff, which is alike in both models. Words without own estimates may share those of their longest
kept beginning (inflected and derived forms); the share of a beginning is that of its words without
own ones. The texts that hold an expression count no more than what stands before it, or after it,
varies, so passages that were copied from text to text don't pass for evidence. Without pruning (``significant=-1, least=0, strong=0``) the
models are plain Kneser-Ney ones. A text's score is the difference of its two length-normalised
log-likelihoods, put on a scale of probabilities by a logistic curve fitted on the same documents.

The fit reads at most ``most_docs`` documents of each class, in the order of a hash of their ids
(a documented bound; scoring covers every whole text). Held-out ids, crc32(id) mod 5 = 0, are
never read by the fit. Ids with several rows count with each of their different texts, within the
same bound.

Defined results: a null or empty text, or one without known expressions, gets the score of no
evidence; a null id counts as the empty string in the fold; of several labels of an id the largest
holds; with no labels, or of one class only, every text gets the share of toxic labels, below one
half if there are none; repeated rows get equal scores. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

MOST_DOCS = 4000
#: Least G-squared (15: one in 10,000 by chance) and least number of texts of an expression's own estimates.
SIGNIFICANT, LEAST = 15.0, 4
#: Least difference of log odds: what is hardly likelier in a class says nothing about a text.
STRONG = 1.0
#: Mean evidence per word at which the scale bends from linear to logarithmic.
BEND = 1e-3
FOLDS = 5

#: The word before the first, and the columns of counted grams.
START, GRAMS = b"", ["head", "word", "toxic", "ordinary", "toxic_texts", "ordinary_texts", "toxic_before", "ordinary_before", "toxic_after", "ordinary_after"]
#: Letters of a beginning, the mark after one (no letter), and bits of the set of what stands beside an expression.
SHORTEST, LONGEST, CUT, BITS = 3, 8, b"*", 61
#: Grams that a worker counts before it hands them on, words whose evidence and words whose beginnings it remembers.
HELD, KNOWN, CACHED = 40_000, 40_000, 10_000

_WORD = re.compile(rb"[^ ]+")
_BLANKED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters (and of anything outside ASCII)."""
    return (text or "").lower().encode().translate(_BLANKED).split()


@lru_cache(CACHED)
def beginnings(word: bytes) -> tuple[bytes, ...]:
    """The marked beginnings of a word, the longest first."""
    if word.isascii():
        return tuple([word[:k] + CUT for k in range(min(len(word), LONGEST), SHORTEST - 1, -1)])
    letters = word.decode()
    return tuple(letters[:k].encode() + CUT for k in range(min(len(letters), LONGEST), SHORTEST - 1, -1))


def _bit(beside: bytes) -> int:
    return 1 << crc32(beside) % BITS


def _places(text: str | None) -> tuple[list[bytes], list[int], list[int]]:
    """words_of the text, and as bits what stands before and after each, to the neighbour's far end."""
    raw = (text or "").lower().encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_BLANKED))]
    starts, ends = [0, *[a for a, _ in spans]], [*[b for _, b in spans], len(raw)]
    before = [_bit(raw[v:a]) for v, (a, _) in zip(starts, spans)]
    return [raw[a:b] for a, b in spans], before, [_bit(raw[b:w]) for (_, b), w in zip(spans, ends[1:])]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def g_squared(toxic, ordinary, share):
    """How far counts of the two classes are from the toxic ``share`` (arrays or numbers)."""
    n = toxic + ordinary
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(toxic > 0, toxic * np.log(toxic / (n * share)), 0.0)
        b = np.where(ordinary > 0, ordinary * np.log(ordinary / (n * (1 - share))), 0.0)
    return 2 * (a + b)


@dataclass
class Model:
    """Log ratios of what the two models say, above the ``constant`` of a word without own estimates.

    words: of the word by itself; heads: what its being after a head adds, unless pairs has the pair;
    stems: of marked beginnings, for words that ``words`` lacks.
    """

    words: dict[bytes, float] = field(default_factory=dict)
    heads: dict[bytes, float] = field(default_factory=dict)
    pairs: dict[tuple[bytes, bytes], float] = field(default_factory=dict)
    constant: float = 0.0
    slope: float = 0.0
    offset: float = -5.0
    stems: dict[bytes, float] = field(default_factory=dict)
    seen: dict[bytes, float] = field(default_factory=dict, repr=False, compare=False)
    firsts: frozenset[bytes] = field(default=frozenset(), repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}, "firsts": frozenset()}

    def alone(self, word: bytes) -> float:
        """What a word says by itself."""
        if word in self.words:
            return self.words[word]
        return next((self.stems[b] for b in beginnings(word) if b in self.stems), 0.0) if self.stems else 0.0

    def evidence(self, text: str | None) -> float:
        """The mean over words of how much likelier the toxic model finds them, above the constant."""
        own = words_of(text)
        if not own:
            return 0.0
        known, heads, pairs = self.words, self.heads, self.pairs
        if self.stems:
            known = self.seen
            if len(known) > KNOWN:
                known.clear()
            # a beginning has as many bytes as letters at least, so most words need no look at theirs, nor a place
            firsts = self.firsts = self.firsts or frozenset(b[:SHORTEST] for b in self.stems)
            for w in set(own).difference(known):
                if w in self.words or w[:SHORTEST] in firsts:
                    known[w] = self.alone(w)
        total = math.fsum([known[w] for w in own if w in known])
        if heads:
            total += math.fsum([pairs.get((v, w), heads[v]) for v, w in zip(chain((START,), own), own) if v in heads])
        return total / len(own)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * bend(evidence) + self.offset, -500, 500)))


def bend(evidence: np.ndarray) -> np.ndarray:
    return np.sign(evidence) * np.log1p(np.abs(evidence) / BEND)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Kneser-Ney's absolute discounts of counts one, two and more, from how many counts are 1, 2, 3, 4."""
    if not (n[0] and n[1]):
        return (0.75, 0.75, 0.75)
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.1), k * 0.99) for k, d in enumerate(found, 1))


def discounted(count: int, by: tuple[float, float, float]) -> float:
    return max(0.0, count - by[min(count, 3) - 1]) if count else 0.0


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """GRAMS of pairs; with a null head, of words and marked beginnings. What stands before and after are sets, as bits."""
    found: dict[tuple[bytes | None, bytes], list[int]] = {}

    def drain() -> Iterator[pa.RecordBatch]:
        columns = [pa.array([g[k] for g in found], pa.binary()) for k in (0, 1)]
        numbers = np.array(list(found.values()), np.int64).reshape(-1, 8)
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(numbers[:, k]) for k in range(8)]], names=GRAMS)
        found.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (own, before, after), at = _places(text), 0 if toxic else 1
            grams: dict[tuple[bytes | None, bytes], list[int]] = {}
            alone, pairs = zip(zip(repeat(None), own), before, after), zip(zip(chain((START,), own), own), chain(before[:1], before), after)
            for g, left, right in chain(alone, pairs):
                held = grams.get(g)
                if held is None:
                    grams[g] = [1, left, right]
                else:
                    held[0] += 1
                    held[1] |= left
                    held[2] |= right
            stems: dict[bytes, list[int]] = {}
            for (v, w), (n, left, right) in grams.items():
                for b in beginnings(w) if v is None else ():
                    held = stems.setdefault(b, [0, 0, 0])
                    held[0] += n
                    held[1] |= left
                    held[2] |= right
            for g, (n, left, right) in chain(grams.items(), zip(zip(repeat(None), stems), stems.values())):
                held = found.setdefault(g, [0] * 8)
                held[at] += n
                held[at + 2] += 1
                held[at + 4] |= left
                held[at + 6] |= right
            if len(found) > HELD:
                yield from drain()
    yield from drain()


def training_rows(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """(text, toxic) of the sample, different texts; {class: (labelled, sampled)}. At most 2 x most_docs ids are broadcast."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for c in (0, 1):
        some = known.where(F.col("toxic") == c).orderBy(F.md5(F.concat(F.lit("toxicity:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id").limit(most_docs)
        chosen = some if chosen is None else chosen.unionByName(some)
    sampled = {c: (sizes.get(c, 0), min(most_docs, sizes.get(c, 0))) for c in (0, 1)}
    picked = F.broadcast(chosen.withColumnRenamed("doc_id", "label_id"))
    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("label_id"))
    rows = cut_lineage(rows.groupBy("text").agg(F.max("toxic").alias("toxic")))
    if rows.count() > 2 * most_docs:
        rows = rows.orderBy(F.xxhash64("text"), "text").limit(2 * most_docs)
    return rows, sampled


def _differing(grams: DataFrame, share: float, significant: float, least: int, strong: float) -> DataFrame:
    # distinct neighbours by linear counting; full sets don't bound
    distinct = lambda c: F.round(-BITS * F.log(1 - F.least(F.bit_count(c), F.lit(BITS - 0.01)) / BITS))
    beside = lambda c: F.when(F.greatest(F.bit_count(f"{c}_before"), F.bit_count(f"{c}_after")) < BITS, F.greatest(distinct(f"{c}_before"), distinct(f"{c}_after")))
    t, o = (F.least(f"{c}_texts", beside(c)) for c in ("toxic", "ordinary"))
    part = lambda x, q: F.when(x > 0, x * F.log(x / ((t + o) * q))).otherwise(0.0)
    odds = F.abs(F.log((t + 0.5) / (o + 0.5)) - math.log(share / (1 - share)))
    return grams.where(t + o >= least).where(odds >= strong).where(2 * (part(t, share) + part(o, 1 - share)) >= significant)


def _how_often(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.sum((F.col(c) == k).cast("long")), F.lit(0)).alias(f"{c}_{k}") for c in columns for k in (1, 2, 3, 4)]


def fit(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS, significant: float = SIGNIFICANT, least: int = LEAST, strong: float = STRONG) -> Model:
    rows, sampled = training_rows(docs.select("doc_id", "text"), labels, most_docs)
    if not (sampled[0][0] and sampled[1][0]):
        share = (sampled[1][0] + 0.5) / (sampled[0][0] + sampled[1][0] + 1.5)
        return Model(offset=math.log(share / (1 - share)))
    # the sample is small, but its counts aren't
    spread = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism, "text")
    grams = spread.mapInArrow(_counts, "head binary, word binary, " + ", ".join(f"{c} long" for c in GRAMS[2:]))
    grams = grams.groupBy("head", "word").agg(*[F.sum(c).alias(c) for c in GRAMS[2:6]], *[F.bit_or(c).alias(c) for c in GRAMS[6:]]).persist()
    model = _compiled(grams, significant, least, strong)
    grams.unpersist()
    _calibrate(model, rows, sampled)
    return model


def _compiled(grams: DataFrame, significant: float, least: int, strong: float) -> Model:
    pairs, singles, stems = grams.where("head is not null"), grams.where("head is null and not endswith(word, x'2A')"), grams.where("head is null and endswith(word, x'2A')")
    both = ["toxic", "ordinary"]
    seen = pairs.agg(*_how_often(both)).first()
    contexts = pairs.groupBy("word").agg(*[F.sum((F.col(c) > 0).cast("long")).alias(c) for c in both], F.count(F.lit(1)).alias("either"))
    before = contexts.agg(*_how_often(both), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*both, "either")]).first()
    incidences = singles.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in GRAMS[4:6]]).first()
    if not before["toxic"] or not before["ordinary"]:
        return Model()
    share = incidences["toxic_texts"] / (incidences["toxic_texts"] + incidences["ordinary_texts"])
    by_pair, by_word = ([discounts([r[f"{c}_{k}"] for k in (1, 2, 3, 4)]) for c in both] for r in (seen, before))
    # each is in ``least`` texts of the bounded sample at least
    own_words = {bytes(r["word"]) for r in _differing(singles, share, significant, least, strong).select("word").collect()}
    own_stems = {bytes(r["word"]) for r in _differing(stems, share, significant, least, strong).select("word").collect()}
    own_pairs = [(bytes(r["head"]), bytes(r["word"]), *(r[c] for c in GRAMS[2:6])) for r in _differing(pairs, share, significant, least, strong).collect()]
    if not own_words and not own_stems and not own_pairs:
        return Model()
    spark = grams.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(w,) for w in own_words | {w for _, w, *_ in own_pairs}], "word binary"))
    known = {bytes(r["word"]): r for r in contexts.join(wanted, "word").collect()}
    by_stem = _by_stem(contexts, own_words, own_stems, dict(zip(both, by_word)))
    # the lower order: own shares of the words and beginnings kept, the rest by the shared backoff
    alone = [{w: discounted(known[w][c], by) / before[c] for w in own_words} for c, by in zip(both, by_word)]
    shared = [{b: r[c] / before[c] for b, r in by_stem.items()} for c in both]
    rest = [max(1e-9, 1 - math.fsum(x.values()) - math.fsum(y.values())) for x, y in zip(alone, shared)]

    def lower_stem(b: bytes) -> list[float]:
        return [y[b] + left * by_stem[b]["either"] / before["either"] for y, left in zip(shared, rest)]

    def lower(w: bytes) -> list[float]:
        stem = next((b for b in beginnings(w) if b in own_stems), None) if w not in own_words else None
        if stem in by_stem:
            return [x * known[w]["either"] / by_stem[stem]["either"] for x in lower_stem(stem)]
        return [x.get(w, 0.0) + left * known[w]["either"] / before["either"] for x, left in zip(alone, rest)]

    model = Model(constant=math.log(rest[0] / rest[1]))
    for w in own_words:
        t, o = lower(w)
        model.words[w] = math.log(t / o) - model.constant
    for b in own_stems:
        t, o = lower_stem(b) if b in by_stem else rest
        model.stems[b] = math.log(t / o) - model.constant
    # a pair has estimates of its own if its word alone doesn't explain how its texts differ
    kept: dict[bytes, dict[bytes, tuple[int, int]]] = {}
    for v, w, t, o, in_t, in_o in own_pairs:
        odds = math.log(share / (1 - share)) + model.alone(w) + model.alone(v)
        if g_squared(np.float64(in_t), np.float64(in_o), min(max(1 / (1 + math.exp(-odds)), 1e-9), 1 - 1e-9)) >= significant:
            kept.setdefault(v, {})[w] = (t, o)
    if kept:
        wanted = F.broadcast(spark.createDataFrame([(v,) for v in kept], "head binary"))
        sizes = {bytes(r["head"]): r for r in pairs.join(wanted, "head").groupBy("head").agg(*[F.sum(c).alias(c) for c in both]).collect()}
        for v, after in kept.items():
            own = [{w: discounted(n[k], by_pair[k]) / sizes[v][c] if sizes[v][c] else 0.0 for w, n in after.items()} for k, c in enumerate(both)]
            left = [max(1e-9, 1 - math.fsum(x.values())) for x in own]
            model.heads[v] = math.log(left[0] / left[1])
            for w in after:
                t, o = lower(w)
                model.pairs[v, w] = math.log((own[0][w] + left[0] * t) / (own[1][w] + left[1] * o)) - math.log(t / o)
    return model


def _by_stem(contexts: DataFrame, own_words: set[bytes], own_stems: set[bytes], by: dict[str, tuple[float, float, float]]) -> dict:
    """Of each kept beginning: the discounted counts of its words (those without own estimates or a longer beginning), and ``either``."""
    if not own_stems:
        return {}
    spark = contexts.sparkSession
    cut = lambda k: F.when(F.char_length("letters") >= k, F.concat(F.substring("letters", 1, k), F.lit(CUT.decode())))
    left = lambda c: sum((F.when(F.col(c) == k, F.greatest(F.lit(0.0), k - F.lit(d))).otherwise(0.0) for k, d in zip((1, 2), by[c])), F.when(F.col(c) > 2, F.col(c) - by[c][2]).otherwise(0.0))
    words = contexts.select(F.col("word").cast("string").alias("letters"), "either", *[left(c).alias(c) for c in by])
    if own_words:
        words = words.join(F.broadcast(spark.createDataFrame([(w.decode(),) for w in own_words], "letters string")), "letters", "left_anti")
    words = words.withColumn("stem", F.explode(F.array_compact(F.array(*[cut(k) for k in range(SHORTEST, LONGEST + 1)]))))
    words = words.join(F.broadcast(spark.createDataFrame([(b.decode(),) for b in own_stems], "stem string")), "stem")
    longest = words.groupBy("letters", "either", *by).agg(F.max_by("stem", F.length("stem")).alias("stem"))
    return {r["stem"].encode(): r for r in longest.groupBy("stem").agg(*[F.sum(c).alias(c) for c in (*by, "either")]).collect()}


def _calibrate(model: Model, rows: DataFrame, sampled: dict[int, tuple[int, int]]) -> None:
    """Two parameters by Newton's steps; a class weighs as among all labelled documents."""
    seen = rows.select(evidence_column(model, F.col("text")).alias("x"), "toxic").collect()  # the bounded sample
    x, y = bend(np.array([r["x"] for r in seen])), np.array([r["toxic"] for r in seen], float)
    weight = np.where(y == 1, sampled[1][0] / max(1, sampled[1][1]), sampled[0][0] / max(1, sampled[0][1]))
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge @ beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = max(0.0, float(beta[0])), float(beta[1])


def evidence_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def evidence(texts: pa.Array) -> pa.Array:
        return pa.array([model.evidence(t.as_py()) for t in texts], pa.float64())

    return evidence(text)


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([model.evidence(t.as_py()) for t in texts], float)), pa.float64())

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, most_docs)
    scored = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text scores under one half."""
    model = fit(docs, labels, most_docs)
    return docs.where(score_column(model, F.col("text")) < 0.5)
