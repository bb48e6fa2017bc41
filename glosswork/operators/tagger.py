"""Statistics and decoding of part-of-speech taggers over token tables.

Models are tables. Counting is aggregation over (doc_id, pos, tags, class) rows; what is sequential,
Viterbi and the forward-backward pass, works on runs that end with an unambiguous word. A run
depends on nothing but the tag before it and its classes, so each distinct run is solved once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import OPEN_CLASS

START = "sent"
#: Probability of what was forbidden or never seen, and the least positive double.
ZERO, TINY = 1e-10, 2.2250738585072014e-308


def ambiguity_classes(tokens: DataFrame, open_class: Iterable[str] = OPEN_CLASS, tags: Iterable[str] = ()) -> DataFrame:
    """(class, tags): those seen, the open class, and each tag by itself."""
    spark = tokens.sparkSession
    seen = tokens.select("class").distinct()
    every = seen.select(F.explode(F.split("class", r"\|")).alias("class"))
    named = [*tags, "|".join(sorted(open_class)), *open_class, START]
    more = spark.createDataFrame([(t,) for t in sorted(set(named))], "class string")
    return seen.union(every).union(more).distinct().withColumn("tags", F.split("class", r"\|"))


def first_examples(tokens: DataFrame) -> DataFrame:
    """The first token (by doc_id, pos) of each ambiguity class."""
    first = tokens.groupBy("class").agg(F.min(F.struct("doc_id", "pos", "surface")).alias("f"), F.count(F.lit(1)).alias("n"))
    return first.select("class", "f.doc_id", "f.pos", "f.surface", "n")


def similar_classes(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """For each wanted (class, tags) the smallest known class that has all its tags.

    Joined on one of the tags, not against all classes; ties go to the smaller name. A class that
    nothing contains gets null.
    """
    keyed = known.select(F.col("class").alias("similar_class"), F.col("tags").alias("held")).withColumn("tag", F.explode("held"))
    pairs = wanted.withColumn("tag", F.element_at("tags", 1)).join(keyed, "tag", "left")
    fits = F.size(F.array_except("tags", F.coalesce("held", F.array().cast("array<string>")))) == 0
    best = F.min(F.when(fits, F.struct(F.size("held").alias("size"), F.col("similar_class").alias("similar_class"))))
    return pairs.groupBy("class").agg(best.alias("b")).select("class", F.col("b.similar_class").alias("similar_class"))


def _previous(tokens: DataFrame, column: str, start: str = START) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("pos")
    return tokens.withColumn("previous", F.lag(column, 1, start).over(order))


def class_pairs(tokens: DataFrame) -> dict[tuple[str, str], int]:
    """How often each class comes after each: one scan, and as few numbers as the tag set allows."""
    rows = _previous(tokens, "class").groupBy("previous", "class").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(r["previous"], r["class"]): r["n"] for r in rows}


def classes_of(spark: SparkSession, seen: Iterable[str], open_class: Iterable[str] = OPEN_CLASS) -> DataFrame:
    """ambiguity_classes() of the classes that class_pairs() has."""
    names = {*seen, *(t for c in seen for t in c.split("|")), "|".join(sorted(open_class)), *open_class, START}
    return spark.createDataFrame([(c, c.split("|")) for c in sorted(names)], "class string, tags array<string>")


def kupiec_counts(tokens: DataFrame, classes: DataFrame, seen: dict[tuple[str, str], int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Class counts (class, n) and pair counts (previous, class, n); each starts at one."""
    seen = class_pairs(tokens) if seen is None else seen
    names = sorted(r["class"] for r in classes.select("class").collect())
    rows = [(p, c, seen.get((p, c), 0) + 1) for p in names for c in names]
    pairs = tokens.sparkSession.createDataFrame(rows, "previous string, class string, n long")
    single = pairs.groupBy("previous").agg((F.sum(F.col("n") - 1) + 1).alias("n")).withColumnRenamed("previous", "class")
    return single, pairs


def kupiec_transitions(tokens: DataFrame, classes: DataFrame, seen: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(tag_i, tag_j, p): counts of class pairs spread evenly over their tags, normalised."""
    _, pairs = kupiec_counts(tokens, classes, seen)
    spread = pairs.select(F.split("previous", r"\|").alias("i"), F.split("class", r"\|").alias("j"), "n")
    spread = spread.withColumn("w", F.col("n") / (F.size("i") * F.size("j")))
    spread = spread.select(F.explode("i").alias("tag_i"), "j", "w").select("tag_i", F.explode("j").alias("tag_j"), "w")
    sums = spread.groupBy("tag_i", "tag_j").agg(F.sum("w").alias("w"))
    return sums.select("tag_i", "tag_j", (F.col("w") / F.sum("w").over(Window.partitionBy("tag_i"))).alias("p"))


def kupiec_emissions(tokens: DataFrame, classes: DataFrame, seen: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """(tag, class, p)."""
    single, _ = kupiec_counts(tokens, classes, seen)
    spread = single.withColumn("tags", F.split("class", r"\|")).select("class", F.explode("tags").alias("tag"), (F.col("n") / F.size("tags")).alias("w"))
    return spread.select("tag", "class", (F.col("w") / F.sum("w").over(Window.partitionBy("tag"))).alias("p"))


def kupiec_model(tokens: DataFrame, open_class: Iterable[str] = OPEN_CLASS) -> dict:
    """Kupiec's estimate, from one count of the corpus."""
    seen = class_pairs(tokens)
    classes = classes_of(tokens.sparkSession, {c for _, c in seen}, open_class)
    return model_of(kupiec_transitions(tokens, classes, seen), kupiec_emissions(tokens, classes, seen))


def supervised_transitions(tagged: DataFrame, tags: list[str]) -> DataFrame:
    """(tag_i, tag_j, p) from one gold tag a token (column ``gold``): (n + 1) / sum(n + 1)."""
    spark = tagged.sparkSession
    pairs = _previous(tagged, "gold").groupBy(F.col("previous").alias("tag_i"), F.col("gold").alias("tag_j")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.createDataFrame([(i, j) for i in tags for j in tags], "tag_i string, tag_j string")
    counts = grid.join(pairs, ["tag_i", "tag_j"], "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return counts.select("tag_i", "tag_j", (F.col("n") / F.sum("n").over(Window.partitionBy("tag_i"))).alias("p"))


def supervised_emissions(tagged: DataFrame, classes: DataFrame) -> DataFrame:
    """(tag, class, p): (e + 1 / c) / (t + 1); c: classes with the tag."""
    counts = tagged.groupBy(F.col("gold").alias("tag"), "class").agg(F.count(F.lit(1)).alias("e"))
    grid = classes.select("class", F.explode("tags").alias("tag"))
    rows = grid.join(counts, ["tag", "class"], "left").withColumn("e", F.coalesce("e", F.lit(0)))
    by_tag = Window.partitionBy("tag")
    p = (F.col("e") + 1 / F.count(F.lit(1)).over(by_tag)) / (F.sum("e").over(by_tag) + 1)
    return rows.select("tag", "class", p.alias("p"))


def apply_rules(transitions: DataFrame, forbid: list[tuple[str, str]] = (), enforce: dict[str, list[str]] | None = None) -> DataFrame:
    """Forbidden transitions get ``ZERO``; after a tag with an enforce rule all others do; rows are normalised."""
    banned = F.lit(False)
    for i, j in forbid:
        banned = banned | ((F.col("tag_i") == i) & (F.col("tag_j") == j))
    for i, allowed in (enforce or {}).items():
        banned = banned | ((F.col("tag_i") == i) & ~F.col("tag_j").isin(list(allowed)))
    rows = transitions.withColumn("p", F.when(banned, F.lit(ZERO)).otherwise(F.col("p")))
    return rows.select("tag_i", "tag_j", (F.col("p") / F.sum("p").over(Window.partitionBy("tag_i"))).alias("p"))


# runs, Viterbi, Baum-Welch


def runs(tokens: DataFrame) -> DataFrame:
    """(doc_id, run, first, start, classes): tokens up to and with each unambiguous one.

    ``start`` is the tag before the run; a last run that ends ambiguously is kept.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    done = F.sum((F.size("tags") == 1).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = tokens.withColumn("run", F.coalesce(done, F.lit(0)).cast("long")).withColumn("before", F.lag("class", 1, START).over(order))
    grouped = rows.groupBy("doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "class", "before"))).alias("r"))
    return grouped.select("doc_id", "run", F.col("r")[0]["pos"].alias("first"), F.col("r")[0]["before"].alias("start"), F.transform("r", lambda x: x["class"]).alias("classes"))


def model_of(transitions: DataFrame, emissions: DataFrame) -> dict:
    """A model small enough for every task: tags squared and tags times classes."""
    return {
        "a": {(r["tag_i"], r["tag_j"]): r["p"] for r in transitions.collect()},
        "b": {(r["tag"], r["class"]): r["p"] for r in emissions.collect()},
    }


def known_class(model: dict, class_: str) -> str:
    """The class whose emissions stand for a class: itself, or of those seen the smallest that has all
    its tags, or the open class; ties go to the smaller name."""
    held = model.setdefault("similar", {})
    if class_ not in held:
        names = {k for _, k in model["b"]}
        wanted = set(class_.split("|"))
        fits = [k for k in names if wanted <= set(k.split("|"))]
        held[class_] = class_ if class_ in names else min(fits, key=lambda k: (k.count("|"), k), default="|".join(sorted(OPEN_CLASS)))
    return held[class_]


def viterbi_run(model: dict, start: str, classes: list[str]) -> list[str]:
    """The best tags; among equal ones the later previous tag (in tag order).

    An unknown word, which has no tags, may have those of the open class; a class that the model
    hasn't seen takes the emissions of a similar one.
    """
    a, b = model["a"], model["b"]
    scores: dict[str, float] = {start: 1.0}
    paths: dict[str, list[str]] = {start: []}
    for class_ in classes:
        own = class_ or "|".join(sorted(OPEN_CLASS))
        like = known_class(model, own)
        new_scores, new_paths = {}, {}
        for i in own.split("|"):
            best, path = 0.0, []
            for j in sorted(scores):
                x = scores[j] * a.get((j, i), 0.0) * b.get((i, like), 0.0)
                if best <= x:
                    best, path = x, paths[j]
            new_scores[i], new_paths[i] = best, [*path, i]
        scores, paths = new_scores, new_paths
    top = max(scores.values())
    return paths[max(t for t in scores if scores[t] == top)]


def brute_force_run(model: dict, start: str, classes: list[str]) -> float:
    """The probability of the best path, by trying all; for tests."""
    best = [(1.0, start)]
    for class_ in classes:
        best = [(p * model["a"].get((j, i), 0.0) * model["b"].get((i, class_), 0.0), i) for p, j in best for i in class_.split("|")]
    return max(p for p, _ in best)


def viterbi(tokens: DataFrame, model: dict) -> DataFrame:
    """(doc_id, pos, tag) of every token; distinct runs are decoded once."""
    shared = tokens.sparkSession.sparkContext.broadcast({"a": model["a"], "b": model["b"]})
    rows = runs(tokens)
    distinct = rows.select("start", "classes").distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [viterbi_run(shared.value, s, c) for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["start", "classes", "chosen"])

    solved = distinct.mapInArrow(work, "start string, classes array<string>, chosen array<string>")
    out = rows.join(solved, ["start", "classes"]).select("doc_id", "first", F.posexplode("chosen").alias("k", "tag"))
    return out.select("doc_id", (F.col("first") + F.col("k")).alias("pos"), "tag")


def expected_counts(model: dict, start: str, classes: list[str]) -> tuple[dict, dict, dict, float]:
    """(xi, gamma, phi) of one run that ends unambiguously, and its probability."""
    a, b = model["a"], model["b"]
    alpha = [{start: 1.0}]
    for class_ in classes:
        step = {i: sum(alpha[-1][j] * a.get((j, i), 0.0) for j in alpha[-1]) * b.get((i, class_), 0.0) for i in class_.split("|")}
        alpha.append({i: x or TINY for i, x in step.items()})
    prob = alpha[-1][classes[-1]]
    xi, gamma, phi = defaultdict(float), defaultdict(float), defaultdict(float)
    beta = {classes[-1]: 1.0}
    for t in range(len(classes), 0, -1):
        class_, before = classes[t - 1], defaultdict(float)
        for i in class_.split("|"):
            for j in alpha[t - 1]:
                flow = a.get((j, i), 0.0) * b.get((i, class_), 0.0) * beta[i]
                before[j] += flow
                xi[j, i] += alpha[t - 1][j] * flow / prob
            share = alpha[t][i] * beta[i] / prob
            gamma[i] += share or TINY
            phi[i, class_] += share
        beta = before
    return xi, gamma, phi, prob


def baum_welch_step(tokens: DataFrame, model: dict) -> tuple[dict, float]:
    """One step of expectation-maximisation over all whole runs: (new model, log-likelihood).

    Partial sums come back as one row for each pair, so at most tags squared plus tags x classes.
    """
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast(model)
    distinct = runs(tokens).where(~F.contains(F.element_at("classes", -1), F.lit("|"))).groupBy("start", "classes").agg(F.count(F.lit(1)).alias("n"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], float] = defaultdict(float)
        for batch in batches:
            for start, classes, n in zip(*(c.to_pylist() for c in batch.columns)):
                xi, gamma, phi, prob = expected_counts(shared.value, start, classes)
                for (j, i), x in xi.items():
                    sums["xi", j, i] += n * x
                for i, x in gamma.items():
                    sums["gamma", i, ""] += n * x
                for (i, k), x in phi.items():
                    sums["phi", i, k] += n * x
                sums["log", "", ""] += n * math.log(prob)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([*[pa.array([k[c] for k in keys], pa.string()) for c in range(3)], pa.array([sums[k] for k in keys], pa.float64())], names=["kind", "x", "y", "v"])

    rows = distinct.mapInArrow(work, "kind string, x string, y string, v double").groupBy("kind", "x", "y").agg(F.sum("v").alias("v")).collect()
    by = {(r["kind"], r["x"], r["y"]): r["v"] for r in rows}
    tags = sorted({t for pair in model["a"] for t in pair})
    outgoing = defaultdict(float)
    for (kind, x, _), v in by.items():
        if kind == "xi":
            outgoing[x] += v
    a = {(i, j): by.get(("xi", i, j), 0.0) / outgoing[i] if by.get(("xi", i, j)) else ZERO for i in tags for j in tags}
    b = {(i, k): by.get(("phi", i, k), 0.0) / by["gamma", i, ""] if by.get(("phi", i, k)) else ZERO for i, k in model["b"]}
    for table in (a, b):
        sums = defaultdict(float)
        for (i, _), v in table.items():
            sums[i] += v
        for key in table:
            table[key] /= sums[key[0]]
    return {"a": a, "b": b}, by.get(("log", "", ""), 0.0)


def train_hmm(tokens: DataFrame, classes: DataFrame, iterations: int = 8, forbid=(), enforce=None) -> dict:
    """Kupiec's estimate, then steps of EM; rules are applied after each."""
    spark = tokens.sparkSession

    def ruled(a: dict) -> dict:
        rows = spark.createDataFrame([(i, j, p) for (i, j), p in a.items()], "tag_i string, tag_j string, p double")
        return {(r["tag_i"], r["tag_j"]): r["p"] for r in apply_rules(rows, forbid, enforce).collect()}

    model = model_of(apply_rules(kupiec_transitions(tokens, classes), forbid, enforce), kupiec_emissions(tokens, classes))
    for _ in range(iterations):
        model, _ = baum_welch_step(tokens, model)
        model["a"] = ruled(model["a"])
    return model


def retag(tokens: DataFrame, model: dict, new_forbid=(), new_enforce=None) -> DataFrame:
    """Apply new rules to a stored model, then tag."""
    spark = tokens.sparkSession
    rows = spark.createDataFrame([(i, j, p) for (i, j), p in model["a"].items()], "tag_i string, tag_j string, p double")
    a = {(r["tag_i"], r["tag_j"]): r["p"] for r in apply_rules(rows, new_forbid, new_enforce).collect()}
    return viterbi(tokens, {"a": a, "b": model["b"]})


# light sliding windows


def _triples(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, left, mid, right) tags of all words with a right neighbour."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    left = F.coalesce(F.lag("tags").over(order), F.array(F.lit(START)))
    rows = tokens.select("doc_id", "pos", left.alias("left"), F.col("tags").alias("mid"), F.lead("tags").over(order).alias("right"))
    return rows.where("right is not null")


def _valid(l: str, m: str, r: str, forbid, enforce) -> F.Column:
    bad = F.lit(False)
    for i, j in forbid:
        bad = bad | ((F.col(l) == i) & (F.col(m) == j)) | ((F.col(m) == i) & (F.col(r) == j))
    for i, allowed in (enforce or {}).items():
        bad = bad | ((F.col(l) == i) & ~F.col(m).isin(list(allowed))) | ((F.col(l) != i) & (F.col(m) == i) & ~F.col(r).isin(list(allowed)))
    return ~bad


def _window_classes(tokens: DataFrame) -> DataFrame:
    """Windows of classes with their counts: what expansion works on, however long the corpus."""
    return _triples(tokens).groupBy("left", "mid", "right").agg(F.count(F.lit(1)).alias("windows"))


def _expanded(windows: DataFrame) -> DataFrame:
    rows = windows.select("*", F.explode("left").alias("l"))
    rows = rows.select("*", F.explode("mid").alias("m"))
    return rows.select("*", F.explode("right").alias("r"))


def lsw_initial(tokens: DataFrame, forbid=(), enforce=None) -> DataFrame:
    """(l, m, r, d): each window's valid sequences share one count."""
    rows = _expanded(_window_classes(tokens)).where(_valid("l", "m", "r", forbid, enforce))
    share = F.count(F.lit(1)).over(Window.partitionBy("left", "mid", "right"))
    return rows.withColumn("d", F.col("windows") / share).groupBy("l", "m", "r").agg(F.sum("d").alias("d"))


def lsw_step(tokens: DataFrame, parameters: DataFrame) -> DataFrame:
    """One step of EM over the windows."""
    rows = _expanded(_window_classes(tokens)).join(parameters, ["l", "m", "r"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    total = F.sum("d").over(Window.partitionBy("left", "mid", "right"))
    rows = rows.withColumn("total", total).where(F.col("total") > ZERO)
    return rows.withColumn("d", F.col("windows") * F.col("d") / F.col("total")).groupBy("l", "m", "r").agg(F.sum("d").alias("d")).where("d > 0")


def train_lsw(tokens: DataFrame, iterations: int = 4, forbid=(), enforce=None) -> DataFrame:
    """The initial parameters and steps of EM; tables have at most the cube of the tag set's rows."""
    parameters = lsw_initial(tokens, forbid, enforce)
    for _ in range(iterations):
        held = [tuple(r) for r in lsw_step(tokens, parameters).collect()]
        parameters = tokens.sparkSession.createDataFrame(held, "l string, m string, r string, d double")
    return parameters


def lsw_choices(tokens: DataFrame, parameters: DataFrame) -> DataFrame:
    """(left, mid, right, windows, tag): the middle tag with the largest sum, the first of equals."""
    rows = _expanded(_window_classes(tokens)).join(parameters, ["l", "m", "r"], "left")
    sums = rows.groupBy("left", "mid", "right", "windows", "m").agg(F.sum(F.coalesce("d", F.lit(0.0))).alias("s"))
    best = F.min(F.struct((-F.round("s", 9)).alias("s"), F.col("m").alias("m")))
    return sums.groupBy("left", "mid", "right", "windows").agg(best.alias("b")).select("left", "mid", "right", "windows", F.col("b.m").alias("tag"))


def lsw_decode(tokens: DataFrame, parameters: DataFrame) -> DataFrame:
    """(doc_id, pos, tag) of every word with a right neighbour."""
    choices = lsw_choices(tokens, parameters).select("left", "mid", "right", "tag")
    return _triples(tokens).join(choices, ["left", "mid", "right"]).select("doc_id", "pos", "tag")


# unigrams


def coefficient(first_sizes: list[int]) -> int:
    """The common multiple that integer counts are scaled by, from the numbers of readings in the
    order in which each first occurs."""
    return reduce(lambda c, n: c if c % n == 0 else c * n, first_sizes, 1)


def corpus_coefficient(tokens: DataFrame) -> int:
    rows = tokens.groupBy(F.size("tags").alias("n")).agg(F.min(F.struct("doc_id", "pos")).alias("at")).orderBy("at").collect()  # one row a number of readings
    return coefficient([r["n"] for r in rows])


def unigram_counts(tokens: DataFrame, coefficient_: int) -> DataFrame:
    """(lemma, tag, f): each token shares the coefficient among its readings."""
    rows = tokens.select("lemma", F.size("tags").alias("n"), F.explode("tags").alias("tag"))
    # whole numbers: tokens are counted by their number of readings first
    counts = rows.groupBy("lemma", "tag", "n").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("lemma", "tag").agg(F.sum(F.expr(f"c * {coefficient_} div n")).alias("f"))


def unigram_scores(counts: DataFrame, model: int = 1) -> DataFrame:
    """(lemma, tag, f, score) of analyses of one morpheme under models 1, 2 and 3.

    Models 2 and 3 smooth with the sums of a tag and the number of lemmas seen with it; they
    differ in how they join further morphemes (compound_score).
    """
    if model == 1:
        return counts.withColumn("score", F.col("f").cast("double") + 1)
    by_tag = counts.groupBy("tag").agg(F.sum("f").alias("sum_f"), F.count(F.lit(1)).alias("types"))
    rows = counts.join(F.broadcast(by_tag), "tag")  # a row for each tag
    score = (1 + F.col("f")) * (1 + F.col("sum_f")) / ((1 + F.col("sum_f")) + F.col("types"))
    return rows.select("lemma", "tag", "f", score.cast("double").alias("score"))


def compound_score(morphemes: list[tuple[str, str]], f_tag_lemma: dict, f_prev_lemma: dict, f_lemma_tag: dict) -> float:
    """Model 3 for an analysis of several (lemma, tags) morphemes, from tables of nested counts."""

    def smoothed(table: dict, given: str, seen: str) -> float:
        own = table.get(given, {})
        total, types = sum(own.values()), len(own) + (seen not in own)
        return (1 + own.get(seen, 0)) * (1 + total) / ((1 + total) + types)

    lemma, tags = morphemes[0]
    score = smoothed(f_tag_lemma, tags, lemma)
    for lemma, own in morphemes[1:]:
        score *= smoothed(f_prev_lemma, tags, lemma) * smoothed(f_lemma_tag, lemma, own)
        tags = own
    return score


def unigram_decode(tokens: DataFrame, scores: DataFrame) -> DataFrame:
    """(class, lemma, tag): the best reading of each distinct word, the first of equals."""
    forms = tokens.select("lemma", "class", F.posexplode("tags").alias("k", "tag")).distinct()
    rows = forms.join(scores.select("lemma", "tag", "score"), ["lemma", "tag"], "left")
    best = F.max(F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), (-F.col("k")).alias("k"), F.col("tag").alias("tag")))
    return rows.groupBy("lemma", "class").agg(best.alias("b")).select("lemma", "class", F.col("b.tag").alias("tag"))
