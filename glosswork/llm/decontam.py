"""Benchmark decontamination by BM25 retrieval with block-max WAND.

The test items are the inverted index, and every passage of every document is a query: windows of
words, three times the longest item's length at a stride of one, so that every span of twice that
length lies whole in one. An item is held if any such span holds enough of it, wherever it starts.
Impacts are divided by the least score that a passage can have which holds the wanted share of the
item's five-word shingles, so all items with a score of one or more are retrieved, and no such
passage is missed. A first, vectorised step takes the bound that WAND's pivot takes (the essential
terms met, plus all that the frequent ones could add) for all passages at once; block-max WAND runs
on the passages that can reach one. What it retrieves is verified: an item is held if some span has
0.8 of its shingles, and in that span half of the words of its question and half of those of its
answer, so that a question without its answer isn't a leak, nor the other way round.

The question of an item is all but its last sentence, the answer the last one; an item of a single
sentence is all question. An item of fewer than five words is one shingle.

Defined results: null, empty and short texts are one passage or none; an item without words matches
nothing; repeated rows of documents each get their matches; items of equal id are items of their
own; an empty table on either side gives no match. Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, OVERLAP, PART = 5, 0.8, 0.5
K1, B = 1.2, 0.75
#: Postings in a block, words of items in the smallest class of lengths.
BLOCK, SHORTEST = 64, 64
#: Items, and bytes of their texts, that are indexed for one pass over the documents.
ITEMS, BYTES = 50_000, 32 << 20
#: Words of documents that are queried at once.
CHUNK = 300_000

_BLANKED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BLANKED).split()


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return list(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) > SHINGLE else [tuple(words)] if words else []


def question_and_answer(text: str) -> tuple[str, str]:
    sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if words_of(s)]
    if len(sentences) < 2:
        return text, ""
    return text[: text.rindex(sentences[-1])], sentences[-1]


@dataclass
class Item:
    item_id: int | None
    shingles: list[tuple[bytes, ...]]
    times: Counter[tuple[bytes, ...]]
    question: Counter[bytes]
    answer: Counter[bytes]
    impacts: dict[int, float]


class Index:
    """Items of one class of lengths, their postings with impacts, and the sizes of passages."""

    def __init__(self, rows: list[tuple[int | None, str | None]], longest: int) -> None:
        self.stride, self.span = longest, 2 * longest
        texts = [(i, t, w) for i, t in rows if (w := words_of(t))]
        self.items = [Item(i, shingles(w), Counter(shingles(w)), *[Counter(words_of(x)) for x in question_and_answer(t)], {}) for i, t, w in texts]
        lengths = np.array([len(w) for _, _, w in texts], float)
        counts = [dict(zip(*np.unique(np.array(w, object), return_counts=True))) for _, _, w in texts]
        self.terms = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        n, mean = len(texts), float(lengths.mean()) if len(texts) else 1.0
        posting: list[list[int]] = [[] for _ in self.terms]
        for j, c in enumerate(counts):
            for t in c:
                posting[self.terms[t]].append(j)
        df = np.array([len(p) for p in posting], float)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.starts = np.concatenate([[0], np.cumsum([len(p) for p in posting])]).astype(np.int64)
        self.of = np.array([j for p in posting for j in p], np.int64)
        raw = np.zeros(len(self.of))
        for t, k in self.terms.items():
            for at in range(self.starts[k], self.starts[k + 1]):
                tf = counts[self.of[at]][t]
                raw[at] = idf[k] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.of[at]] / mean))
        self.least = np.zeros(n)
        own: list[list[float]] = [[] for _ in texts]
        for j, x in zip(self.of, raw):
            own[j].append(x)
        for j, item in enumerate(self.items):
            lost = len(item.shingles) - int(np.ceil(OVERLAP * len(item.shingles) - 1e-9))
            self.least[j] = max(1e-9, sum(sorted(own[j])[: len(own[j]) - lost]) * (1 - 1e-9))
        self.impact = raw / self.least[self.of]
        # frequent terms whose impacts together stay well under one in every item aren't essential
        held = np.zeros(n)
        self.essential = np.ones(len(self.terms), bool)
        for k in np.argsort(-df, kind="stable"):
            own_items, own_impact = self.of[self.starts[k] : self.starts[k + 1]], self.impact[self.starts[k] : self.starts[k + 1]]
            if df[k] < 3 or (held[own_items] + own_impact > 0.5).any():
                continue
            held[own_items] += own_impact
            self.essential[k] = False
        self.needed = 1 - held
        self.highest = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.of) else np.zeros(0)
        places = list(zip(self.starts.tolist(), self.starts[1:].tolist()))
        # for walking them one by one, lists are faster than arrays
        self.postings = [(self.of[a:b].tolist(), self.impact[a:b].tolist()) for a, b in places]
        self.blocks = [(self.of[a:b][BLOCK - 1 :: BLOCK].tolist(), [float(self.impact[x : min(x + BLOCK, b)].max()) for x in range(a, b, BLOCK)]) for a, b in places]
        for k, (of, impact) in enumerate(self.postings):
            for j, x in zip(of, impact):
                self.items[j].impacts[k] = x

    def candidates(self, ids: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Windows that can reach one, given (term, window) of all words in the index's vocabulary."""
        keep = self.essential[ids]
        pairs = np.unique(window[keep] * len(self.terms) + ids[keep])
        if not len(pairs):
            return pairs
        window, term = np.divmod(pairs, len(self.terms))
        sizes = self.starts[term + 1] - self.starts[term]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[term] - (ends - sizes), sizes)
        met, place = np.unique(np.repeat(window, sizes) * len(self.items) + self.of[at], return_inverse=True)
        sums = np.bincount(place, weights=self.impact[at])
        window, item = np.divmod(met, len(self.items))
        return np.unique(window[sums >= self.needed[item] - 1e-9])

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items with a score of one or more for a passage of distinct terms: block-max WAND."""
        end = len(self.items)
        lists = [self.postings[k] for k in terms]
        at = [0] * len(terms)
        now = [of[0] for of, _ in lists]  # the item that each posting list is at; ``end`` when it is done
        highest = [float(self.highest[k]) for k in terms]

        def move(c: int, item: int) -> None:
            of = lists[c][0]
            at[c] = bisect_left(of, item, at[c])
            now[c] = of[at[c]] if at[c] < len(of) else end

        def block(c: int, item: int) -> tuple[float, int]:
            """The most that the block where the item would be can add, and the block's last item."""
            lasts, most = self.blocks[terms[c]]
            k = bisect_left(lasts, item)
            return (most[k], lasts[k] if k < len(lasts) else end) if k < len(most) else (0.0, end)

        live = list(range(len(terms)))
        found = []
        while True:
            live = [c for c in live if now[c] < end]
            live.sort(key=now.__getitem__)
            order = live
            bound, pivot = 0.0, None
            for k, c in enumerate(order):
                bound += highest[c]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                return found
            item = now[order[pivot]]
            while pivot + 1 < len(order) and now[order[pivot + 1]] == item:
                pivot += 1
            reach = [block(c, item) for c in order[: pivot + 1]]
            if sum(r[0] for r in reach) < 1 - 1e-9:
                beyond = min(r[1] for r in reach) + 1
                if pivot + 1 < len(order):
                    beyond = min(beyond, now[order[pivot + 1]])
                for c in order[: pivot + 1]:
                    move(c, max(beyond, item + 1))
            elif now[order[0]] == item:
                score = sum(lists[c][1][at[c]] for c in order[: pivot + 1])
                if score >= 1 - 1e-9:
                    found.append((item, score))
                for c in order[: pivot + 1]:
                    move(c, item + 1)
            else:
                for c in order[:pivot]:
                    if now[c] < item:
                        move(c, item)

    def _best_span(self, own: list[bytes], j: int, runs: list[tuple[bytes, ...]], starts: int) -> tuple | None:
        """(overlap, score, question, answer) of the best span that starts at one of the first ``starts`` words."""
        item = self.items[j]
        width, total = len(item.shingles[0]), len(item.shingles)
        places = [x for x, run in enumerate(runs) if run in item.times]
        inside: Counter[tuple[bytes, ...]] = Counter()
        held, end, best = 0, 0, None
        for x in places:
            if x >= starts:
                break
            while end < len(places) and places[end] + width <= x + self.span:
                run = runs[places[end]]
                held += item.times[run] if not inside[run] else 0
                inside[run] += 1
                end += 1
            overlap = held / total
            if overlap >= OVERLAP - 1e-9 and (best is None or overlap >= best[0]):
                passage = own[x : x + self.span]
                words = Counter(passage)
                parts = [(part & words).total() / part.total() if part else 1.0 for part in (item.question, item.answer)]
                if min(parts) >= PART:
                    score = sum(item.impacts.get(self.terms[w], 0.0) for w in words if w in self.terms) * float(self.least[j])
                    found = (overlap, score, *parts)
                    best = found if best is None else max(best, found)
                    if held == total and min(parts) == 1.0:  # no span has more
                        break
            inside[runs[x]] -= 1
            held -= item.times[runs[x]] if not inside[runs[x]] else 0
        return best

    def matches(self, texts: list[str | None]) -> list[list[tuple]]:
        """Of every text: (item_id, score, overlap, question_overlap, answer_overlap), verified."""
        return matches([self], texts)

    def add_matches(self, words: list[list[bytes]], out: list[list[tuple]], first: int) -> None:
        """Append the matches of texts, given as words, to ``out`` from ``first`` on."""
        if not self.items:
            return
        sizes = np.array([len(w) for w in words], np.int64)
        # a text of n words has windows 0 .. max(0, ceil(n / stride) - 3)
        windows = np.maximum(1, -(-sizes // self.stride) - 2)
        base = np.cumsum(windows) - windows
        ids = np.fromiter(map(self.terms.get, chain.from_iterable(words), repeat(-1)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(words)), sizes)
        step = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) // self.stride
        known = ids >= 0
        ids, text, step = ids[known], text[known], step[known]
        # a word is in the window that starts at its own stride and in the two before
        inside = [(step >= back) & (step - back < windows[text]) for back in range(3)]
        window = np.concatenate([(base[text] + step - back)[own] for back, own in enumerate(inside)])
        hits = self.candidates(np.concatenate([ids[own] for own in inside]), window)
        best: dict[tuple[int, int], tuple] = {}
        for w in hits.tolist():
            k = int(np.searchsorted(base, w, "right")) - 1
            a = (w - int(base[k])) * self.stride
            own = words[k][a : a + 3 * self.stride]
            # later spans are looked for in the next window
            starts = self.stride if a // self.stride + 1 < windows[k] else len(own)
            terms = sorted({i for i in map(self.terms.get, own) if i is not None})
            runs: dict[int, list[tuple[bytes, ...]]] = {}
            for j, _ in self.search(terms):
                m = len(self.items[j].shingles[0])
                if m not in runs:
                    runs[m] = [tuple(own[x : x + m]) for x in range(len(own) - m + 1)]
                if found := self._best_span(own, j, runs[m], starts):
                    best[k, j] = max(found, best.get((k, j), found))
        for (k, j), (overlap, score, question, answer) in sorted(best.items()):
            out[first + k].append((self.items[j].item_id, score, overlap, question, answer))


def matches(indexes: list[Index], texts: list[str | None]) -> list[list[tuple]]:
    """What all the indexes match in every text; texts are cut into words once."""
    out: list[list[tuple]] = [[] for _ in texts]
    done = 0
    while done < len(texts):
        words, total, row = [], 0, done
        while row < len(texts) and (total == 0 or total < CHUNK):
            own = words_of(texts[row])
            words.append(own)
            total += len(own)
            row += 1
        for index in indexes:
            index.add_matches(words, out, done)
        done = row
    return out


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", items: int = ITEMS, size: int = BYTES) -> Iterator[list[Index]]:
    """The indexes of each pass over the documents, one for every class of lengths; together they hold all items.

    Items are dealt to as many passes, by hash, as keep each within about ``items`` items and
    ``size`` bytes; a single item that is longer has a pass by itself.
    """
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # words as counted here are at least as many as any index's own count of ASCII-split words
    rows = rows.withColumn("n", F.size(F.split(F.trim("text"), r"[^\p{L}\p{N}]+")))
    rows = rows.withColumn("class", F.when(F.col("n") <= SHORTEST, 0).otherwise(F.ceil(F.log2(F.col("n") / SHORTEST))).cast("int"))
    rows = rows.withColumn("bytes", F.octet_length("text"))
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    parts = max(-(-known["n"] // items), -(-(known["bytes"] or 0) // size))
    for p in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        by_class: dict[int, list] = {}
        for r in own.select("class", "item_id", "text").orderBy("class", "item_id", "text").collect():  # bounded, see above
            by_class.setdefault(r["class"], []).append((r["item_id"], r["text"]))
        if by_class:
            yield [Index(found, max([SHORTEST << c, *(len(words_of(t)) for _, t in found)])) for c, found in by_class.items()]


MATCHES = "array<struct<item_id:long,score:double,overlap:double,question_overlap:double,answer_overlap:double>>"


def match_column(indexes: list[Index], text: Column) -> Column:
    """The indexes of a pass are bounded (see passes) and go to the executors once, as a broadcast."""
    from pyspark.sql import SparkSession

    shared = SparkSession.getActiveSession().sparkContext.broadcast(indexes)
    names = ("item_id", "score", "overlap", "question_overlap", "answer_overlap")
    kind = pa.list_(pa.struct([(names[0], pa.int64()), *[(n, pa.float64()) for n in names[1:]]]))

    @F.arrow_udf(MATCHES)
    def match(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 1000):
            out += matches(shared.value, texts.slice(at, 1000).to_pylist())
        return pa.array([[dict(zip(names, m)) for m in own] for own in out], kind)

    return match(text)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap of every leak."""
    found = docs.select(F.col("doc_id"), F.lit(None).cast(MATCHES).alias("m")).limit(0)
    for indexes in passes(benchmark):
        found = found.unionByName(docs.select("doc_id", match_column(indexes, F.col("text")).alias("m")))
    return found.select("doc_id", F.explode("m").alias("m")).select("doc_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no item."""
    for indexes in passes(benchmark):
        docs = docs.where(F.size(match_column(indexes, F.col("text"))) == 0)
    return docs
