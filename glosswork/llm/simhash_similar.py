"""SimHash near-duplicates by similarity: the form of the operator that the pipeline's stage takes.

The rule is a Jaccard similarity of 0.8 or more of five-word shingles. 64 majority bits can't tell it
(similar texts differ by up to 11 of them), so fingerprints are wider here: 1,024 bits, each the
parity of the number of shingles that fall on it. Two sets differ in at least as many shingles as
their fingerprints in bits, so a radius that follows from the sizes of the sets rules out only pairs
that aren't similar. As in simhash.py, numpy compares tiles exactly by exclusive-or and bit counts and
skips strips whose population counts differ beyond the radius; what is left is verified by whole sets.

Parities of more shingles than bits tell nothing, so sets beyond PIECE are compared by pieces, ranges
of the shingles' hashes of PIECE / 4 to PIECE each: of the pieces of two similar sets at least one pair
reaches the similarity too, or all together wouldn't. The number of pieces follows from the size, and
a set that may be similar to one with more has pieces for both numbers. A set up to PIECE is one piece.

All pairs that reach the similarity are found. Two sets that reach it share a shingle among the first
n - ceil(0.8 n) + 1 of each, in any one order of all shingles (prefix filtering), so only sets with
such a shingle in common, a bucket, meet. The order puts common shingles last, by counts in a share
of the texts; it decides how many pairs are compared, never which are found.

The sets of a bucket are first compared with one of them, and the components of what is verified so
are taken. Once more, large buckets are compared with several of their sets, so that those at the edge
of a group, which aren't similar to all of it, meet some that they are similar to. A large group of
near copies is joined by that without its square of pairs. Tiles are then compared where a bucket
still has sets of different components.

Defined results: texts of fewer than five words are one shingle; texts without words (null, empty,
blanks) are copies of each other; equal sets are copies. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, release, small_side
from .simhash import SHIFTED, STRIP, components, shingle_hashes

WIDTH = 5
#: The similarity as a fraction, so that it is tested in whole numbers.
OVER, UNDER = 4, 5
#: Texts in which common shingles are counted: all up to SAMPLE, an eighth at least beyond.
SAMPLE, SHARE = 20_000, 8
#: Bits of a fingerprint, in words of 64.
BITS, BLOCKS = 1024, 16
#: Shingles of a piece, and how many times as many pieces the next larger sets have (as bits of a hash).
PIECE, FINER = 1024, 2
#: Rounds of comparing with single sets of each bucket; sets that are taken in turn within the first round.
ROUNDS, PIVOTS = 2, 4
#: Sets from which a bucket is large, and the number of its sets compared with all of it from the second round on.
LARGE, MANY = 64, 16
#: Most sets on a side of a compared tile pair.
TILE = 4096
#: Rows (two numbers each) up to which the texts to compare are named by a broadcast.
WANTED = 500_000
#: A shingle is common from this count in them; the most that are ordered by count.
COMMON, MOST_COMMON = 3, 200_000


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, WIDTH), dtype=np.uint64))


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which any set similar to it has among its own first."""
    wanted = len(own) + (-OVER * len(own)) // UNDER + 1 if len(own) else 0
    if not len(common) or not len(own):
        return own[:wanted]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return own[np.argsort(np.where(common[at] == own, counts[at], 0), kind="stable")[:wanted]]


def parities(own: np.ndarray) -> np.ndarray:
    """The fingerprint: for each of BITS bits, whether an odd number of the shingles fall on it."""
    odd = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def level(n: int) -> int:
    """The least number of steps after which pieces of n shingles have PIECE at most, on average."""
    steps = 0
    while n > PIECE << (FINER * steps):
        steps += 1
    return steps


def pieces(key: int, own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(key, shingles, tokens) of the pieces by which a set of more than one is compared.

    A similar set has a quarter more shingles at most, so pieces of its level are among these. Tokens
    are the prefix, told apart by level.
    """
    out = []
    for steps in sorted({level(len(own)), level(len(own) * UNDER // OVER)} - {0}):
        edges = np.arange(1, 1 << (FINER * steps), dtype=np.uint64) << np.uint64(64 - FINER * steps)
        for k, part in enumerate(np.split(own, np.searchsorted(own, edges))):
            if len(part):
                name = xxhash.xxh64_intdigest(np.array([key, steps, k], np.uint64).tobytes())
                out.append((name, part, prefix(part, common, counts) ^ np.uint64(xxhash.xxh64_intdigest(b"level %d" % steps))))
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def common_shingles(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles in order of their hashes, and their counts in the texts looked at."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    share = min(SHARE, max(1, docs.count() // SAMPLE))
    texts = docs.select(text_col).where(F.pmod(F.xxhash64(F.col(text_col), F.lit(5)), F.lit(share)) == 0)
    n = texts.mapInArrow(read, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = n.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = (np.asarray(found.column(i).to_numpy()) for i in range(2))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


def shingle_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, key (of the set), n (its size), odd (parities), first (its prefix), parts of every row.

    Where a set is compared by pieces only, ``first`` is empty; ``parts`` are they.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t) for t in part.column(2).to_pylist()]
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                firsts = [prefix(s, *common.value) if len(s) <= PIECE else s[:0] for s in sets]
                arrays = [part.column(0), part.column(1), pa.array(keys), pa.array([len(s) for s in sets], pa.int32()), _lists([parities(s) for s in sets]), _lists(firsts)]
                own = [pieces(int(k), s, *common.value) for k, s in zip(keys.view(np.uint64), sets)]
                ends, flat = np.cumsum([0, *map(len, own)]).astype(np.int32), [x for some in own for x in some]
                names = np.array([x[0] for x in flat], np.uint64).view(np.int64)
                columns = [pa.array(names), pa.array([len(x[1]) for x in flat], pa.int32()), _lists([parities(x[1]) for x in flat]), _lists([x[2] for x in flat])]
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["key", "n", "odd", "first"])))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_hash", "key", "n", "odd", "first", "parts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    piece = "key long, n int, odd array<long>, first array<long>"
    return rows.mapInArrow(read, f"doc_id long, text_hash long, {piece}, parts array<struct<{piece}>>")


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(t) for t in part.column(1).to_pylist()])], names=["key", "whole"])


def _near_sizes(x: str, y: str) -> Column:
    return UNDER * F.least(x, y) >= OVER * F.greatest(x, y)


def _ordered(x: str, y: str) -> list[Column]:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Owners of the pairs of pieces but those whose fingerprints differ too much: a similar pair differs in a ninth of its sizes at most."""
    left, right = (nodes.select(F.col("key").alias(c), F.col("owner").alias(f"own_{c}"), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "ab")
    differing = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = pairs.join(left, "a").join(right, "b").where((UNDER + OVER) * differing <= (UNDER - OVER) * (F.col("n_a") + F.col("n_b")))
    return near.select(*_ordered("own_a", "own_b")).distinct()


def _similar(pairs: DataFrame, names: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Those of the (checkpointed) pairs (a, b) of keys whose whole sets reach the similarity.

    A pair gets its two sets by itself, so sets are shuffled once and never kept.
    """
    sides = pairs.select(F.explode(F.array("a", "b")).alias("key"), "a", "b")
    wanted = small_side(cut_lineage(names.join(sides.select("key").distinct(), "key")), WANTED)
    texts = docs.select(F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash")).join(wanted, "text_hash")
    texts = texts.groupBy("key").agg(F.min("text").alias("text"))
    sets = texts.mapInArrow(_whole_sets, "key long, whole array<long>").join(small_side(sides, WANTED), "key")
    both = sets.groupBy("a", "b").agg(F.collect_list("whole").alias("w")).withColumn("both", F.size(F.array_intersect(F.col("w")[0], F.col("w")[1])))
    enough = UNDER * F.col("both") >= OVER * (F.size(F.col("w")[0]) + F.size(F.col("w")[1]) - F.col("both"))
    return cut_lineage(both.where(enough).select("a", "b"))


def _close(odd: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the rows x and y may be similar, by their fingerprints and sizes."""
    differing = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=-1, dtype=np.int32)
    return (UNDER + OVER) * differing <= (UNDER - OVER) * (n[x] + n[y])


def _tile(n: np.ndarray, root: np.ndarray, tile: np.ndarray, odd: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of one unit that may be similar and are in different components, strip by strip in order of size."""
    order = np.argsort(n, kind="stable")
    size, pop = n[order], np.bitwise_count(odd[order]).sum(axis=1, dtype=np.int32)
    two, found = len(np.unique(tile)) > 1, []
    for i in range(0, len(order), STRIP):
        a = order[i : i + STRIP]
        stop = int(np.searchsorted(OVER * size, UNDER * size[i + len(a) - 1], "right"))
        low, high = pop[i : i + STRIP].min(), pop[i : i + STRIP].max()
        for j in range(i, stop, STRIP):
            b = order[j : min(j + STRIP, stop)]
            radius = (UNDER - OVER) * (size[i + len(a) - 1] + size[j + len(b) - 1]) // (UNDER + OVER)
            if pop[j : j + len(b)].min() - high > radius or low - pop[j : j + len(b)].max() > radius:
                continue
            may = root[a][:, None] != root[b][None, :]
            if two:
                may &= tile[a][:, None] != tile[b][None, :]
            if i == j:
                may = np.triu(may, 1)
            x, y = np.nonzero(may)
            for at in range(0, len(x), 1 << 16):
                p, q = a[x[at : at + (1 << 16)]], b[y[at : at + (1 << 16)]]
                near = _close(odd, n, p, q)
                found.append((p[near], q[near]))
    return found


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that may be similar, from rows (unit, tile, key, n, root, odd) sorted by unit."""

    def compare(unit, tile, key, n, root, odd) -> pa.RecordBatch:
        found = []
        edges = np.flatnonzero(np.diff(unit)) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(unit)]])
        sizes = stops - starts
        small = np.flatnonzero(np.repeat(sizes <= SHIFTED, sizes))
        for d in range(1, int(sizes[sizes <= SHIFTED].max(initial=1))):
            x, y = small[:-d], small[d:]
            same = (unit[x] == unit[y]) & (root[x] != root[y])
            same &= UNDER * np.minimum(n[x], n[y]) >= OVER * np.maximum(n[x], n[y])
            x, y = x[same], y[same]
            for at in range(0, len(x), 1 << 16):
                p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
                near = _close(odd, n, p, q)
                found.append((p[near], q[near]))
        for s, e in zip(starts[sizes > SHIFTED], stops[sizes > SHIFTED]):
            found += [(p + s, q + s) for p, q in _tile(n[s:e], root[s:e], tile[s:e], odd[s:e])]
        x, y = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(key[x], key[y])), pa.array(np.minimum(key[x], key[y]))], names=["a", "b"])

    rest = None
    for batch in batches:
        own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        own.append(batch.column(5).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, BLOCKS))
        if rest is not None:
            own = [np.concatenate(x) for x in zip(rest, own)]
        if not len(own[0]):
            continue
        last = int(np.searchsorted(own[0], own[0][-1], "left"))  # the last unit may go on in the next batch
        if last:
            yield compare(*[x[:last] for x in own])
        rest = [x[last:] for x in own]
    if rest is not None:
        yield compare(*rest)


def _tiled_pairs(held: DataFrame, nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs of a bucket's sets that may be similar, of rows (token, key, n, root); hot buckets go tile pair by tile pair."""
    sizes = held.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")).where("tiles > 1")
    rows = held.join(small_side(cut_lineage(sizes)), "token", "left")
    rows = rows.withColumn("tile", F.coalesce(F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"), F.lit(-1)))
    rows = rows.withColumn("other", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))))
    unit = F.xxhash64("token", F.least("tile", "other"), F.greatest("tile", "other"))
    rows = rows.select(unit.alias("unit"), "tile", "key", "n", "root").join(nodes.select("key", "odd"), "key")
    rows = rows.select("unit", "tile", "key", "n", "root", "odd").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(_compared, "a long, b long").distinct()


def similar_roots(rows: DataFrame, docs: DataFrame, text_col: str = "text", tile: int = TILE) -> DataFrame:
    """(node, root) of the keys of ``rows`` that are similar to another, root the same in a component.

    ``rows`` are checkpointed shingle_rows(), numbered in a column ``at``.
    """
    # one row of each set; what is left out is told by its place, so that the sets themselves stay where they are
    least = rows.groupBy("key").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("all")).where("all > 1")
    again = cut_lineage(rows.select("key", "at").join(least, "key").where("at <> least").select("at"))
    whole = rows.join(small_side(again, WANTED), "at", "left_anti")
    names = cut_lineage(whole.select("key", "text_hash"))
    own = F.struct("key", "n", "odd", "first")
    parts = whole.select(F.col("key").alias("owner"), F.explode(F.concat(F.array(own), "parts")).alias("p")).select("owner", "p.*").where(F.size("first") > 0)
    nodes = cut_lineage(parts.select("owner", "key", "n", "odd"))
    tokens = parts.select("owner", "key", "n", F.explode("first").alias("token"))
    # buckets of the same pieces (by number and exclusive-or of their 64-bit keys) are one bucket
    many = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("all"), F.bit_xor("key").alias("sets")).where("all > 1")
    many = cut_lineage(many.groupBy("all", "sets").agg(F.min("token").alias("token")).select("token"))
    release(rows.sparkSession)
    shared = cut_lineage(tokens.join(small_side(many, WANTED), "token"))
    held, edges, tried = shared.withColumn("root", F.col("owner")).withColumn("all", F.lit(0)), None, None
    for turn in range(ROUNDS):
        place = F.xxhash64("key", F.pmod("token", F.lit(PIVOTS)) if turn == 0 else F.col("token"), F.lit(turn))
        turns = F.when(F.col("all") > LARGE, F.pmod(F.xxhash64("key", F.lit(turn)), F.lit(MANY))).otherwise(0)
        pivots = held.groupBy("token", turns.alias("turn")).agg(F.min(F.struct(place, "key", "n", "root")).alias("p"))
        pivots = pivots.select("token", F.col("p.key").alias("pivot"), F.col("p.n").alias("pivot_n"), F.col("p.root").alias("pivot_root"))
        pairs = held.join(pivots, "token").where("root <> pivot_root").where(_near_sizes("n", "pivot_n")).select(*_ordered("key", "pivot")).distinct()
        pairs = _possible(pairs, nodes)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs)
        release(rows.sparkSession)
        found = _similar(pairs, names, docs, text_col)
        edges, tried = (found, pairs) if edges is None else (edges.unionByName(found), tried.unionByName(pairs))
        release(rows.sparkSession)
        roots = small_side(components(edges))
        held = shared.join(roots, F.col("owner") == F.col("node"), "left").select("token", "owner", "key", "n", F.coalesce("root", "owner").alias("root"))
        apart = held.groupBy("token").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("all")).where("least <> most").select("token", "all")
        held = cut_lineage(held.join(apart, "token"))
        release(rows.sparkSession)
    pairs = _tiled_pairs(held.select("token", "key", "n", "root"), nodes, tile)
    for c in "ab":
        pairs = pairs.join(nodes.select(F.col("key").alias(c), F.col("owner").alias(f"own_{c}")), c)
    pairs = cut_lineage(pairs.select(*_ordered("own_a", "own_b")).distinct().join(tried, ["a", "b"], "left_anti"))
    release(rows.sparkSession)
    edges = edges.unionByName(_similar(pairs, names, docs, text_col))
    release(rows.sparkSession)
    return components(edges)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: one with its smallest id (null ids come last).

    Of several rows with that id and text, the one stays whose columns together hash least; the
    names of the columns don't matter.
    """
    rows = cut_lineage(shingle_rows(docs, id_col, text_col).withColumn("at", F.monotonically_increasing_id()))
    release(docs.sparkSession)
    roots = small_side(similar_roots(rows, docs, text_col))
    marks = rows.select("doc_id", "text_hash", "key").join(roots, F.col("key") == F.col("node"), "left")
    same = marks.groupBy(F.coalesce("root", "key").alias("root"), "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = same.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("kept"))
    kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    # only rows that go, or of which one of several equal ones stays, are looked up
    found = same.join(first, "root").withColumn("stays", kept).where("not stays or n > 1")
    found = small_side(cut_lineage(found.select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "stays")), WANTED)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    joined = packed.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("hash") == F.col("found_hash")), "left")
    rest = joined.where("stays is null").select("row.*")
    if found.where("stays").limit(1).count() == 0:
        return rest
    again = joined.where("stays").groupBy("id", "hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rest.unionByName(again.select("row.*"))
