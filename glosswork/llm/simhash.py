"""SimHash near-duplicates by tiled exact comparison.

Fingerprints that differ in at most ``radius`` bits agree in all but ``radius`` of any number of
blocks of bits, so only fingerprints meet that are equal in that many blocks: in one of radius + 1,
or, where there are so many fingerprints that 16 bits make large buckets, in 32 bits, three blocks of
six. Each such bucket is compared exactly, tile
against tile, with numpy's exclusive-or and bit counts; tile pairs whose population counts differ
beyond the radius can hold no link and are skipped. Buckets larger than a tile are dealt out tile
pair by tile pair, so that no task gets a whole hot bucket. A tile pair returns a spanning forest of
its links, not all pairs, which keeps every connection; Spark joins then find the components.

Defined results: a text without words (null, empty, blanks) has fingerprint zero, linked like any
other; texts of fewer than three words are one shingle; rows with equal ids or equal texts are
all returned; a component whose ids are all null has component_id null; an empty table gives an
empty table. Only the named columns of the input are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, small_side

RADIUS = 3
#: Fingerprints from which buckets have twice as many bits in common.
MANY = 1 << 25
SHINGLE = 3
SEED = 42
#: Most fingerprints on a side of a compared tile pair.
TILE = 2048
#: Rows of a tile compared at once, and buckets up to which rows are compared by shifting.
STRIP, SHIFTED = 256, 48

_LANES = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], dtype=np.uint64)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of words; ASCII letters are lower-cased, words split at ASCII blanks."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[width:])]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes: bits set in over half of a group (0 if empty).

    A lane of eight byte counters takes up to 255 hashes at a time before it is widened.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    sizes = counts[full]
    starts = np.cumsum(sizes) - sizes
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    octets = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    bits = np.zeros(len(full), dtype=np.uint64)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], at)
        totals = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * totals > sizes[:, None]).astype(np.uint64)
        bits |= (over << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * j)
    out[full] = bits
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = 0
        while done < batch.num_rows:  # hashes of a slice of rows at a time, whatever the batch holds
            counts, hashes, row = [], [], done
            while row < batch.num_rows and (not counts or len(hashes) < 400_000):
                own = shingle_hashes(batch.column(1)[row].as_py())
                counts.append(len(own))
                hashes += own
                row += 1
            found = majority_bits(np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0)[done:row], pa.array(found.view(np.int64))], names=["doc_id", "fp"])
            done = row


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b: each node to the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _cross(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links between two tiles, or within one (b is None), strip by strip in order of bit counts."""
    a = a[np.argsort(np.bitwise_count(a), kind="stable")]
    within = b is None
    b = a if within else b[np.argsort(np.bitwise_count(b), kind="stable")]
    pop_a, pop_b = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    found = []
    for i in range(0, len(a), STRIP):
        low, high = pop_a[i] - radius, pop_a[min(i + STRIP, len(a)) - 1] + radius
        start, stop = np.searchsorted(pop_b, low, "left"), np.searchsorted(pop_b, high, "right")
        start = max(start, i) if within else start
        if start < stop:
            x, y = np.nonzero(np.bitwise_count(a[i : i + STRIP, None] ^ b[None, start:stop]) <= radius)
            found.append((a[i + x], b[start + y]))
    return found


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; a unit is a bucket, or a pair of tiles of a hot one."""
    names = ["a", "b"]

    def compare(unit: np.ndarray, tile: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        edges = np.flatnonzero(np.diff(unit)) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(unit)]])
        sizes = stops - starts
        tiled = np.repeat(np.maximum.reduceat(tile, starts) >= 0, sizes)
        near = (np.repeat(sizes, sizes) <= SHIFTED) & ~tiled
        if near.any():
            u, f = unit[near], fp[near]
            for d in range(1, int(sizes[sizes <= SHIFTED].max())):
                hit = np.flatnonzero((u[d:] == u[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= radius))
                if len(hit):
                    found.append((f[hit], f[hit + d]))
        for s, e in zip(starts[~near[starts]], stops[~near[starts]]):
            own, tiles = fp[s:e], np.unique(tile[s:e])
            pairs = _cross(own, None, radius) if len(tiles) == 1 else _cross(own[tile[s:e] == tiles[0]], own[tile[s:e] == tiles[-1]], radius)
            if pairs:
                found.append(_forest(*map(np.concatenate, zip(*pairs))))
        return found

    def emit(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a, b = map(np.concatenate, zip(*found)) if found else (np.zeros(0, np.uint64),) * 2
        a, b = a.view(np.int64), b.view(np.int64)
        keep = a != b
        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[keep]), pa.array(np.minimum(a, b)[keep])], names=names)

    rest: list[np.ndarray] = []
    for batch in batches:
        unit, tile, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.view(np.uint64)
        if rest:
            unit, tile, fp = (np.concatenate(x) for x in zip(rest, (unit, tile, fp)))
        if not len(unit):
            continue
        last = int(np.searchsorted(unit, unit[-1], "left"))  # the last unit may go on in the next batch
        if last:
            yield from emit(compare(unit[:last], tile[:last], fp[:last]))
        rest = [unit[last:], tile[last:], fp[last:]]
    if rest:
        yield from emit(compare(*rest))


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, many: int = MANY) -> DataFrame:
    """Links (a > b) between the distinct fingerprints ``fp`` of ``nodes`` that span all links."""
    blocks = radius + 1 if nodes.count() < many else 2 * radius
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in own) for own in combinations(range(blocks), blocks - radius)]
    keys = [F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in masks]
    rows = nodes.select("fp", F.bit_count("fp").alias("pop"), F.posexplode(F.array(*keys)).alias("block", "value"))
    rows = rows.select("fp", "pop", F.xxhash64("block", "value").alias("bucket"))
    # tiles of the hot buckets, by bit count: at most 65 entries for each, and few such buckets
    hist = rows.groupBy("bucket", "pop").agg(F.count(F.lit(1)).alias("n"))
    hot = hist.groupBy("bucket").agg(F.sum("n").alias("all"), F.sort_array(F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))).alias("layout")).where(F.col("all") > tile)
    hot = small_side(cut_lineage(hot.select("bucket", "layout")))
    rows = rows.join(hot, "bucket", "left")
    # a tile's number: bit count and the part, by hash, of those with that count
    parts = F.element_at(F.filter("layout", lambda x: x["pop"] == F.col("pop")), 1)["tiles"]
    own = F.when(F.col("layout").isNotNull(), F.col("pop") * (1 << 20) + F.pmod(F.xxhash64(F.col("fp")), parts).cast("int")).otherwise(F.lit(-1))
    rows = rows.withColumn("tile", own)
    others = F.flatten(F.transform(F.filter("layout", lambda x: F.abs(x["pop"] - F.col("pop")) <= radius), lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda t: x["pop"] * (1 << 20) + t)))
    rows = rows.withColumn("other", F.explode(F.when(F.col("layout").isNull(), F.array(F.lit(-1))).otherwise(others)))
    unit = F.xxhash64("bucket", F.least("tile", "other"), F.greatest("tile", "other"))
    units = rows.select(unit.alias("unit"), "tile", "fp").repartition("unit").sortWithinPartitions("unit")
    return units.mapInArrow(lambda batches: _links(batches, radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); root: the smallest node of its component.

    Large-star and small-star steps by turns, until the edges stay as they are. Minima are
    aggregated before they are joined; each turn is checkpointed.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut_lineage(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        now = mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id: the smallest id that links reach."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(nodes.select("fp"), radius))
    member = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "fp").join(member.join(whole, "root").select("fp", "component_id"), "fp")
