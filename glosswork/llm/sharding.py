"""Sharding by balanced label propagation.

Documents of equal text are linked. All documents start spread evenly over the shards; in each
round the linked ones want to move to the shard that holds most of their group. How much may move
from one shard to another is solved from the (shards x shards) sums of these wishes, so that no
shard passes its quota, and is granted in the order of a hash by distributed prefix sums. A shard
that is full takes no further wishes, so a group larger than a shard fills one after another.
Unlinked documents then fill what is left of each quota exactly.

Law ``rows``: the counts of two shards are at most one apart. Documents of a group that are in the
same shard are interchangeable, so rounds work on cells (group, shard, count).

Defined results: a null text counts as the empty text (size 1) and is linked to it; a null id is hashed
as a name of its own; repeated rows are documents of their own; an empty table gives an
empty table. Only the named columns of the input are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_prefix, cut_lineage, hash_bucket, root_buckets

SHARDS = 16
ROUNDS = 8


def quotas(total: int, shards: int) -> list[int]:
    """Sizes of the ranges of positions 0..total-1 that floor(position * shards / total) makes."""
    edges = [-(-s * total // shards) for s in range(shards + 1)]
    return [b - a for a, b in zip(edges, edges[1:])]


def grant(wishes: dict[tuple[int, int], int], loads: list[int], limits: list[int]) -> dict[tuple[int, int], int]:
    """The most of each wish (from, to) such that no load passes its limit.

    Inflows of overfull shards are cut in proportion until none is; what a cut keeps at home may
    overfill that shard, so it is done again. Cuts only shrink grants and granting nothing is
    feasible, so that ends; then room that is left is given out, which only grows grants.
    """
    granted = dict(wishes)

    def room(to: int) -> int:
        moved = sum(v * ((t == to) - (f == to)) for (f, t), v in granted.items())
        return limits[to] - loads[to] - moved

    over = [to for to in range(len(limits)) if room(to) < 0]
    while over:
        for to in over:
            into = [k for k in granted if k[1] == to]
            inflow = sum(granted[k] for k in into)
            most = max(0, inflow + room(to))
            for k in into:
                granted[k] = granted[k] * most // max(1, inflow)
        over = [to for to in range(len(limits)) if room(to) < 0 and any(granted[k] for k in granted if k[1] == to)]
    # what the cuts rounded off, and what later cuts made room for, is granted after all
    again = True
    while again:
        again = False
        for (f, to), wish in sorted(wishes.items()):
            more = min(wish - granted[f, to], room(to))
            if more > 0:
                granted[f, to] += more
                again = True
    return granted


def propagate(cells: DataFrame, limits: list[int], buckets: int, rounds: int = ROUNDS) -> DataFrame:
    """Cells (gid, shard, n) after label propagation under the limits."""
    shards = len(limits)
    open_shards = set(range(shards))
    group = Window.partitionBy("gid")
    for _ in range(rounds):
        load_rows = cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a row for each shard
        loads = [0] * shards
        for r in load_rows:
            loads[r["shard"]] = int(r["n"])
        rank = F.struct("n", F.xxhash64("gid", "shard").alias("tie"), "shard")
        best = F.max(F.when(F.col("shard").isin(sorted(open_shards)), rank)).over(group)
        wishes = cells.withColumn("best", best).withColumn("to", F.when(F.col("best") > rank, F.col("best.shard")))
        wishes = cut_lineage(wishes.select("gid", "shard", "n", "to"))
        sums = wishes.where("to is not null").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # shards squared
        wanted = {(r["shard"], r["to"]): int(r["n"]) for r in sums}
        granted = grant(wanted, loads, limits)
        refused = {to for (f, to), v in wanted.items() if granted[f, to] < v}
        if not any(granted.values()) and not refused & open_shards:
            break
        pairs = F.create_map(*[x for (f, to), v in granted.items() for x in (F.lit(f * shards + to), F.lit(v))]) if granted else None
        if pairs is not None and any(granted.values()):
            movers = wishes.where("to is not null").withColumn("_bucket", hash_bucket(F.md5("gid"), buckets))
            movers = bucket_prefix(movers, ["shard", "to"], "_bucket", [F.md5("gid")], "n", "before")
            most = F.element_at(pairs, F.col("shard") * shards + F.col("to"))
            movers = movers.withColumn("k", F.greatest(F.lit(0), F.least(most - F.col("before"), F.col("n"))))
            parts = movers.select("gid", F.col("to").alias("shard"), F.col("k").alias("n"))
            parts = parts.unionByName(movers.select("gid", "shard", (F.col("n") - F.col("k")).alias("n"))).unionByName(wishes.where("to is null").select("gid", "shard", "n"))
            cells = cut_lineage(parts.where("n > 0").groupBy("gid", "shard").agg(F.sum("n").alias("n")))
        open_shards -= refused
        if not open_shards:
            break
    return cells


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.md5(data).alias("gid"),
        # the text too, so that the rows of one id, or without one, are spread
        F.md5(F.concat(F.lit("shard:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(data)).cast("binary")).alias("place"),
        F.lit(1).cast("long").alias("one"),
    )
    base = cut_lineage(base)
    total = base.count()
    limits, buckets = quotas(total, shards), root_buckets(total)
    base = base.withColumn("_bucket", hash_bucket(F.col("place"), buckets))
    order = ["place", "doc_id", "gid"]
    # where everyone starts, and everyone's number within the group
    rows = bucket_prefix(base, [], "_bucket", order, "one", "start")
    rows = rows.withColumn("shard", F.expr(f"start * {shards} div {max(1, total)}").cast("int")).drop("start")
    rows = cut_lineage(bucket_prefix(rows, ["gid"], "_bucket", order, "one", "number", "n_group"))
    linked, single = rows.where("n_group > 1"), rows.where("n_group = 1")
    cells = cut_lineage(linked.groupBy("gid", "shard").agg(F.count(F.lit(1)).alias("n")))
    cells = propagate(cells, limits, buckets, rounds)
    # a group's numbers are dealt to its cells in the order of shards; hot groups by their buckets
    upto = F.sum("n").over(Window.partitionBy("gid").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    layout = cells.withColumn("upto", upto).groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("layout"))
    spread = linked.select("gid", "_bucket").distinct().join(layout, "gid")
    placed = linked.drop("shard").join(spread, ["gid", "_bucket"])
    placed = placed.withColumn("shard", F.element_at(F.filter("layout", lambda x: x["upto"] > F.col("number")), 1)["shard"])
    # single documents fill what is left
    loads = {r["shard"]: int(r["n"]) for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    edges, filled = [], 0
    for s, limit in enumerate(limits):
        filled += limit - loads.get(s, 0)
        edges.append(filled)
    free = bucket_prefix(single.drop("shard"), [], "_bucket", order, "one", "at")
    free = free.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda x: x <= F.col("at"))))
    columns = ["doc_id", "size", "text_crc32", "gid", "place", "one", "_bucket", F.col("shard").cast("int").alias("shard")]
    final = bucket_prefix(placed.select(*columns).unionByName(free.select(*columns)), ["shard"], "_bucket", order, "one", "slot")
    return final.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
