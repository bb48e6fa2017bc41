"""Mixing sources to target weights.

Every row gets a hash-random key. Rows are range-sorted by it within their source, distributed
prefix sums of the word counts give each row its place, and each source is cut exactly where its
budget ends; a source whose budget exceeds its size is repeated in whole epochs first.

Defined results: a null text has size 0; rows of a null source are a source of their own, ordered
last; rows of equal id (a null id counts as one id) and source share one key, and where the cut
falls among them each gets its share, rounded down, so that results never depend on the order of
equal rows; an empty table gives an empty table. Other columns pass through, whatever their names,
or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, bucket_prefix, cut_lineage, hash_bucket, root_buckets, small_side

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets of the sources, from one row (source, source_size, rows) for each.

    Water-filling: all sources rise with their weights to one level, those stopped at ``most``
    times their size leave the rest to the others. One row a source is all that a task sees.
    """
    everything = Window.partitionBy()
    by_source = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_source).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": weight, "_cap": F.col("source_size") * F.lit(float(most))})
    ranked = ranked.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    rising = Window.partitionBy().orderBy("_ratio", "rank")
    capped = F.coalesce(F.sum("_cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    ranked = ranked.withColumn("_level", (budget - capped) / open_weight)
    ranked = ranked.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "rank", "_level"))).over(everything)["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("weight")))
    whole = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return (
        ranked.withColumn("target", target)
        .withColumn("epochs", epochs)
        .withColumn("_rest", whole - F.col("epochs") * F.col("source_size"))
        .select("source", "rank", "rows", "source_size", "target", "epochs", "_rest")
    )


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How much of each row the mix takes.

    Returns doc_id, source, size, source_size, target, mix_key, mix_start (words before the row's
    key within its source), unit_size (words of all rows with the key), epochs, taken.
    """
    base = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), mix_key(F.col(id_col), seed).alias("mix_key")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    targets = cut_lineage(source_targets(sizes, weights, share, most))
    known = targets.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).first()
    side = F.broadcast(targets) if known["n"] <= BROADCAST_ROWS else targets
    side = side.withColumnRenamed("source", "_source")
    rows = base.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_bucket", hash_bucket(F.col("mix_key"), root_buckets(known["most"] or 1)))
    place = ["rank", "_bucket", "mix_key"]
    units = rows.groupBy(*place).agg(F.sum("size").alias("unit_size"))
    rows = rows.join(bucket_prefix(units, ["rank"], "_bucket", ["mix_key"], "unit_size", "mix_start"), place)
    part = F.greatest(F.lit(0), F.least(F.col("_rest") - F.col("mix_start"), F.col("unit_size")))
    # alone with its key, a row takes the whole part; else its share, in exact integers
    share_of = F.when(F.col("size") == F.col("unit_size"), part).otherwise(F.expr("CAST(CAST(_part AS DECIMAL(18,0)) * CAST(size AS DECIMAL(18,0)) AS DECIMAL(38,0)) div greatest(unit_size, 1L)"))
    rows = rows.withColumn("_part", part).withColumn("taken", (F.col("epochs") * F.col("size") + share_of).cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "mix_key", "mix_start", "unit_size", "epochs", "taken")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = None) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``.

    A row comes once for every epoch. Where its source's cut goes through it, its last copy has
    only the first words, joined by single spaces (``length_col`` is set to its new length). Only
    one row for each source, the place of its cut, is joined to the texts, which aren't shuffled.
    """
    plan = mix_plan(docs, weights, share, most, seed, id_col, text_col, source_col)
    rest = F.floor("target") - F.col("epochs") * F.col("source_size")
    at = F.struct("mix_start", "mix_key", "unit_size", rest.alias("rest"))
    cuts = plan.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when((F.col("mix_start") <= rest) & (F.col("unit_size") > 0), at)).alias("cut"))
    cuts = small_side(cut_lineage(cuts.withColumnRenamed("source", "cut_source")))
    # the columns of docs are packed, so that their names don't matter
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), mix_key(F.col(id_col), seed).alias("key"))
    row = F.col("row")
    rows = packed.join(cuts, row.getField(source_col).eqNullSafe(F.col("cut_source")))
    # the key may differ between rows of one start only where units are empty, and those are left out
    at_cut = F.col("key") == F.col("cut.mix_key")
    words = F.regexp_extract_all(row.getField(text_col), F.lit(WORD), F.lit(0))
    rows = rows.withColumn("room", F.greatest(F.lit(0), F.least(F.col("cut.rest") - F.col("cut.mix_start"), F.col("cut.unit_size"))))
    rows = rows.withColumn("words", F.when(at_cut, F.coalesce(words, F.array().cast("array<string>"))))
    part = F.expr("CAST(CAST(room AS DECIMAL(18,0)) * CAST(size(words) AS DECIMAL(18,0)) AS DECIMAL(38,0)) div greatest(cut.unit_size, 1L)")
    rows = rows.withColumn("kept", F.when(at_cut, part).cast("int"))
    last = F.when(at_cut, (F.col("kept") > 0).cast("int")).when(F.col("key") < F.col("cut.mix_key"), F.lit(1)).otherwise(F.lit(0))
    copies = F.col("epochs") + F.coalesce(last, F.lit(0))
    rows = rows.withColumn("copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))))
    cut_here = at_cut & (F.col("copy") > F.col("epochs")) & (F.col("kept") < F.size("words"))
    text = row.getField(text_col)
    columns = {text_col: F.when(cut_here, F.array_join(F.slice("words", 1, F.greatest(F.col("kept"), F.lit(1))), " ")).otherwise(text)}
    if length_col:
        columns[length_col] = F.when(cut_here, F.length(columns[text_col])).otherwise(row.getField(length_col))
    return rows.select(*[columns.get(c, row.getField(c)).alias(c) for c in docs.columns])
