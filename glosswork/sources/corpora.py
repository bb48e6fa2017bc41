"""Text, bicorpora, translation memories and models as tables; XML of rules and of units."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.align import align_texts, is_unit, xml_unit


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, seg_id, text): whole files, parted at NUL."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return rows.select("path", F.posexplode(F.split("value", "\u0000")).alias("seg_id", "text"))


def write_segments(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def only_utf8(rows: DataFrame, column: str = "content") -> DataFrame:
    """Binary rows that are UTF-8, with their text."""
    return rows.where(F.is_valid_utf8(F.col(column).cast("string"))).withColumn("text", F.col(column).cast("string"))


def read_bicorpus(spark: SparkSession, path: str) -> DataFrame:
    """(line, source, target) of tab-separated pairs; sides become arrays of words."""
    rows = spark.read.text(path).withColumn("parts", F.split("value", "\t")).where(F.size("parts") >= 2)
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return rows.select(words(F.col("parts")[0]).alias("source"), words(F.col("parts")[1]).alias("target"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(source, target) phrases of lines ``target @ source``."""
    rows = spark.read.text(path).withColumn("parts", F.split("value", r"\s+@\s+")).where(F.size("parts") == 2)
    return rows.select(F.split(F.trim(F.col("parts")[1]), r"\s+").alias("source"), F.split(F.trim(F.col("parts")[0]), r"\s+").alias("target"))


def read_sentence_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, words) of lines ``id<TAB>words``."""
    rows = spark.read.text(path).withColumn("parts", F.split("value", "\t", 2))
    return rows.select(F.col("parts")[0].alias("id"), F.split(F.trim(F.col("parts")[1]), r"\s+").alias("words"))


# translation memories


def unit_column(source: str = "source", target: str = "target", source_lang: str = "a", target_lang: str = "b") -> F.Column:
    """A ``<tu>`` element of two sentences; null where either side is no unit."""

    def element(a: str | None, b: str | None) -> str | None:
        if a is None or b is None or not (is_unit(a) and is_unit(b)):
            return None
        sides = "".join(f'<tuv xml:lang="{lang}"><seg>{xml_unit(x)}</seg></tuv>' for lang, x in ((source_lang, a), (target_lang, b)))
        return f"<tu>{sides}</tu>"

    @F.arrow_udf("string")
    def unit(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([element(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())

    return unit(source, target)


def build_memory(texts: DataFrame, source_lang: str = "a", target_lang: str = "b") -> DataFrame:
    """(pair_id, step, source, target, unit) of (pair_id, source, target): from two texts to ``<tu>`` elements.

    Sentences are split and aligned; of the aligned stretches those stay whose sides are both units.
    The rows are what write_tmx() takes.
    """
    return align_texts(texts).withColumn("unit", unit_column(source_lang=source_lang, target_lang=target_lang)).where("unit is not null")


def write_tmx(pairs: DataFrame, path: str, source_lang: str = "a", target_lang: str = "b") -> None:
    """Part files of ``<tu>`` lines; tmx_document() puts them between a head and a foot."""
    pairs.select(unit_column(source_lang=source_lang, target_lang=target_lang).alias("value")).where("value is not null").write.mode("overwrite").text(path)


def tmx_document(units: Iterator[str], source_lang: str) -> Iterator[str]:
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header srclang="{escape(source_lang)}" datatype="plaintext" segtype="sentence" adminlang="en" creationtool="glosswork" creationtoolversion="1" o-tmf="text"/><body>\n'
    for u in units:
        yield u + "\n"
    yield "</body></tmx>\n"


def read_tmx(text: str, source_lang: str, target_lang: str) -> list[tuple[str, str]]:
    out = []
    for tu in ET.fromstring(text).iter("tu"):
        sides = {v.get("{http://www.w3.org/XML/1998/namespace}lang") or v.get("lang"): "".join(v.find("seg").itertext()) for v in tu.iter("tuv")}
        if source_lang in sides and target_lang in sides:
            out.append((sides[source_lang], sides[target_lang]))
    return out


def apply_memory(segments: DataFrame, memory: DataFrame, column: str = "text") -> DataFrame:
    """Segments with ``translation`` from a memory (source, target), matched without case and blanks at the ends."""
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    best = memory.groupBy(key(F.col("source")).alias("_key")).agg(F.min("target").alias("translation"))
    return segments.withColumn("_key", key(F.col(column))).join(best, "_key", "left").drop("_key")


# models


def save_model(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """A model's tables as Parquet, one folder for each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def hmm_tables(spark: SparkSession, model: dict) -> dict[str, DataFrame]:
    return {
        "transitions": spark.createDataFrame([(i, j, p) for (i, j), p in model["a"].items()], "tag_i string, tag_j string, p double"),
        "emissions": spark.createDataFrame([(i, k, p) for (i, k), p in model["b"].items()], "tag string, class string, p double"),
    }


# rule files

#: Elements that each kind of rule file may hold below its root (fixed values).
ELEMENTS = {
    "transfer": {"section-def-cats", "section-def-attrs", "section-def-vars", "section-def-lists", "section-def-macros", "section-rules"},
    "interchunk": {"section-def-cats", "section-def-attrs", "section-def-vars", "section-def-lists", "section-def-macros", "section-rules"},
    "postchunk": {"section-def-cats", "section-def-attrs", "section-def-vars", "section-def-lists", "section-def-macros", "section-rules"},
    "tagger": {"tagset", "forbid", "enforce-rules", "preferences", "discard-on-ambiguity"},
    "capitalization": {"rules"},
    "modes": {"mode"},
    "dictionary": {"alphabet", "sdefs", "pardefs", "section"},
    "analysis-chars": {"char"},
}


def validate(xml: str, kind: str) -> list[str]:
    """What is wrong with a rule file; an empty list if nothing is."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        return [f"not well-formed: {e}"]
    if root.tag != kind:
        return [f"root is <{root.tag}>, not <{kind}>"]
    out = [f"unexpected <{c.tag}>" for c in root if c.tag not in ELEMENTS[kind]]
    if kind in ("transfer", "interchunk", "postchunk"):
        from ..operators.transfer import RuleError, RuleSet

        try:
            RuleSet(xml)
        except (RuleError, ValueError) as e:
            out.append(str(e))
    elif kind == "capitalization":
        from ..operators.caps import CapsError, CapsRules

        try:
            CapsRules(xml)
        except (CapsError, ValueError, TypeError) as e:
            out.append(str(e))
    elif kind == "tagger":
        from ..operators.tagspec import TagSpec

        try:
            TagSpec.parse(xml)
        except (ValueError, KeyError) as e:
            out.append(str(e))
    return out
