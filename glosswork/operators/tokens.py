"""Token tables: words of documents with ambiguous readings, sentences, vocabularies.

The analyser is a rule on the endings of words, so that a corpus without a dictionary can be read;
a table of analyses (lemma, readings) can take its place by a join (see lookups.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings of lower-cased words and the tags that they allow, first match first.
ENDINGS = (("ing", ("n", "vblex")), ("ly", ("adv",)), ("ed", ("adj", "vblex")), ("st", ("adj", "adv", "n")), ("er", ("adj", "n")))
OTHER = ("n",)
SENTENCE_END = ".?!"
OPEN_CLASS = ("adj", "adv", "n", "vblex")
TAGS = ("adj", "adv", "n", "sent", "vblex")


def readings_col(surface: Column) -> Column:
    """The sorted tags that a word may have."""
    low = F.lower(surface)
    out = F.when(surface.isin(list(SENTENCE_END)), F.array(F.lit("sent")))
    for ending, tags in ENDINGS:
        out = out.when(F.endswith(low, F.lit(ending)), F.array(*map(F.lit, tags)))
    return out.otherwise(F.array(*map(F.lit, OTHER)))


def words(docs: DataFrame, pattern: str = r"(\p{L}+)", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, surface) of all matches; a null text has none."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(found).alias("pos", "surface"))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, surface, lemma, tags, class): words and sentence ends with their readings."""
    rows = words(docs, rf"(\p{{L}}+|[{SENTENCE_END}])", id_col, text_col)
    rows = rows.withColumn("lemma", F.lower("surface")).withColumn("tags", readings_col(F.col("surface")))
    return rows.withColumn("class", F.array_join("tags", "|"))


def lexical_units(tokens_: DataFrame) -> DataFrame:
    """The tokens with their stream text, ``^surface/lemma<tag>/lemma<tag>$``, as column ``lu``."""
    readings = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("/"), F.col("lemma"), F.lit("<"), t, F.lit(">"))), "")
    return tokens_.withColumn("lu", F.concat(F.lit("^"), F.col("surface"), readings, F.lit("$")))


def streams(tokens_: DataFrame) -> DataFrame:
    """(doc_id, stream): each document's lexical units in order, parted by single blanks."""
    rows = lexical_units(tokens_).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "lu"))).alias("u"))
    return rows.select("doc_id", F.array_join(F.transform("u", lambda x: x["lu"]), " ").alias("stream"))


def analysed(surface: Column) -> Column:
    """A word's stream text with all its readings."""
    low = F.lower(surface)

    def text(tags) -> Column:
        return F.concat(F.lit("^"), surface, *[part for t in tags for part in (F.lit("/"), low, F.lit(f"<{t}>"))], F.lit("$"))

    out = F.when(surface.isin(list(SENTENCE_END)), text(("sent",)))
    for ending, tags in ENDINGS:
        out = out.when(F.endswith(low, F.lit(ending)), text(tags))
    return out.otherwise(text(OTHER))


def text_streams(docs: DataFrame, unit=analysed, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stream) of documents with words, as streams() of their tokens, within the row: nothing is shuffled.

    ``unit`` makes the stream text of a word.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(rf"(\p{{L}}+|[{SENTENCE_END}])"), F.lit(1))
    rows = docs.select(F.col(id_col).alias("doc_id"), found.alias("found")).where(F.size("found") > 0)
    return rows.select("doc_id", F.array_join(F.transform("found", unit), " ").alias("stream"))


def sentences(tokens_: DataFrame) -> DataFrame:
    """The tokens with ``sent_id``: a sentence ends with a token whose only reading is sent."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return tokens_.withColumn("sent_id", F.coalesce(F.sum((F.col("class") == "sent").cast("long")).over(before), F.lit(0)).cast("long"))


def vocabulary(words_: DataFrame) -> DataFrame:
    return words_.groupBy(F.lower("surface").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def frequent_words(words_: DataFrame, n: int) -> DataFrame:
    """The n most frequent words; ties go to the smaller word."""
    return vocabulary(words_).orderBy(F.col("n").desc(), "word").limit(n)


def by_share(vocabulary_: DataFrame, ratio: float, low: bool = True) -> DataFrame:
    """Words kept while their running share of all occurrences is within the ratio.

    Frequencies are summed once for each count before they are accumulated, so the global order is
    over distinct counts, of which there are few; words of one count stand or fall together.
    """
    by_count = vocabulary_.groupBy("n").agg(F.sum("n").alias("mass"))
    order = Window.partitionBy().orderBy(F.col("n").asc() if low else F.col("n").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    kept = by_count.withColumn("share", F.sum("mass").over(order) / F.sum("mass").over(total)).where(F.col("share") <= ratio)
    return vocabulary_.join(kept.select("n"), "n", "left_semi")


def read_words(tokens_: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, pos, line): each word's surface with its tags in braces; at most ``limit`` a document."""
    rows = tokens_ if limit is None else tokens_.where(F.col("pos") < limit)
    return rows.select("doc_id", "pos", F.concat("surface", F.lit(" {"), F.array_join("tags", ", "), F.lit("}")).alias("line"))
