"""The corpus pipeline: stages applied one after another to documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. What a stage decides takes effect: toxic documents go, one document of each group of
near copies stays, documents that hold a benchmark item go, sources are mixed to their weights
(epochs repeat rows), and what is left is put into shards.

Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns are treated as the
docstrings of the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glosswork.llm import decontam, mix, sharding, simhash_similar, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_similar.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mix_sources(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Near copies, language models and label propagation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
