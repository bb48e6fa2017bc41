"""The queries of this subpackage, by the names that the driver calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mix import mix_plan

    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "mix_start")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .rans import read_files, write_files

    files, shared_table = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_files(files, shared_table)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated_pairs

    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_report

    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat_report(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(table(spark, sf_dir, "documents"))


def pages_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of real pages, by the operator of op10_media."""
    from .media import page_sequences

    return page_sequences(table(spark, sf_dir, "pages"))


QUERIES = {"op1_mix": op1_mix, "op2_secrets": op2_secrets, "op3_toxicity": op3_toxicity, "op4_rans": op4_rans, "op5_sharding": op5_sharding, "op6_quality": op6_quality, "op7_decontamination": op7_decontamination, "op8_chat": op8_chat, "op9_simhash": op9_simhash, "op10_media": op10_media, "pages_interleaved": pages_interleaved}
