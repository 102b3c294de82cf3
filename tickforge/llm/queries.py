"""The registered query of each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import (bpe_tree, chat, decontamination, fill_middle, language_model, merkle, mixing, near_dedup, quality, secret_scan, token_files,
                           toxicity, vector_search)
from tickforge.llm.common import table
from tickforge.llm.twins import chat_sql, fill_middle_sql, merkle_sql, mixing_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others train, search or scan in ways that SQL can't express; tests hold them against plain versions.
ORACLE: dict[str, str] = {"op2_chat": chat_sql(), "op10_mixing": mixing_sql(), "op11_merkle_manifest": merkle_sql(), "op13_fill_middle": fill_middle_sql()}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op2_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.read_back(chat.format_conversations(rows.union(chat.probe(spark))))


@query
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.report(table(spark, sf, "documents"))


@query
def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.token_counts(table(spark, sf, "documents"))


@query
def op6_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents"), size=2)


@query
def op7_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op8_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf, "embeddings"))


@query
def op9_language_model(spark: SparkSession, sf: str) -> DataFrame:
    return language_model.score_all(table(spark, sf, "documents"))


@query
def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf, "documents"))
    return rows.select("doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
                       F.round("_probability", 6).alias("probability"))


@query
def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.verified(table(spark, sf, "documents"))


@query
def op12_bpe_tree(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_tree.encoded(table(spark, sf, "documents"))


@query
def op13_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    return fill_middle.transformed(table(spark, sf, "documents"))
