"""The queries of these operators, and the SQL that DuckDB can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import audio, chat, filter_audit, langid, licenses, mixing, ngram_join, packing, pii, quality, repair, token_orc, viterbi
from brindle.llm.common import table
from brindle.llm.sql import SQL as SQL


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1_langid(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), ngram_join.Rule(4, 85, 100))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.op4_audio(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op6_chat(spark, table(spark, sf_dir, "conversations"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.op7_token_orc(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op9_pii(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10_quality(table(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op11_licenses(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.op12_repair(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op13_filter_audit(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.store(table(spark, sf_dir, "documents")))


def chat_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.best_branches(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_langid": op1_langid,
    "op2_ngram_join": op2_ngram_join,
    "op3_packing": op3_packing,
    "op4_audio": op4_audio,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_token_orc": op7_token_orc,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_licenses": op11_licenses,
    "op12_repair": op12_repair,
    "op13_filter_audit": op13_filter_audit,
    "chat_branches": chat_branches,
    "quality_ablations": quality_ablations,
}

