"""The operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickbars.llm import automaton, bpe, chat, fim, language, licences, mih, pii, positional, runs, simhash, style_tree, warc
from tickbars.llm.tools import prepare

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.page_report(_table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(_table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.neighbours(_table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(_table(spark, sf_dir, "documents"))


def op7_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.repeat_report(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_report(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(_table(spark, sf_dir, "documents"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(_table(spark, sf_dir, "conversations"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_style_tree": op1_style_tree,
    "op2_pii": op2_pii,
    "op3_warc": op3_warc,
    "op4_simhash": op4_simhash,
    "op5_mih": op5_mih,
    "op6_language": op6_language,
    "op7_automaton": op7_automaton,
    "op8_decontamination": op8_decontamination,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_licences": op10_licences,
    "op11_fim": op11_fim,
    "op12_chat": op12_chat,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op7_automaton": automaton.oracle_sql(),
    "op8_decontamination": positional.oracle_sql(),
    "op10_licences": licences.oracle_sql(),
    "op11_fim": fim.oracle_sql(),
    "op12_chat": chat.oracle_sql(),
}
