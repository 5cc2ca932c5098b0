"""The operators as queries over the driver tables, with production parameters.

Each callable takes (spark, sf_dir) and covers its whole table; the contract
columns are derived from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import (
    bagminhash, bitsliced, byte_bpe, chat, decontam, extendible, langid, linededup, merkle, nbsvm, periodic,
    tokenfile, toxicity,
)
from cohortlens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Vocabulary files are installed beside the library on every executor.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op2_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.digest(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(table(spark, sf_dir, "documents"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_file": op1_token_file,
    "op2_bitsliced": op2_bitsliced,
    "op3_toxicity": op3_toxicity,
    "op4_nbsvm": op4_nbsvm,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_bagminhash": op6_bagminhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_langid": op8_langid,
    "op9_chat": op9_chat,
    "op10_line_dedup": op10_line_dedup,
    "op11_merkle": op11_merkle,
    "op12_periodic": op12_periodic,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_bitsliced": bitsliced.ORACLE,
    "op6_bagminhash": bagminhash.ORACLE,
    "op7_decontaminate": decontam.ORACLE,
    "op9_chat": chat.ORACLE,
    "op10_line_dedup": linededup.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op13_exact_dedup": extendible.ORACLE,
}
