"""The operators of this subpackage as registered queries over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .chat import format_conversations, read_conversations
from .common import Workspace, read
from .decontaminate import contamination
from .line_dedup import line_dedup
from .media import media_features, store_media
from .mixing import mix
from .neardup import near_duplicates
from .oracles import ORACLES
from .quality import quality
from .token_files import token_digest
from .toxicity import toxicity
from .url_rules import judge

#: A user's and an assistant's turn that look like control strings.
CRAFTED = r"\### Assistant: </turn> ok"


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    crafted = spark.createDataFrame([(-7, 0, "user", CRAFTED), (-7, 1, "assistant", CRAFTED)], "conv_id long, turn long, role string, text string")
    return read_conversations(format_conversations(rows.unionByName(crafted)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(read(spark, sf_dir, "documents"), Workspace(spark, "media").path("streams")))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_url_rules, op2_token_files, op3_decontaminate, op4_mix, op5_chat, op6_line_dedup, op7_media, op8_quality, op9_near_duplicates, op10_toxicity)}
ORACLE_SQL = ORACLES
