"""A training corpus from raw documents: five stages, each of which reads what the one before it wrote.

Stages are functions of (spark, docs, sf_dir); all but the last return the columns of documents. run(spark, sf_dir) applies
them to documents, with every stage's result written in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm.common import Workspace, read
from lattica.llm.decontaminate import remove_contaminated
from lattica.llm.mixing import apply_mix
from lattica.llm.neardup import deduplicate
from lattica.llm.quality import accept
from lattica.llm.token_files import token_digest


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranker rejects go."""
    return accept(docs, read(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and a digest of each document read back from them."""
    return token_digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]
#: Fitted weights and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document that the stages leave, in the token files' order.

    Null texts are empty; stages say what they do with rows without a doc_id, repeated ones and columns of any name. An
    empty table of documents, labels or benchmark items gives what is left without them.
    """
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
