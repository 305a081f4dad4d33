"""Bounded samples of labelled documents, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many labelled documents fit a model, those with the lowest hash of their id. Everything else in the
#: classifiers covers all documents.
TRAINING_ROWS = 12_000
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int = TRAINING_ROWS) -> DataFrame:
    """doc_id, text and label (0 or 1) of labelled documents that are not held out. Labels that are null, neither 0 nor 1, or
    contradict another one of their document are left out; of rows that share a doc_id, one has the label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other").drop("other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bound rows of 12 bytes
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("label").cast("int").alias("label"))
