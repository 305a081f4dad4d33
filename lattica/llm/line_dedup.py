"""Line dedup over overlapping three-line windows, with DataFrame functions only.

Every three consecutive lines of a document are hashed (128 bits). A window that occurs again, anywhere later in the order
of documents and lines, is a repeat; the lines that repeats cover are removed, and the first occurrence stays. A document of
fewer lines has one window, of all its lines.

Every row has its own place in the order, a number that is written with the rows before it is used: by a task that is run
again, too, a row is paired with its own lines only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WINDOW = 3


def repeated_lines(docs: DataFrame, work: Workspace) -> DataFrame:
    """row and the line numbers (from 0) to remove, for the rows of docs (row, doc_id, tie, text) that have any."""
    lines = F.split("text", "\n", -1)
    # Each line is hashed once; a window is the hashes of its lines.
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))
    base = docs.where("text is not null").select("row", "doc_id", "tie", hashed.alias("h"))
    places = F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0)))
    part = lambda f, p: F.xxhash64(F.least(F.size("h"), F.lit(WINDOW)), *(F.get(F.col("h"), p + j)[f] for j in range(WINDOW)))
    windows = base.select("row", "doc_id", "tie", F.size("h").alias("n"), F.explode(F.transform(places, lambda p: F.struct(p.alias("at"), part("a", p).alias("a"), part("b", p).alias("b")))).alias("w")).select("row", "doc_id", "tie", "n", "w.*")
    windows = work.save(windows, "windows")
    # One row for each window of each task reaches the shuffle, however often the window occurs.
    order = F.struct("doc_id", "tie", "row", "at")
    first = windows.groupBy("a", "b").agg(F.min(order).alias("first"), F.count("*").alias("times")).where("times > 1").select("a", "b", F.col("first.row").alias("first_row"), F.col("first.at").alias("first_at"))
    later = windows.join(first, ["a", "b"]).where((F.col("row") != F.col("first_row")) | (F.col("at") != F.col("first_at")))
    covered = F.sequence(F.col("at"), F.least(F.col("at") + WINDOW, F.col("n")) - 1)
    return later.select("row", covered.alias("lines")).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("drop"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text for each row of docs (doc_id, text, more): text without the lines of repeats.

    A null text has no lines and stays null; an empty text is one empty line. Rows without a doc_id come first in the order;
    rows that share one follow in the order of their texts' hashes, and rows alike in both one after another, so only the
    first of them keeps its lines. An empty table gives no rows. A text's lines are in memory at once, as the text is.
    """
    work = Workspace(docs.sparkSession, "lines")
    texts = work.save(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie")), "rows")
    drops = work.save(repeated_lines(texts, work), "drops")
    work.drop("windows")
    lines = F.split("text", "\n", -1)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    # The same join at every size: left to itself, it broadcasts what a small table's lines make of drops.
    out = texts.join(drops.hint("merge"), "row", "left")
    return out.select("doc_id", n_lines.alias("n_lines"), F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("long").alias("n_removed"), kept.alias("text"))
