"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order that only the seed and the ids decide. A document's virtual
finish time is the words its source has sent with it, divided by the source's target, so at any virtual time all sources
have sent the same share of their targets. Documents are taken in the order of virtual finish times until the budget is
spent; a source whose target is beyond its size is queued again, as often as REPEATS.

Running totals are never taken over a source or over the whole table at once: rows are dealt to slices of the shuffled order
(of virtual time), slices are summed, and only the rows within a slice are ordered. A hot source has as many slices as its
rows need, and a source's target comes to its rows with the totals of its slices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, fresh

#: No document is taken more often, and no source's target is more times its size.
REPEATS = 3
#: The weights of the sources by code point, null last, repeating.
WEIGHTS = (1, 2, 3)
#: Copies of a row that one task makes.
COPIES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for a null."""
    # Removing each run's other letters would build a new text; counting runs by regexp_count doesn't.
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target for sized (source, size): the total of all sizes, shared by weight; what is beyond
    REPEATS times a source's size is shared again by weight among the others, until no target is above."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source, not for each document
    index = (F.row_number().over(order) - 1) % len(weights)
    ranked = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), index.cast("int") + 1)).withColumn("bound", F.col("source_size") * REPEATS)
    # By rising bound per weight, the sources before some place are held at their bounds, and the rest share what is left.
    by_bound = Window.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    after = by_bound.rowsBetween(0, Window.unboundedFollowing)
    ranked = ranked.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("bound").over(before), F.lit(0)))
    ranked = ranked.withColumn("level", F.col("left") / F.sum("w").over(after))
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("bound"), F.struct(F.col("bound") / F.col("w"), "level"))).over(Window.partitionBy())
    target = F.least(F.col("bound").cast("double"), level["level"] * F.col("w"))
    return ranked.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str, facts: DataFrame | None = None) -> DataFrame:
    """Adds the running total of value by keys in the order of bucket and then of order; and the columns of facts, a table
    with one row for each of the keys."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    renamed = sums.select(*(F.col(k).alias(f"__{k}") for k in [*keys, bucket]), "__before")

    def alike(names: list[str], a: str, b: str) -> Column:
        condition = F.lit(True)
        for k in names:
            condition = condition & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}"))
        return condition

    if facts is not None:
        renamed = renamed.join(facts.withColumnsRenamed({k: f"__f_{k}" for k in keys}), alike(keys, "__", "__f_")).drop(*(f"__f_{k}" for k in keys))
    joined = df.join(renamed, alike([*keys, bucket], "", "__")).drop(*(f"__{k}" for k in [*keys, bucket]))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("__before") + F.sum(value).over(within)).drop("__before")


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every row of docs (doc_id, text, source, more).

    A null text has no words; a null source is a source; documents without words and sources of them are taken with no
    words. Rows without a doc_id or with a repeated one are rows of their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = work.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")).withColumn("shuffle", key), "sized")
    targets = work.save(source_targets(sized, weights), "targets")
    rows, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    slices = max(1, math.isqrt(rows))  # as many slices as rows in a slice: neither is large
    # The first eight hex digits of the key are a number below 2^32, spread evenly.
    cut = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * slices / F.lit(1 << 32))
    queued = work.save(_running(sized.withColumn("slice", cut), ["source"], "slice", [F.col("shuffle"), F.col("tie")], "size", "sent", targets), "queued")
    rounds = queued.where("target > 0").select("*", F.explode(F.array(*map(F.lit, range(REPEATS)))).alias("round")).where("round * source_size < target")
    finish = (F.col("round") * F.col("source_size") + F.col("sent")) / F.col("target")
    timed = rounds.withColumn("finish", finish).withColumn("time", F.floor(finish * slices))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("shuffle"), F.col("tie")]
    taken = _running(timed, [], "time", order, "size", "spent").where(F.col("spent") <= budget).groupBy("doc_id", "source", "tie").agg(F.count("*").alias("times"))
    same = ["doc_id", "source", "tie", "size", "source_size", "target"]
    copies = queued.groupBy(*same).agg(F.count("*").alias("copies"))
    # Rows alike in id, source and text share what they take, the first ones one round more.
    counted = copies.withColumnsRenamed({"doc_id": "__d", "source": "__s", "tie": "__t"})
    on = F.col("__d").eqNullSafe(F.col("doc_id")) & F.col("__s").eqNullSafe(F.col("source")) & F.col("__t").eqNullSafe(F.col("tie"))
    counted = counted.join(taken, on, "left").select(F.col("__d").alias("doc_id"), F.col("__s").alias("source"), F.col("__t").alias("tie"), "size", "source_size", "target", "copies", F.coalesce("times", F.lit(0)).alias("times"))
    # Many copies of a row are made in two steps, so no task makes them all.
    some = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    first = counted.select("*", F.explode(some).alias("low")).repartition("doc_id", "low")
    each = first.select("*", F.explode(F.sequence("low", F.least(F.col("low") + COPIES, F.col("copies")) - 1)).alias("nth"))
    share = F.floor(F.col("times") / F.col("copies")) + F.when(F.col("nth") < F.col("times") % F.col("copies"), 1).otherwise(0)
    out = each.withColumn("times", share.cast("long"))
    saved = work.save(out.select("doc_id", "size", "source", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "times", "tie", "nth", "copies"), "result")
    work.drop("sized", "targets", "queued")
    return saved


def apply_mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs as the mix takes them: each row as often as it is taken, with all its columns. Rows alike in id, source and text
    are told apart by a number, which is counted slice by slice."""
    found = mix(docs, seed, weights).where("times > 0")
    key, times, number, nth, cut, *theirs = fresh(docs, "key", "times", "number", "nth", "cut", "their_id", "their_source", "their_key", "their_nth")
    same = ["doc_id", "source", key]

    def alike(names: list[str]) -> Column:
        condition = F.lit(True)
        for own, other in zip(names, theirs, strict=False):
            condition = condition & F.col(own).eqNullSafe(F.col(other))
        return condition

    rows = docs.withColumn(key, F.xxhash64("text"))
    single = found.where("copies = 1").select(*(F.col(c).alias(t) for c, t in zip(("doc_id", "source", "tie"), theirs, strict=False)), F.col("times").alias(times))
    out = rows.join(single, alike(same)).select(*docs.columns, times)
    several = found.where("copies > 1").select(*(F.col(c).alias(t) for c, t in zip(("doc_id", "source", "tie", "nth"), theirs, strict=True)), F.col("times").alias(times))
    if several.limit(1).count():
        work = Workspace(docs.sparkSession, "mix")
        alone = several.select(*theirs[:3]).distinct()
        repeated = work.save(rows.join(alone, alike(same), "left_semi").withColumn(number, F.monotonically_increasing_id()), "repeated")
        slices = max(1, math.isqrt(repeated.count()))
        counted = _running(repeated.select(*same, number, F.pmod(F.xxhash64(number), F.lit(slices)).alias(cut), F.lit(1).alias("__one")), same, cut, [F.col(number)], "__one", nth)
        placed = repeated.join(counted.select(number, (F.col(nth) - 1).alias(nth)), number)
        out = out.unionByName(placed.join(several, alike([*same, nth])).select(*docs.columns, times))
    return out.withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)
