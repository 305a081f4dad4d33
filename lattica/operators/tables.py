"""Panels, shares, ranks and merges of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_filled(df: DataFrame, keys: list[str], column: str, values: list, agg: Column, prefix: str = "") -> DataFrame:
    """One column for each value, 0 where there is none. Values are given, so no job looks for them."""
    out = df.groupBy(*keys).pivot(column, values).agg(agg)
    return out.select(*keys, *(F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{prefix}{v}") for v in values))


def panel_mean(df: DataFrame, image: str, keys: list[str], column: str, values: list, agg: Column) -> DataFrame:
    """Per image and value an aggregate, then its mean by keys: images without a value count as 0. Adds n_images."""
    wide = pivot_filled(df, [image, *keys], column, values, agg)
    return wide.groupBy(*keys).agg(*(F.avg(f"`{v}`").alias(str(v)) for v in values), F.countDistinct(image).alias("n_images"))


def completed_counts(found: DataFrame, panel: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Counts by keys and label, with a row ('0', 0) for every key of the panel that has none."""
    counts = found.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return panel.select(*keys).distinct().join(counts, keys, "left").select(*keys, F.coalesce(label, F.lit("0")).alias(label), F.coalesce("n", F.lit(0)).alias("n"))


def threshold_sweep(df: DataFrame, value: str, thresholds: list[float], out: str = "conf") -> DataFrame:
    """df once for every threshold that value reaches."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(value) >= t)
    return df.withColumn(out, F.explode(reached))


def balanced(df: DataFrame, key: str, period: str, n: int) -> DataFrame:
    """Rows of keys that have all n periods."""
    whole = df.groupBy(key).agg(F.countDistinct(period).alias("__n")).where(F.col("__n") == n).select(key)
    return df.join(whole, key, "left_semi").select(df.columns)


def log_change(panel: DataFrame, key: str, period: str, before, after, value: str) -> DataFrame:
    """ln(after + 1) - ln(before + 1) of each key that has both periods."""
    wide = panel.groupBy(key).agg(F.sum(F.when(F.col(period) == before, F.col(value))).alias("a"), F.sum(F.when(F.col(period) == after, F.col(value))).alias("b"))
    return wide.where("a is not null and b is not null").select(key, (F.log(F.col("b") + 1) - F.log(F.col("a") + 1)).alias("diff"))


def daily_spine(df: DataFrame, day: str, kind: str) -> DataFrame:
    """Counts by day and kind, with 0 for every day between the first and the last."""
    counts = df.groupBy(day, kind).agg(F.count("*").alias("n"))
    spine = counts.agg(F.min(day).alias("a"), F.max(day).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))
    every = spine.join(F.broadcast(counts.select(kind).distinct()))  # days by kinds
    return every.join(counts, [day, kind], "left").select(day, kind, F.coalesce("n", F.lit(0)).alias("n"))


def composition(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """Share of each label, and the key's entropy over ln k."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("n"))
    shares = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    diversity = -F.sum(F.col("share") * F.log("share")).over(Window.partitionBy(key)) / F.log(F.lit(float(k)))
    return shares.withColumn("diversity", diversity)


def confusion_by_cell(df: DataFrame, cell: str, truth: str, guess: str) -> DataFrame:
    """Per cell: top guesses (all equals) with their share, the share that is right, and the top wrong guess."""
    by = Window.partitionBy(cell)
    counts = df.groupBy(cell, truth, guess).agg(F.count("*").alias("n"))
    right = F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).over(by)
    counts = counts.withColumns({"total": F.sum("n").over(by), "right": right}).groupBy(cell, guess).agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.max("right").alias("right"), F.sum(F.when(F.col(truth) != F.col(guess), F.col("n")).otherwise(0)).alias("wrong"))
    ranked = counts.withColumns({"r": F.rank().over(by.orderBy(F.desc("n"))), "w": F.row_number().over(by.orderBy(F.desc("wrong"), guess))})
    false = ranked.where("w = 1 and wrong > 0").select(cell, F.col(guess).alias("top_false"), (F.col("wrong") / F.col("total")).alias("false_share"))
    top = ranked.where("r = 1").select(cell, F.col(guess).alias("top_guess"), (F.col("n") / F.col("total")).alias("top_share"), (F.col("right") / F.col("total")).alias("correct_share"))
    return top.join(false, cell, "left")


def average_rank(df: DataFrame, value: str, out: str = "rank", by: list[str] | None = None, slices: int = 200) -> DataFrame:
    """Falling rank of a number, equals at their mean, cut to a whole number; nulls last. Values are ranked within slices
    between approximate quantiles, after the rows of the slices before; no window goes over a whole table or group."""
    by = by or []
    values = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    edges = sorted(set(df.approxQuantile(value, [i / slices for i in range(1, slices)], 0.001)))  # slices numbers
    cut = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col(value))) if edges else F.lit(0)
    cut = F.coalesce(-cut, F.lit(1))  # the highest values first, nulls after all
    placed = values.withColumn("__cut", F.when(F.col(value).isNull(), 1).otherwise(cut))
    sums = placed.groupBy(*by, "__cut").agg(F.sum("__n").alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("__before", before).drop("__s").withColumnsRenamed({k: f"__by_{k}" for k in by}).withColumnRenamed("__cut", "__own_cut")
    on = F.col("__cut") == F.col("__own_cut")
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__by_{k}"))
    within = Window.partitionBy(*by, "__cut").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(sums) if not by else sums, on)  # as many rows as slices
    rank = F.col("__before") + F.coalesce(F.sum("__n").over(within), F.lit(0)) + (F.col("__n") + 1) / 2
    ranks = ranked.select(*(F.col(k).alias(f"__k_{k}") for k in by), F.col(value).alias("__v"), rank.cast("int").alias(out))
    same = F.col(value).eqNullSafe(F.col("__v"))
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(ranks, same).drop("__v", *(f"__k_{k}" for k in by))


def quantile_bins(df: DataFrame, value: str, n: int, out: str = "bin") -> DataFrame:
    """Bins from 0 between interpolated quantiles, closed on the right. The n - 1 edges are one small row."""
    edges = df.agg(F.percentile(value, F.array(*(F.lit(i / n) for i in range(1, n)))).alias("__edges"))
    return df.join(F.broadcast(edges)).withColumn(out, F.size(F.filter("__edges", lambda e: e < F.col(value)))).drop("__edges")


def min_max(df: DataFrame, value: str, by: str, out: str) -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumn(out, F.try_divide(F.col(value) - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """variable, n, mean, std, min, max, rounded to three places."""
    stats = df.agg(*(F.struct(F.count(c).alias("n"), F.round(F.avg(c), 3).alias("mean"), F.round(F.stddev_samp(c), 3).alias("std"), F.round(F.min(c).cast("double"), 3).alias("min"), F.round(F.max(c).cast("double"), 3).alias("max")).alias(c) for c in columns))
    return stats.unpivot([], columns, "variable", "s").select("variable", "s.*")


def fallback_join(left: DataFrame, sources: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Value of the first source that has the row's keys, and its name as source. sources: (name, table, keys)."""
    out = left
    for name, table, keys in sources:
        out = out.join(table.select(*keys, F.col(value).alias(f"__{name}")), keys, "left")
    names = [n for n, *_ in sources]
    source = F.coalesce(*(F.when(F.col(f"__{n}").isNotNull(), F.lit(n)) for n in names))
    return out.select(*left.columns, F.coalesce(*(F.col(f"__{n}") for n in names)).alias(value), source.alias("source"))


def first_contained(left: DataFrame, name: str, keys: DataFrame, key: str, limit: int = 10_000) -> DataFrame:
    """Adds the first key, by order, that is part of the name. The keys are a short list, which every task gets."""
    if keys.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} keys")
    book = keys.agg(F.array_sort(F.collect_set(key)).alias("__book"))
    return left.join(F.broadcast(book)).withColumn(key, F.get(F.filter("__book", lambda k: F.col(name).contains(k)), F.lit(0))).drop("__book")


def star_merge(base: DataFrame, key: str, tables: list[DataFrame]) -> DataFrame:
    """base with the columns of all tables by key, one row for each key: of several rows of a table the least one, column by
    column."""
    out = None
    for t in (base, *tables):
        rest = [c for c in t.columns if c != key]
        once = t.groupBy(key).agg(F.min(F.struct(*rest)).alias("__r")).select(key, *(F.col("__r")[c].alias(c) for c in rest))
        out = once if out is None else out.join(once, key, "left")
    return out


def shapley_r2(subsets: DataFrame, factors: list[str]) -> DataFrame:
    """factor and its part of R2, in percent, from subsets (subset: names sorted and comma-joined, r2): the mean gain over all
    orders in which factors can enter."""
    from math import factorial

    n = len(factors)
    rows = []
    for f in factors:
        others = [x for x in factors if x != f]
        for mask in range(1 << (n - 1)):
            own = [x for i, x in enumerate(others) if mask >> i & 1]
            rows.append((f, ",".join(sorted(own)), ",".join(sorted([*own, f])), factorial(len(own)) * factorial(n - 1 - len(own)) / factorial(n)))
    plan = subsets.sparkSession.createDataFrame(rows, "factor string, without string, with string, weight double")
    a, b = subsets.toDF("without", "r2_without"), subsets.toDF("with", "r2_with")
    gains = plan.join(a, "without").join(b, "with").groupBy("factor").agg(F.sum(F.col("weight") * (F.col("r2_with") - F.col("r2_without"))).alias("gain"))
    return gains.select("factor", (100 * F.col("gain") / F.sum("gain").over(Window.partitionBy())).alias("percent"))
