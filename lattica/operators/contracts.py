"""What tables must hold before they are used: each check returns violation and n, a row for each kind of fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _counted(df: DataFrame, faults: dict[str, Column]) -> DataFrame:
    return df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in faults.items())).unpivot([], list(faults), "violation", "n")


def _repeats(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("n"))
    return n.select(F.lit(name).alias("violation"), "n")


def probability_faults(df: DataFrame, name: str, vec: str, size: int) -> DataFrame:
    """Rows of class probabilities: null names, wrong sizes, entries that are null or not finite, below 0, or sum to 0; and
    names that repeat."""
    v = F.col(vec)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    total = F.aggregate(v, F.lit(0.0).cast("double"), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))
    faults = {"null_name": F.col(name).isNull(), "size": v.isNull() | (F.size(v) != size), "not_finite": odd, "negative": F.exists(v, lambda x: x < 0), "no_mass": total <= 0}
    return _counted(df, faults).unionByName(_repeats(df.where(F.col(name).isNotNull()), [name], "duplicate_name"))


def known_rows(df: DataFrame, name: str, index: DataFrame) -> DataFrame:
    """Rows whose name the index has: those of older runs are left out before they are checked."""
    return df.join(index.select(name).distinct(), name, "left_semi")


def histogram_faults(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Sparse histograms (keys, mode_id, mode_image_count, sampled_image_count, mode_fraction): cells whose fractions don't sum
    to one within 1e-6, whose counts don't sum to their total, or that name several totals; and modes that repeat."""
    cells = hist.groupBy(*keys).agg(F.sum("mode_fraction").alias("f"), F.sum("mode_image_count").alias("c"), F.min("sampled_image_count").alias("low"), F.max("sampled_image_count").alias("high"))
    faults = {"fraction_sum": F.abs(F.col("f") - 1) > 1e-6, "count_sum": F.col("c") != F.col("high"), "several_totals": F.col("low") != F.col("high")}
    return _counted(cells, faults).unionByName(_repeats(hist, [*keys, "mode_id"], "duplicate_mode"))


def resolution_coverage(cells: DataFrame, least: int = 2) -> DataFrame:
    """res, n_cities and is_sparse: fewer cities than a comparison of cities needs."""
    return cells.groupBy("res").agg(F.countDistinct("city").alias("n_cities")).withColumn("is_sparse", F.col("n_cities") < least)


def refuse_sparse(cells: DataFrame, res: int, least: int = 2) -> DataFrame:
    """The cells of a resolution; an error if it has too few cities."""
    own = cells.where(F.col("res") == res)
    n = own.agg(F.countDistinct("city")).first()[0]
    if n < least:
        raise ValueError(f"resolution {res} has cells of {n} cities, {least} are needed")
    return own


def schema_faults(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    """What is wrong with the columns' names, order and types."""
    have = dict(df.dtypes)
    out = [f"missing {c}" for c in wanted if c not in have] + [f"unexpected {c}" for c in have if c not in wanted]
    out += [f"{c} is {have[c]}, not {t}" for c, t in wanted.items() if c in have and have[c] != t]
    return out or ([] if list(have) == list(wanted) else ["order of columns"])


def missing_pairs(edges: DataFrame, cities: DataFrame) -> DataFrame:
    """city_1, city_2 of all unordered pairs of cities that no edge has: a product of cities, not of cells."""
    names = cities.select("city").distinct()
    every = names.toDF("city_1").join(names.toDF("city_2"), F.col("city_1") < F.col("city_2"))
    have = edges.select(F.least("city_1", "city_2").alias("city_1"), F.greatest("city_1", "city_2").alias("city_2")).distinct()
    return every.join(have, ["city_1", "city_2"], "left_anti")
