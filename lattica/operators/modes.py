"""Codebooks: centroids, assignment, histograms by cell, and how good a codebook is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot
from . import many_modes

#: Centroids are a codebook: k rows, which every task gets.
MAX_CENTROIDS = 100_000
#: MLlib chooses first centroids among several times k rows on the driver, one by one: a number of steps that grows with k squared.
MLLIB_MODES = 512


def _fit(df: DataFrame, k: int, vec: str, seed: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1, and the number of rows nearest to each."""
    if k > MLLIB_MODES:
        return many_modes.fit(df, k, vec, seed, rounds)
    rows = many_modes.units(df, vec).select(array_to_vector("vec").alias("features")).persist()
    try:
        centres = np.array(KMeans(k=k, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(rows).clusterCenters())
    finally:
        rows.unpersist()
    length = np.linalg.norm(centres, axis=1)[:, None]
    centres = centres / np.where(length > 0, length, 1)
    return centres, many_modes.sizes(many_modes.units(df, vec), centres)


def fit_codebook(df: DataFrame, k: int, vec: str = "vec", seed: int = 0, rounds: int = 20) -> DataFrame:
    """mode_id and centroid (length 1) of spherical k-means."""
    centres, _ = _fit(df, k, vec, seed, rounds)
    book = {"mode_id": pa.array(range(len(centres)), pa.int32()), "centroid": pa.array(list(centres), pa.list_(pa.float64()))}
    return df.sparkSession.createDataFrame(pa.table(book))


def assign_modes(df: DataFrame, centroids: DataFrame, vec: str = "vec") -> DataFrame:
    """Adds mode_id and cohesion: the centroid with the largest product, the first of equals."""
    if centroids.limit(MAX_CENTROIDS + 1).count() > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    book = centroids.agg(F.sort_array(F.collect_list(F.struct("mode_id", "centroid"))).alias("book"))
    scored = df.join(F.broadcast(book)).withColumn("__s", F.transform("book", lambda c: F.struct(dot(F.col(vec), c["centroid"]).alias("s"), (-c["mode_id"]).alias("m"))))
    return scored.withColumn("__b", F.array_max("__s")).select(*df.columns, (-F.col("__b.m")).alias("mode_id"), F.col("__b.s").alias("cohesion"))


def mode_histogram(assigned: DataFrame, keys: list[str]) -> DataFrame:
    """mode_image_count, sampled_image_count and mode_fraction of each mode in each cell."""
    counts = assigned.groupBy(*keys, "mode_id").agg(F.count("*").alias("mode_image_count"))
    total = F.sum("mode_image_count").over(Window.partitionBy(*keys))
    return counts.withColumn("sampled_image_count", total).withColumn("mode_fraction", F.col("mode_image_count") / F.col("sampled_image_count"))


def dense_histogram(hist: DataFrame, keys: list[str], k: int) -> DataFrame:
    """One array of k fractions for each cell."""
    maps = hist.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("mode_id", "mode_fraction"))).alias("m"))
    return maps.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("vec"))


def scorecard(assigned: DataFrame, k: int) -> DataFrame:
    """mean and p05 cohesion, min and median mode share (empty modes count), number of empty modes."""
    spark = assigned.sparkSession
    total = assigned.agg(F.count("*").alias("n"), F.avg("cohesion").alias("mean_cohesion"), F.percentile("cohesion", F.lit(0.05)).alias("p05_cohesion"))
    counts = assigned.groupBy("mode_id").agg(F.count("*").alias("c"))
    every = spark.range(k).select(F.col("id").cast("int").alias("mode_id")).join(counts, "mode_id", "left").fillna(0, ["c"])
    shares = every.join(F.broadcast(total.select("n"))).select((F.col("c") / F.col("n")).alias("share"), "c")
    s = shares.agg(F.min("share").alias("min_share"), F.percentile("share", F.lit(0.5)).alias("median_share"), F.count_if(F.col("c") == 0).alias("empty_modes"))
    return total.join(F.broadcast(s)).drop("n")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings of the same rows, from their contingency counts."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("rb"))
    all_ = cells.agg(two("n").alias("rab"), F.sum("n").alias("total")).join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.try_divide(F.col("ra") * F.col("rb"), F.col("total") * (F.col("total") - 1) / 2)
    ari = F.coalesce(F.try_divide(F.col("rab") - expected, (F.col("ra") + F.col("rb")) / 2 - expected), F.lit(1.0))
    return all_.select(ari.alias("ari"))


def adjusted_rands(runs: DataFrame, run: str, key: str, label: str) -> DataFrame:
    """n_pairs and the median, mean, min, max and population deviation of the adjusted Rand index over all pairs of runs.
    Rows of a key meet once for each pair of runs, which are few."""
    a = runs.select(F.col(run).alias("ra"), key, F.col(label).alias("la"))
    b = runs.select(F.col(run).alias("rb"), key, F.col(label).alias("lb"))
    both, by = a.join(b, key).where("ra < rb"), ["ra", "rb"]
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = both.groupBy(*by, "la", "lb").agg(F.count("*").cast("double").alias("n"))
    rows = cells.groupBy(*by, "la").agg(F.sum("n").alias("n")).groupBy(*by).agg(two("n").alias("sa"))
    cols = cells.groupBy(*by, "lb").agg(F.sum("n").alias("n")).groupBy(*by).agg(two("n").alias("sb"))
    all_ = cells.groupBy(*by).agg(two("n").alias("s"), F.sum("n").alias("total")).join(rows, by).join(cols, by)
    expected = F.try_divide(F.col("sa") * F.col("sb"), F.col("total") * (F.col("total") - 1) / 2)
    ari = all_.select(F.coalesce(F.try_divide(F.col("s") - expected, (F.col("sa") + F.col("sb")) / 2 - expected), F.lit(1.0)).alias("ari"))
    return ari.agg(F.count("*").alias("n_pairs"), F.percentile("ari", F.lit(0.5)).alias("median"), F.avg("ari").alias("mean"), F.min("ari").alias("min"), F.max("ari").alias("max"), F.stddev_pop("ari").alias("std"))


def codebook_candidates(df: DataFrame, ks: list[int], vec: str = "vec", seed: int = 0, rounds: int = 20) -> DataFrame:
    """k, status and n_modes of a codebook for each k: ok, more modes than rows, or empty modes."""
    n = df.where(F.col(vec).isNotNull()).limit(max(ks) + 1).count()
    rows = []
    for k in ks:  # a model each
        if k > n or k < 2:
            rows.append((k, "invalid_k", 0))
            continue
        used = int((_fit(df, k, vec, seed, rounds)[1] > 0).sum())
        rows.append((k, "ok" if used == k else "empty_modes", used))
    return df.sparkSession.createDataFrame(rows, "k int, status string, n_modes int")


def select_k(scores: DataFrame, gain: float = 0.005, least_stability: float = 0.9, least_share: float = 0.001) -> DataFrame:
    """k and rule. Of the valid candidates (status ok, stable enough, no mode too small) by rising k, the first that gains less
    cohesion than gain over the one before it; if all gain more, the one with the largest stability times cohesion, the
    smaller of equals. An error if none is valid. scores: k, status, stability, min_mode_share, held_out_mean_cohesion."""
    valid = scores.where((F.col("status") == "ok") & (F.col("stability") >= least_stability) & (F.col("min_mode_share") >= least_share))
    order = Window.orderBy("k")  # a row for each candidate k
    gained = valid.withColumn("gain", F.col("held_out_mean_cohesion") - F.lag("held_out_mean_cohesion").over(order))
    best = gained.agg(F.min(F.when(F.col("gain") < gain, F.col("k"))).alias("elbow"), F.max(F.struct((F.col("stability") * F.col("held_out_mean_cohesion")).alias("s"), (-F.col("k")).alias("k"))).alias("best"))
    k = F.coalesce("elbow", -F.col("best.k"), F.raise_error(F.lit("no candidate is stable enough with modes large enough")).cast("int"))
    return best.select(k.alias("k"), F.when(F.col("elbow").isNotNull(), "smallest_valid_elbow").otherwise("max_stability_times_cohesion").alias("rule"))


def top_per_mode(assigned: DataFrame, n: int, key: str) -> DataFrame:
    """The n rows of each mode nearest to its centroid, and their rank; the smaller key of equals first."""
    rank = F.row_number().over(Window.partitionBy("mode_id").orderBy(F.desc("cohesion"), key))
    return assigned.withColumn("rank", rank).where(F.col("rank") <= n)
