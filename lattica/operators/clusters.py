"""Tables for choosing the number of clusters."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles


def elbow_table(df: DataFrame, ks: list[int], vec: str = "vec", seed: int = 0, rounds: int = 20) -> DataFrame:
    """k, wss (sum of squared distances to the nearest centre) and distortion (mean distance) of k-means for each k, 2 or more.

    Rows without a vector are left out. The centres, k rows, travel with the plan; the rows stay where they are.
    """
    rows = df.where(F.col(vec).isNotNull()).select(as_doubles(F.col(vec)).alias("v"), array_to_vector(as_doubles(F.col(vec))).alias("features")).persist()
    out = []
    try:
        for k in ks:
            model = KMeans(k=k, seed=seed, maxIter=rounds).fit(rows.select("features"))
            book = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
            squares = F.transform(book, lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
            nearest = rows.select(F.array_min(squares).alias("d2"))
            r = nearest.agg(F.sum("d2").alias("wss"), F.avg(F.sqrt("d2")).alias("distortion")).first()
            out.append((k, r.wss, r.distortion))
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, wss double, distortion double")


def standard_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns less their mean over their population deviation; a column that never varies gives null."""
    sums = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scored = {c: F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in columns}
    return df.join(F.broadcast(sums)).withColumns(scored).select(*df.columns)
