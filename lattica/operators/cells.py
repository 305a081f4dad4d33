"""From observations to cells: sampling, exclusion of training places, and vectors by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import cell, parent
from ..functions.vectors import norm


def assign_cells(df: DataFrame, resolutions: list[int], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Adds cell_<r>; the finest is computed and the others are its parents."""
    top = max(resolutions)
    out = df.withColumn(f"cell_{top}", cell(F.col(lat), F.col(lon), top))
    return out.withColumns({f"cell_{r}": parent(F.col(f"cell_{top}"), r) for r in resolutions if r != top})


def exclude_cells(obs: DataFrame, training: DataFrame, cell_col: str, id_col: str) -> DataFrame:
    """obs without every row of a cell that holds a training id: semi-join, distinct cells, anti-join. Rows without a cell stay."""
    held = obs.join(training.select(id_col).distinct(), id_col, "left_semi").select(cell_col).where(F.col(cell_col).isNotNull()).distinct()
    return obs.join(held, cell_col, "left_anti").select(obs.columns)


def first_per_group(df: DataFrame, groups: list[str], order: list[Column | str], n: int, total: int = 0) -> DataFrame:
    """The first n rows of each group in order, and of these the first total by groups and order."""
    out = df.withColumn("__r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
    return out.orderBy(*groups, *order).limit(total) if total else out


def hash_order(seed: int, *keys: str) -> Column:
    """A text that orders rows at random, alike on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def stratified_holdout(df: DataFrame, group: str, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds is_holdout: of n rows of a group, floor(n * fraction + 0.5), but one at least and n - 1 at most, by hash order."""
    by = Window.partitionBy(group)
    n = F.count("*").over(by)
    wanted = F.least(F.greatest(F.floor(n * F.lit(fraction) + 0.5), F.lit(1)), n - 1)
    rank = F.row_number().over(by.orderBy(hash_order(seed, group, key), key))
    return df.withColumn("is_holdout", rank <= wanted)


def aggregate_vectors(obs: DataFrame, resolutions: list[int], vec: str = "vec", l2: bool = True, extra: dict[str, Column] | None = None) -> DataFrame:
    """hex_id, res, img_count, vec (and extra aggregates) for every cell of every resolution in one scan: rows are sent to
    each resolution's cell, and each entry of the vectors is averaged where it stands. Null cells and vectors take no part."""
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("res"), F.col(f"cell_{r}").alias("hex_id")) for r in resolutions)))
    kept = [c for c in obs.columns if c not in ("res", "hex_id")]
    rows = obs.where(F.col(vec).isNotNull()).withColumn("__c", each).select(*kept, "__c.res", "__c.hex_id").where("hex_id is not null")
    counts = rows.groupBy("hex_id", "res").agg(F.count("*").alias("img_count"), *(c.alias(k) for k, c in (extra or {}).items()))
    entries = rows.select("hex_id", "res", F.posexplode(vec).alias("dim", "x")).groupBy("hex_id", "res", "dim").agg(F.avg("x").alias("x"))
    means = entries.groupBy("hex_id", "res").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
    out = counts.join(means, ["hex_id", "res"])
    if l2:
        length = F.greatest(norm(F.col("vec")), F.lit(1e-12))
        out = out.withColumn("__n", length).withColumn("vec", F.transform("vec", lambda x: x / F.col("__n"))).drop("__n")
    return out


def majority_vote(df: DataFrame, group: str, label: str) -> DataFrame:
    """The most frequent label of each group; of equals, the largest."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    best = counts.groupBy(group).agg(F.max(F.struct("n", label)).alias("m"))
    return best.select(group, F.col(f"m.{label}").alias(label), F.col("m.n").alias("votes"))


def best_mapping(df: DataFrame, source: str, target: str) -> DataFrame:
    """For each source label the target it meets most often; of equals, the smallest."""
    counts = df.groupBy(source, target).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.desc("n"), target))
    return counts.withColumn("__r", rank).where("__r = 1").drop("__r")
