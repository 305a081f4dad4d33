"""Similarity edges: their order, membership of their ends, summaries and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with the smaller (city, hex) first; both ends are swapped together."""
    swap = (F.col("city1") > F.col("city2")) | ((F.col("city1") == F.col("city2")) & (F.col("hex_id1") > F.col("hex_id2")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return edges.withColumns({"hex_id1": pick("hex_id1", "hex_id2"), "hex_id2": pick("hex_id2", "hex_id1"), "city1": pick("city1", "city2"), "city2": pick("city2", "city1")})


def dedupe_max(edges: DataFrame) -> DataFrame:
    return canonical(edges).groupBy("hex_id1", "hex_id2", "city1", "city2").agg(F.max("similarity").alias("similarity"))


def summarise_pairs(edges: DataFrame) -> DataFrame:
    """city_1, city_2, avg, p50, p90, p95, max, pair_count over unordered pairs of cities; percentiles are interpolated."""
    ordered = edges.select(F.least("city1", "city2").alias("city_1"), F.greatest("city1", "city2").alias("city_2"), F.col("similarity").cast("double").alias("s"))
    out = ordered.groupBy("city_1", "city_2").agg(F.avg("s").alias("avg"), F.percentile("s", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95))).alias("p"), F.max("s").alias("max"), F.count("*").alias("pair_count"))
    return out.select("city_1", "city_2", "avg", *(F.get("p", F.lit(i)).alias(k) for i, k in enumerate(("p50", "p90", "p95"))), "max", "pair_count")


def zero_filled(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Every pair of cities of cells (hex_id, city): sum of similarities over all n1 * n2 pairs of cells, 0 without edges."""
    sums = dedupe_max(edges).groupBy("city1", "city2").agg(F.sum("similarity").alias("total"), F.max("similarity").alias("max"), F.count("*").alias("n"))
    return zero_filled_sums(sums, cells)


def zero_filled_sums(parts: DataFrame, cells: DataFrame) -> DataFrame:
    """zero_filled from parts (city1, city2, n, total, max) of the edges."""
    sizes = cells.groupBy("city").agg(F.countDistinct("hex_id").alias("n"))
    pairs = sizes.toDF("city_1", "n1").join(sizes.toDF("city_2", "n2"), F.col("city_1") < F.col("city_2"))  # cities, not cells
    out = pairs.join(added(parts), ["city_1", "city_2"], "left")
    return out.select("city_1", "city_2", F.coalesce("max", F.lit(0.0)).alias("max"), F.try_divide(F.coalesce("total", F.lit(0.0)), F.col("n1") * F.col("n2")).alias("avg"), F.coalesce("pair_count", F.lit(0)).alias("pair_count"))


def added(parts: DataFrame) -> DataFrame:
    """city_1, city_2, total, max and pair_count of parts (city1, city2, n, total, max), over unordered pairs of cities."""
    by = F.least("city1", "city2").alias("city_1"), F.greatest("city1", "city2").alias("city_2")
    return parts.groupBy(*by).agg(F.sum("total").alias("total"), F.max("max").alias("max"), F.sum("n").alias("pair_count"))


def summarise_shards(edges: DataFrame, shard: str) -> DataFrame:
    """city_1, city_2, avg, max, pair_count over shards as they are: an edge that a shard repeats counts once, at its largest
    similarity, one that several shards have counts in each; no largest similarity is below 0."""
    once = canonical(edges).groupBy(shard, "hex_id1", "hex_id2", "city1", "city2").agg(F.max("similarity").alias("s"))
    return summarise_shard_parts(once.groupBy("city1", "city2").agg(F.sum("s").alias("total"), F.max("s").alias("max"), F.count("*").alias("n")))


def summarise_shard_parts(parts: DataFrame) -> DataFrame:
    """summarise_shards from parts (city1, city2, n, total, max) of shards whose edges don't repeat within one."""
    return added(parts).select("city_1", "city_2", (F.col("total") / F.col("pair_count")).alias("avg"), F.greatest("max", F.lit(0.0)).alias("max"), "pair_count")


def swept_centre_summary(edges: DataFrame, cells: DataFrame, centres: DataFrame, kilometres: list[int]) -> DataFrame:
    """n_km, city_1, city_2, mean_similarity, center_dist: for each bound, of edges whose ends both lie nearer to their
    centres (cells: hex_id, h3_cbd_dist in metres), the mean similarity, where it is above 0, and the metres between the
    cities' centres (city, lat, lon). An edge is sent once to each bound that it meets."""
    d = cells.groupBy("hex_id").agg(F.min("h3_cbd_dist").alias("d"))
    out = edges
    for k in "12":
        out = out.join(d.toDF(f"hex_id{k}", f"d{k}"), f"hex_id{k}")
    far = F.greatest("d1", "d2")
    out = out.withColumn("n_km", F.explode(F.filter(F.array(*map(F.lit, kilometres)), lambda n: far < n * 1000)))
    parts = out.groupBy("n_km", "city1", "city2").agg(F.sum("similarity").alias("total"), F.count("similarity").alias("n"))
    return swept_parts(parts, centres)


def swept_bound(metres: Column, kilometres: list[int]) -> Column:
    """The least bound that a cell lies within, null if it lies within none."""
    return F.array_min(F.filter(F.array(*map(F.lit, kilometres)), lambda n: metres < n * 1000))


def swept_parts(parts: DataFrame, centres: DataFrame) -> DataFrame:
    """swept_centre_summary from parts (n_km, city1, city2, n, total) of the edges within each bound."""
    from ..functions.places import haversine_km

    out = parts.groupBy("n_km", F.least("city1", "city2").alias("city_1"), F.greatest("city1", "city2").alias("city_2")).agg((F.sum("total") / F.sum("n")).alias("mean_similarity")).where("mean_similarity > 0")
    for k in "12":
        out = out.join(centres.toDF(f"city_{k}", f"lat{k}", f"lon{k}"), f"city_{k}")
    return out.select("n_km", "city_1", "city_2", "mean_similarity", (haversine_km(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))) * 1000).alias("center_dist"))


def within_cells(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Edges with both ends among the cells."""
    ids = cells.select("hex_id").distinct()
    return edges.join(ids, edges["hex_id1"] == ids["hex_id"], "left_semi").join(ids, edges["hex_id2"] == ids["hex_id"], "left_semi")


def land_use_cells(land: DataFrame, primary: Column, pattern: Column) -> DataFrame:
    """Cells (hex_id, city) of a bucket: by the primary rule, and by the pattern only in cities where the rule finds none."""
    first = land.where(primary).select("hex_id", "city").distinct()
    rest = land.where(pattern).select("hex_id", "city").distinct().join(first.select("city").distinct(), "city", "left_anti")
    return first.unionByName(rest.select("hex_id", "city"))


def classify_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Adds validation_status and unresolved_reason to edges (hex_id1, hex_id2, city1, city2, similarity), by membership
    (hex_id, city): direct if each end is a cell of its city, reversed_fixed if of the other's, missing_city_h3 if an
    end is a cell of no city or a city is unknown, else unresolved."""
    own = membership.select("hex_id", "city").distinct()
    out = edges
    for name, h, c in (("d1", "hex_id1", "city1"), ("d2", "hex_id2", "city2"), ("r1", "hex_id1", "city2"), ("r2", "hex_id2", "city1")):
        out = out.join(own.select(F.col("hex_id").alias(h), F.col("city").alias(c), F.lit(True).alias(name)), [h, c], "left")
    for name, key, col in (("h1", "hex_id", "hex_id1"), ("h2", "hex_id", "hex_id2"), ("c1", "city", "city1"), ("c2", "city", "city2")):
        out = out.join(own.select(F.col(key).alias(col)).distinct().withColumn(name, F.lit(True)), col, "left")
    known = F.col("h1").isNotNull() & F.col("h2").isNotNull() & F.col("c1").isNotNull() & F.col("c2").isNotNull()
    status = (
        F.when(F.col("d1").isNotNull() & F.col("d2").isNotNull(), "direct")
        .when(F.col("r1").isNotNull() & F.col("r2").isNotNull(), "reversed_fixed")
        .when(~known, "missing_city_h3")
        .otherwise("unresolved")
    )
    reason = F.when(~known, F.when(F.col("c1").isNull() | F.col("c2").isNull(), "unknown city").otherwise("unknown cell"))
    out = out.withColumn("validation_status", status).withColumn("unresolved_reason", F.when(F.col("validation_status") == "missing_city_h3", reason).when(F.col("validation_status") == "unresolved", "cells belong to other cities"))
    return out.select(*edges.columns, "validation_status", "unresolved_reason")


def orient(classified: DataFrame) -> DataFrame:
    """Valid edges of different cities, turned round where they were reversed, canonical and unique."""
    turned = F.col("validation_status") == "reversed_fixed"
    good = classified.where(F.col("validation_status").isin("direct", "reversed_fixed"))
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    out = good.withColumns({"city1": pick("city1", "city2"), "city2": pick("city2", "city1")}).where("city1 <> city2")
    return dedupe_max(out).select("hex_id1", "hex_id2", "similarity", F.col("city1").alias("city_1"), F.col("city2").alias("city_2"))


def quarantine(classified: DataFrame) -> DataFrame:
    return classified.where(~F.col("validation_status").isin("direct", "reversed_fixed"))


def audit(classified: DataFrame) -> DataFrame:
    return classified.groupBy("validation_status").agg(F.count("*").alias("n"))


def validate_export(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row for each kind of fault of final edges (hex_id1, hex_id2, similarity, city_1, city_2), with how often it occurs."""
    s = F.col("similarity")
    own = membership.select("hex_id", "city").distinct()
    a = own.select(F.col("hex_id").alias("hex_id1"), F.col("city").alias("city_1"), F.lit(True).alias("m1"))
    b = own.select(F.col("hex_id").alias("hex_id2"), F.col("city").alias("city_2"), F.lit(True).alias("m2"))
    row = edges.join(a, ["hex_id1", "city_1"], "left").join(b, ["hex_id2", "city_2"], "left")
    faults = {
        "null": F.greatest(*(F.col(c).isNull().cast("int") for c in edges.columns)) == 1,
        "not_finite": F.isnan(s) | (F.abs(s) == float("inf")),
        "zero": s == 0,
        "out_of_range": F.abs(s) > 1.000001,
        "same_city": F.col("city_1") == F.col("city_2"),
        "membership": F.col("m1").isNull() | F.col("m2").isNull(),
    }
    one = row.agg(*(F.count_if(c).alias(k) for k, c in faults.items()))
    end = lambda k: F.struct(F.col(f"city_{k}").alias("city"), F.col(f"hex_id{k}").alias("hex"))
    keys = edges.select(F.least(end(1), end(2)).alias("a"), F.greatest(end(1), end(2)).alias("b"))
    repeats = keys.groupBy("a", "b").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n"))
    return one.unpivot([], list(faults), "violation", "n").unionByName(repeats.select(F.lit("duplicate").alias("violation"), "n"))


def label_leakage(rows: DataFrame, city1: str, city2: str) -> DataFrame:
    """Of a shard named by two cities: rows of one city only, rows whose labels are other cities', both by count."""
    named = F.array_sort(F.array(F.lit(city1), F.lit(city2)))
    own = F.array_sort(F.array("city1", "city2"))
    return rows.agg(F.count("*").alias("total"), F.count_if(F.col("city1") == F.col("city2")).alias("same_city"), F.count_if(F.col("city1") != F.col("city2")).alias("inter_city"), F.count_if(own != named).alias("unexpected"))


def diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison of two tables of a value by keys."""
    return old.select(*keys, F.col(value).alias("old")).join(new.select(*keys, F.col(value).alias("new")), keys, "full").withColumn("delta", F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))


def diff_in_rows(rows: DataFrame, keys: list[str], old: Column, new: Column) -> DataFrame:
    """diff of two tables made of the same rows, each unique by keys, so that nothing has to meet: a null stands for a row
    that a table lacks."""
    both = rows.select(*keys, old.alias("old"), new.alias("new")).where(F.col("old").isNotNull() | F.col("new").isNotNull())
    return both.withColumn("delta", F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))


def equal_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many pairs of rows share a key, from counts by key alone."""
    n = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    return n(left, "n_l").join(n(right, "n_r"), key).agg(F.count("*").alias("keys"), F.coalesce(F.sum(F.col("n_l") * F.col("n_r")), F.lit(0)).cast("long").alias("pairs"))


def duplicates(df: DataFrame, id_col: str, value: str) -> DataFrame:
    """rows, unique_ids, duplicate_rows, duplicate_ids, multi_value_ids, unique_values, duplicate_value_rows."""
    ids = df.groupBy(id_col).agg(F.count("*").alias("n"), F.countDistinct(value).alias("v"))
    a = ids.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_ids"), F.sum(F.col("n") - 1).alias("duplicate_rows"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), F.count_if(F.col("v") > 1).alias("multi_value_ids"))
    b = df.groupBy(value).agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_values"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_value_rows"))
    return a.join(F.broadcast(b))  # one row each


def completeness(expected: DataFrame, finished: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """missing and extra: how many ids one side lacks, and the first few."""
    e, f = expected.select(key).distinct(), finished.select(key).distinct()

    def side(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        only = a.join(b, key, "left_anti")
        first = only.orderBy(key).limit(examples).agg(F.sort_array(F.collect_list(key)).alias("examples"))
        return only.agg(F.count("*").alias("n")).join(F.broadcast(first)).select(F.lit(name).alias("side"), "n", F.concat_ws(",", F.transform("examples", lambda x: x.cast("string"))).alias("examples"))

    return side(e, f, "missing").unionByName(side(f, e, "extra"))


def coverage(expected: DataFrame, found: DataFrame, keys: list[str], valid: Column) -> DataFrame:
    """For each expected key: rows, valid rows, and ok, missing (no rows) or error (none valid)."""
    counts = found.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(valid).alias("valid_rows"))
    out = expected.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["rows", "valid_rows"])
    return out.withColumn("status", F.when(F.col("rows") == 0, "missing").when(F.col("valid_rows") == 0, "error").otherwise("ok"))
