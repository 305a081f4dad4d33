"""Counts of people, things and categories, from images over panoramas to cells and years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import pivot_filled


def demographics(found: DataFrame, places: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """People by cell and year. found: img, pano, gender, age, a row for each person seen; places: pano, hex_id, year; labels:
    the (gender, age) that get a column, gender_age.

    Returns a row for each hex_id and year of places: the counts, pedestrian_count and panos_with_person, 0 where nobody was
    seen, and <gender>_ratio, the mean over panoramas with a person of the gender's share, null where nobody was seen.
    """
    names = [f"{g}_{a}" for g, a in labels]
    genders = list(dict.fromkeys(g for g, _ in labels))
    one = {n: F.count_if((F.col("gender") == g) & (F.col("age") == a)) for n, (g, a) in zip(names, labels, strict=True)}
    panos = found.groupBy("pano").agg(*(c.alias(f"n_{n}") for n, c in one.items()), F.count("*").alias("pedestrian_count"))
    ratios = {g: sum((F.col(f"n_{n}") for n, (own, _) in zip(names, labels, strict=True) if own == g), F.lit(0)) / F.col("pedestrian_count") for g in genders}
    seen = panos.withColumns({f"{g}_ratio": r for g, r in ratios.items()}).join(places, "pano")
    counts = [f"n_{n}" for n in names] + ["pedestrian_count"]
    cells = seen.groupBy("hex_id", "year").agg(*(F.sum(c).alias(c) for c in counts), F.countDistinct("pano").alias("panos_with_person"), *(F.avg(f"{g}_ratio").alias(f"{g}_ratio") for g in genders))
    out = places.select("hex_id", "year").distinct().join(cells, ["hex_id", "year"], "left")
    return out.select("hex_id", "year", *(F.coalesce(c, F.lit(0)).alias(c) for c in [*counts, "panos_with_person"]), *(f"{g}_ratio" for g in genders))


def categorise(df: DataFrame, code: str, categories: DataFrame, drop: tuple[str, ...] = ("other",)) -> DataFrame:
    """df with the category of each code, from categories (code, category); rows of categories to drop, or of none, go."""
    named = categories.select(F.col("code").alias(code), "category").where(~F.col("category").isin(*drop))
    return df.join(F.broadcast(named), code)  # one row for each code of a scheme


def collapse_columns(wide: DataFrame, keys: list[str], columns: list[str], names: dict[str, str]) -> DataFrame:
    """A wide table with its columns renamed by names; columns that get the same name are summed, nulls as 0. Columns without
    a name go."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        if c in names:
            groups.setdefault(names[c], []).append(c)
    return wide.select(*keys, *(sum((F.coalesce(F.col(f"`{c}`"), F.lit(0)) for c in own[1:]), F.coalesce(F.col(f"`{own[0]}`"), F.lit(0))).alias(n) for n, own in groups.items()))


def instance_counts(parts: DataFrame, places: DataFrame, cell: str, categories: list[str]) -> DataFrame:
    """Mean number of things by cell. parts: pano, category, is_thing; places: pano and cell. Things are counted by panorama
    and category; a panorama with things of other categories only counts as 0, one without things not at all."""
    counts = parts.where(F.col("pano").isNotNull() & F.col("is_thing")).groupBy("pano", "category").agg(F.count("*").alias("obs"))
    wide = pivot_filled(counts, ["pano"], "category", categories, F.sum("obs"))
    return wide.join(places.select("pano", cell).distinct(), "pano").groupBy(cell).agg(*(F.avg(f"`{c}`").alias(c) for c in categories), F.count("*").alias("n_panos"))


def distinct_instances(parts: DataFrame, keys: list[str], instance: str = "id") -> DataFrame:
    return parts.groupBy(*keys).agg(F.countDistinct(instance).alias("n_instances"))


def per_panorama(counts: DataFrame, objects: list[str]) -> DataFrame:
    """Objects for each panorama, over all years. counts: hex_id, year, object_name, n and panoid_n, which is of hex_id and
    year and so repeated in every object's row; object '0' stands for none."""
    panos = counts.select("hex_id", "year", "panoid_n").distinct().groupBy("hex_id").agg(F.sum("panoid_n").alias("panos"))
    sums = counts.where("object_name <> '0'").groupBy("hex_id", "object_name").agg(F.sum("n").alias("n"))
    rates = sums.join(panos, "hex_id").withColumn("n_per_pano", F.try_divide("n", "panos"))
    return pivot_filled(rates, ["hex_id"], "object_name", objects, F.sum("n_per_pano"), "obj_")


def pivot_pair(df: DataFrame, keys: list[str], first: str, second: str, values: list[tuple[str, str]], agg) -> DataFrame:
    """One column, first_second, for each pair of values, 0 where there is none."""
    named = df.withColumn("__pair", F.concat_ws("_", first, second))
    return pivot_filled(named, keys, "__pair", [f"{a}_{b}" for a, b in values], agg)


def co_located(df: DataFrame, cell: str, key: str, least: int = 2) -> DataFrame:
    """Rows of cells with at least so many different keys. Only the cells are grouped, not the rows."""
    dense = df.groupBy(cell).agg(F.countDistinct(key).alias("__n")).where(F.col("__n") >= least).select(cell)
    return df.join(dense, cell, "left_semi").select(df.columns)


def capped_copies(df: DataFrame, name: str, group: str, done: DataFrame, n: int) -> DataFrame:
    """At most n names of each group, in order, each name once, for its first group, without those done already."""
    from .cells import first_per_group

    once = df.groupBy(name).agg(F.min(group).alias(group))
    return first_per_group(once.join(done.select(name).distinct(), name, "left_anti"), [group], [name], n)
