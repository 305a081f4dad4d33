"""Joins of areas with areas: rings, arrays of (x, y) structs, that share a point."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.places import inside


def _edges(ring: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, following, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _side(p: Column, q: Column, r: Column) -> Column:
    """Positive if r is left of the line from p to q, 0 on it."""
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def _meet(e: Column, f: Column) -> Column:
    """Whether two segments share a point, their ends included."""
    overlap = F.lit(True)
    for c in "xy":
        low = F.greatest(F.least(e["p"][c], e["q"][c]), F.least(f["p"][c], f["q"][c]))
        high = F.least(F.greatest(e["p"][c], e["q"][c]), F.greatest(f["p"][c], f["q"][c]))
        overlap = overlap & (low <= high)
    apart = lambda a, b: F.signum(_side(a["p"], a["q"], b["p"])) * F.signum(_side(a["p"], a["q"], b["q"])) > 0
    return overlap & ~apart(e, f) & ~apart(f, e)


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two rings share a point: an edge meets an edge, or one holds the other's first corner."""
    crossing = F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: _meet(e, f)))
    first = lambda r: F.element_at(r, 1)
    return crossing | inside(first(a)["x"], first(a)["y"], b) | inside(first(b)["x"], first(b)["y"], a)


def _boxed(df: DataFrame, side: str, grid: float) -> DataFrame:
    """id, box and, of rings that are no box, ring, in every square of the grid that the box touches."""
    p = [F.get("ring", F.lit(i)) for i in range(4)]
    upright = (p[0]["x"] == p[3]["x"]) & (p[1]["x"] == p[2]["x"]) & (p[0]["y"] == p[1]["y"]) & (p[2]["y"] == p[3]["y"])
    is_box = F.coalesce((F.size("ring") == 4) & upright & (p[0]["x"] < p[1]["x"]) & (p[0]["y"] < p[2]["y"]), F.lit(False))  # as box_ring makes it
    end = lambda f, c, at: F.when(is_box, p[at][c]).otherwise(f(F.transform("ring", lambda q: q[c])))
    box = {f"{c}{k}": end(f, c, 2 * k) for c in "xy" for k, f in ((0, F.array_min), (1, F.array_max))}
    df = df.where(F.size("ring") > 0).select("id", F.when(~is_box, F.col("ring")).alias("ring"), *(v.alias(k) for k, v in box.items()))
    low = lambda c: F.floor(F.col(c) / grid)
    wide = df.withColumn("gx", F.explode(F.sequence(low("x0"), low("x1"))))
    wide = wide.withColumn("gy", F.explode(F.sequence(low("y0"), low("y1"))))
    return wide.select("gx", "gy", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "ring", *box)))


def intersecting(left: DataFrame, right: DataFrame, grid: float = 10.0) -> DataFrame:
    """left_id and right_id of rings (id, ring) that share a point. Both meet in the grid's squares that their boxes touch;
    a pair that meets in many squares is tested once, in the first of them. Boxes that overlap are enough where both rings
    are boxes, and must where one isn't. Empty and null rings meet nothing."""
    a, b = _boxed(left, "l", grid), _boxed(right, "r", grid)
    sizes = [x.groupBy("gx", "gy").agg(F.count("*").alias("n"), F.count(f"ring_{k}").alias("r")).agg(F.max("n"), F.sum("r")).first() for x, k in ((a, "l"), (b, "r"))]
    out = _boxes_meet(a.where("ring_l is null"), b.where("ring_r is null"), grid, *(s[0] or 0 for s in sizes))
    if sizes[0][1]:
        out = out.unionByName(_rings_meet(a.where("ring_l is not null"), b, grid))
    if sizes[1][1]:
        out = out.unionByName(_rings_meet(a.where("ring_l is null"), b.where("ring_r is not null"), grid))
    return out


def _rings_meet(a: DataFrame, b: DataFrame, grid: float) -> DataFrame:
    both = F.lit(True)
    for c in "xy":
        both = both & (F.col(f"{c}0_l") <= F.col(f"{c}1_r")) & (F.col(f"{c}0_r") <= F.col(f"{c}1_l")) & (F.col(f"g{c}") == F.floor(F.greatest(f"{c}0_l", f"{c}0_r") / grid))
    ring = lambda k: F.coalesce(f"ring_{k}", box_ring(*(F.col(f"{c}_{k}") for c in ("x0", "y0", "x1", "y1"))))
    return a.join(b, ["gx", "gy"]).where(both).where(rings_meet(ring("l"), ring("r"))).select(F.col("id_l").alias("left_id"), F.col("id_r").alias("right_id"))


BOXES = 1000  # of a block


def _boxes_meet(a: DataFrame, b: DataFrame, grid: float, most_l: int, most_r: int) -> DataFrame:
    """Boxes of a square are dealt to blocks, and every two blocks of it are compared at once."""
    kinds, ends = [dict(x.dtypes)[f"id_{k}"] for x, k in ((a, "l"), (b, "r"))], ("x0", "x1", "y0", "y1")

    def packed(df: DataFrame, k: str, most: int) -> DataFrame:
        block = F.pmod(F.xxhash64(f"id_{k}"), F.lit(max(1, math.ceil(most / BOXES)))).alias(f"block_{k}")
        m = df.groupBy("gx", "gy", block).agg(F.collect_list(F.struct(f"id_{k}", *(f"{c}_{k}" for c in ends))).alias("m"))
        return m.select("gx", "gy", f"block_{k}", *(F.col(f"m.{c}_{k}").alias(f"{c}_{k}") for c in ("id", *ends)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r, batch=batch: batch.column(c)[r].values
                p, q = ({c: get(f"{c}_{k}").to_numpy(zero_copy_only=False).astype(float) for c in ends} for k in "lr")
                good = np.ones((len(p["x0"]), len(q["x0"])), bool)
                for c in "xy":
                    good &= p[f"{c}0"][:, None] <= q[f"{c}1"][None, :]
                    good &= q[f"{c}0"][None, :] <= p[f"{c}1"][:, None]
                i, j = np.nonzero(good)
                first = np.ones(len(i), bool)
                for c in "xy":
                    first &= np.floor(np.maximum(p[f"{c}0"][i], q[f"{c}0"][j]) / grid) == batch.column(f"g{c}")[r].as_py()
                yield pa.RecordBatch.from_arrays([get(f"id_{k}").take(pa.array(x[first])) for k, x in (("l", i), ("r", j))], ["left_id", "right_id"])

    met = packed(a, "l", most_l).join(packed(b, "r", most_r), ["gx", "gy"]).repartition(96, "gx", "gy", "block_l", "block_r")
    return met.mapInArrow(run, f"left_id {kinds[0]}, right_id {kinds[1]}")


def box_ring(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """The ring of a box, such as a cell's."""
    return F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((left, bottom), (right, bottom), (right, top), (left, top))))
