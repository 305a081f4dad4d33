"""Communities, elbows and areas on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from lattica import sources
from lattica.operators import clusters, graphs, regions

RING = "array<struct<x:double,y:double>>"


def square(x, y, side=1.0):
    x, y = float(x), float(y)
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def test_modularity_of_two_triangles(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 1.0)], "a string, b string, weight double")
    parts = spark.createDataFrame([(n, n < "d") for n in "abcdef"], "node string, community boolean")
    assert graphs.modularity(edges, parts).first()[0] == pytest.approx(6 / 7 - 0.5)
    assert graphs.modularity(edges, parts.withColumn("community", F.lit(1))).first()[0] == pytest.approx(0.0)
    assert graphs.modularity(edges.limit(0), parts).first()[0] is None


def test_relation_shares(spark):
    edges = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 1.0), ("b", "a", 0.0)], "a string, b string, weight double")
    assert sorted(r.share for r in graphs.relation_shares(edges).where("a = 'a'").collect()) == [0.25, 0.75]
    assert graphs.relation_shares(edges).where("a = 'b'").first().share is None


def test_elbow_table(spark):
    points = spark.createDataFrame([([0.0, 0.0],), ([0.0, 2.0],), ([10.0, 0.0],), ([10.0, 2.0],), (None,)], "vec array<double>")
    two, four = clusters.elbow_table(points, [2, 4]).orderBy("k").collect()
    assert two.wss == pytest.approx(4) and two.distortion == pytest.approx(1)
    assert four.wss == pytest.approx(0) and four.distortion == pytest.approx(0)


def test_standard_scores(spark):
    scored = clusters.standard_scores(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"])
    assert sorted(tuple(r) for r in scored.collect()) == [(-1.0, None), (1.0, None)]


def test_areas_that_meet(spark):
    left = spark.createDataFrame([(1, square(0, 0)), (2, square(-20, -20, 60)), (3, square(100, 100)), (4, None), (5, [])], f"id int, ring {RING}")
    right = spark.createDataFrame([(10, square(0.5, 0.5)), (11, square(1, 0)), (12, square(3, 3)), (13, [(-5.0, 0.4), (5.0, 0.4), (5.0, 0.6)])], f"id int, ring {RING}")
    found = sorted(tuple(r) for r in regions.intersecting(left, right).collect())
    assert found == [(1, 10), (1, 11), (1, 13), (2, 10), (2, 11), (2, 12), (2, 13)]


def test_boxes_meet_as_intervals_do(spark):
    draw = random.Random(3)
    boxes = [(i, draw.uniform(-30, 30), draw.uniform(-30, 30), draw.uniform(1, 15), draw.uniform(1, 15)) for i in range(40)]
    df = spark.createDataFrame(boxes, "id int, x double, y double, w double, h double")
    rings = df.select("id", regions.box_ring(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("ring"))
    found = sorted(tuple(r) for r in regions.intersecting(rings.where("id < 20"), rings.where("id >= 20")).collect())
    want = [(a[0], b[0]) for a in boxes[:20] for b in boxes[20:] if a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[4] and b[2] <= a[2] + a[4]]
    assert found == want and want


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "pairs")
    spark.createDataFrame([("x", 1), ("y", 1)], "city string, v int").write.partitionBy("city").parquet(path)
    sources.replace_partitions(spark.createDataFrame([("y", 2), ("z", 3)], "city string, v int"), path, ["city"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("city", "v").collect()) == [("x", 1), ("y", 2), ("z", 3)]


def test_blocks_of_boxes_meet_as_rings_do(spark, monkeypatch):
    monkeypatch.setattr(regions, "BOXES", 3)
    i = F.col("id")
    box = regions.box_ring((i * 37 % 40).cast("double"), (i * 23 % 30).cast("double"), (i * 37 % 40 + 6).cast("double"), (i * 23 % 30 + 4).cast("double"))
    ring = F.when(i % 5 == 0, F.slice(box, 1, 3)).otherwise(box)  # triangles among the boxes
    a, b = (spark.range(n, n + 30).select("id", ring.alias("ring")) for n in (0, 100))
    pairs = a.select(i.alias("x"), F.col("ring").alias("p")).crossJoin(b.select(i.alias("y"), F.col("ring").alias("q")))
    want = pairs.where(regions.rings_meet(F.col("p"), F.col("q"))).select("x", "y")
    assert sorted(map(tuple, regions.intersecting(a, b).collect())) == sorted(map(tuple, want.collect()))
    boxes = [d.where(i % 5 != 0) for d in (a, b)]
    assert "MapInArrow" in regions.intersecting(*boxes)._jdf.queryExecution().toString()
