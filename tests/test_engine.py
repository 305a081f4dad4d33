"""Small literal fixtures with known results."""

import json
import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica import sources, streaming
from lattica.functions import names, places
from lattica.functions import vectors as V
from lattica.operators import cells, contracts, edges, many_modes, modes, pairs, panels, spatial, tables
from lattica.plans import observations, similarity


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.fixture
def vectors(spark):
    return spark.createDataFrame([("a1", "Alpha", [1.0, 0.0]), ("a2", "Alpha", [0.0, 1.0]), ("b1", "Beta", [1.0, 0.0]), ("b2", "Beta", [1.0, 1.0])], "hex_id string, city string, vec array<double>")


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_cosine_blocks_are_exact(vectors, block):
    found = rows(pairs.cosine_pairs(vectors, block_rows=block).select(F.least("hex_id1", "hex_id2"), F.greatest("hex_id1", "hex_id2"), F.round("similarity", 6)))
    assert found == [("a1", "b1", 1.0), ("a1", "b2", 0.707107), ("a2", "b2", 0.707107)]
    plain = rows(pairs.cosine_pairs_sql(vectors).select("hex_id1", "hex_id2", F.round("similarity", 6)))
    assert plain == found


def test_keep_all_keeps_zero_and_negative(spark):
    v = spark.createDataFrame([("a", "A", [1.0, 0.0]), ("b", "B", [-1.0, 0.0]), ("c", "B", [0.0, 1.0])], "hex_id string, city string, vec array<double>")
    assert len(rows(pairs.cosine_pairs(v, -1.0, keep_all=True))) == 2
    assert len(rows(pairs.cosine_pairs(v, -1.0))) == 1


def test_border_cells_belong_to_the_first_city(spark):
    v = spark.createDataFrame([("x", "A", [1.0]), ("x", "B", [1.0]), ("y", "B", [1.0])], "hex_id string, city string, vec array<double>")
    assert rows(pairs.cosine_pairs(v).select("city1", "city2")) in ([("A", "B")], [("B", "A")])


def test_topk_and_threshold(spark):
    paris = spark.createDataFrame([("p", "Paris", [1.0, 0.0])], "id string, city string, vec array<double>")
    london = spark.createDataFrame([("l1", "London", [1.0, 0.0]), ("l2", "London", [0.0, 1.0])], "id string, city string, vec array<double>")
    assert rows(pairs.topk_pairs(paris, london, 2, 0.9), "id2", "similarity") == [("l1", 1.0)]


def test_topk_passes_over_the_own_city(spark):
    c = spark.createDataFrame([("p1", "Paris", [1.0, 0.0]), ("p2", "Paris", [1.0, 0.1]), ("l1", "London", [0.0, 1.0])], "id string, city string, vec array<double>")
    assert rows(pairs.topk_pairs(c, c, 1), "id1", "id2") == [("l1", "p2"), ("p1", "l1"), ("p2", "l1")]


def test_topk_of_a_table_with_itself_meets_two_blocks_once(spark, monkeypatch):
    r = np.random.default_rng(3)
    m = r.integers(-2, 3, (240, 3)).astype(float)
    m[:60] = [1.0, 2.0, 0.0]  # many equals
    m[60] = 0.0
    cells_ = [(str(i), "ABCD"[i % 4], m[i].tolist()) for i in range(len(m))]
    c = spark.createDataFrame(cells_, "id string, city string, vec array<float>")
    n = np.linalg.norm(m, axis=1)[:, None]
    s = (m / np.where(n > 0, n, 1)) @ (m / np.where(n > 0, n, 1)).T
    for k, least, block in ((3, -1.0, 40), (3, -1.0, 1000), (70, 0.5, 7)):
        wanted = []
        for i, (one, city, _) in enumerate(cells_):
            near = sorted((-round(s[i, j], 9), x) for j, (x, other, _) in enumerate(cells_) if other != city and (least <= -1 or s[i, j] >= least + 1e-9))
            wanted += [(one, x, rank + 1) for rank, (_, x) in enumerate(near[:k])]
        kinds, squares = [], pairs._squares
        monkeypatch.setattr(pairs, "_squares", lambda a, b, upper: kinds.append(upper) or squares(a, b, upper))  # noqa: B023
        own, other = pairs.topk_pairs(c, c, k, least + 1e-9 if least > -1 else least, block), pairs.topk_pairs(c, c.select("*"), k, least + 1e-9 if least > -1 else least, block)
        monkeypatch.undo()
        assert kinds == [True, False]
        assert rows(own, "id1", "id2", "rank") == rows(other, "id1", "id2", "rank") == sorted(wanted)


def test_edges_of_two_cities_come_from_few_tasks_and_are_written_in_place(spark, tmp_path):
    c = _some_cells(spark, 300)
    found = pairs.cosine_pairs(c, 0.1, block_rows=10, by_city=True)
    columns = ("hex_id1", "hex_id2", "city1", "city2", F.round("similarity", 9))
    assert rows(found, *columns) == rows(pairs.cosine_pairs(c, 0.1), *columns)
    blocks, _, sides = pairs._blocks(c.withColumnRenamed("hex_id", "id"), 10, by_city=True)
    assert blocks.agg(F.max(F.size(F.array_distinct("cities")))).first()[0] <= 2 and sides == pairs.LEAST_SIDES
    names = ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.optimizer.plannedWrite.enabled")
    before = [spark.conf.get(k, None) for k in names]
    sources.write_pairs(found, f"{tmp_path}/pairs", in_place=True)
    assert [spark.conf.get(k, None) for k in names] == before
    back = spark.read.parquet(f"{tmp_path}/pairs")
    assert rows(back, *columns) == rows(found, *columns)
    assert back.where("cast(part1 as string) <> city1 or cast(part2 as string) <> city2").isEmpty()
    own = similarity._narrow_cells(spark, "/root/testdata/sf0.001")
    assert own.schema["vec"].dataType.simpleString() == "array<float>"


def test_blocks_of_floats_are_sent_as_floats(spark, monkeypatch):
    sent, compare = [], pairs._compare
    monkeypatch.setattr(pairs, "_compare", lambda squares, *a: sent.append(squares.schema["all"].dataType.simpleString()) or compare(squares, *a))
    similarity.cosine_edges(spark, "/root/testdata/sf0.001")
    pairs.cosine_pairs(_some_cells(spark, 20))
    assert sent == ["array<float>", "array<double>"]


def test_topk_across_cities_has_every_cell(spark):
    sf = "/root/testdata/sf0.001"
    found = similarity.topk_across_cities(spark, sf)
    assert rows(found.groupBy("id1").count()) == [(i, 3) for i in sorted(str(r.vec_id) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())]


def test_adjacency_has_every_occupied_cell(spark):
    sf = "/root/testdata/sf0.001"
    x, y = places.cell_xy(F.col("lat"), F.col("lon"), 8)
    own = {tuple(r) for r in observations._obs(spark, sf).select(x, y).collect()}
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    assert rows(observations.all_cell_adjacency(spark, sf)) == sorted((a, b, sum((a + i, b + j) in own for i, j in steps)) for a, b in own)


def test_windows_and_boxes_take_all_events(spark):
    sf = "/root/testdata/sf0.001"
    o = [(r.event_id, r.dom, *(float(v) for v in (r.lat, r.lon))) for r in observations._obs(spark, sf).collect()]
    at = {i: (math.radians(lon) * 6378137.0, math.log(math.tan(math.pi / 4 + math.radians(lat) / 2)) * 6378137.0) for i, _, lat, lon in o}
    later = [i for i, dom, *_ in o if dom > 15]
    want = {i: round(d, 0) for i, dom, *_ in o if dom <= 15 and (d := min(math.dist(at[i], at[j]) for j in later)) <= 1_000_000}
    assert {r.id_first: round(r.distance, 0) for r in observations.nearest_pair_of_halves(spark, sf).collect()} == want
    keys = [r.s_suppkey for r in spark.read.parquet(f"{sf}/supplier.parquet").collect()]
    boxes = [(k, k * 53 % 340 - 170.0, k * 29 % 160 - 80.0) for k in keys]
    meet = {(i, k) for i, _, lat, lon in o for k, x, y in boxes if lon <= x + 5.5 and x <= lon + 3 and lat <= y + 4.5 and y <= lat + 2}
    assert {tuple(r)[:2] for r in observations.all_boxes_that_meet(spark, sf).select("left_id", "right_id").collect()} == meet


def test_caps(spark):
    p = spark.createDataFrame([("A", "B", "a", "b", "x", "y", 0.9), ("A", "B", "a", "c", "x", "y", 0.8), ("A", "B", "d", "e", "x", "y", 0.7)], "city1 string, city2 string, id1 string, id2 string, hex_id1 string, hex_id2 string, similarity double")
    assert rows(pairs.cap_pairs(p, 5, 1, 1), "id1", "id2") == [("a", "b")]
    assert len(rows(pairs.cap_pairs(p, 5))) == 3


def test_caps_go_on_beyond_a_hot_source(spark):
    schema = "city1 string, city2 string, id1 string, id2 string, hex_id1 string, hex_id2 string, similarity double"
    hot = [("A", "B", "hot", f"t{i}", "x", f"y{i % 90}", 0.9 - i / 1e6) for i in range(10_500)]
    rest = [("A", "B", f"s{i}", "t", "x", "z", 0.5 - i / 1e3) for i in range(3)]
    found = rows(pairs.cap_pairs(spark.createDataFrame(hot + rest, schema), 5, 2, 2), "id1", "id2")
    assert found == [("hot", "t0"), ("hot", "t1"), ("s0", "t"), ("s1", "t")]


@pytest.mark.parametrize(("n", "per_source", "per_cells"), [(4, 1, 2), (6, 2, 0), (6, 0, 3), (5, 0, 0), (40, 3, 4)])
def test_caps_match_a_walk_over_all_candidates(spark, n, per_source, per_cells):
    draw = random.Random(n)
    schema = "city1 string, city2 string, id1 string, id2 string, hex_id1 string, hex_id2 string, similarity double"
    data = [(c, "Z", f"i{min(draw.randrange(30), draw.randrange(30))}", f"i{draw.randrange(30)}", f"h{draw.randrange(4)}", f"h{draw.randrange(4)}", draw.randrange(200) / 200) for c in "AB" for _ in range(900)]
    want = []
    for city in "AB":
        seen, sources, near = set(), {}, {}
        for r in sorted((r for r in data if r[0] == city), key=lambda r: (-r[6], *r[2:6])):
            pair, cell = frozenset(r[2:4]), frozenset(r[4:6])
            if len(seen) < n and pair not in seen and not (per_source and sources.get(r[2], 0) >= per_source) and not (per_cells and near.get(cell, 0) >= per_cells):
                seen.add(pair)
                sources[r[2]], near[cell] = sources.get(r[2], 0) + 1, near.get(cell, 0) + 1
                want.append(r)
    assert rows(pairs.cap_pairs(spark.createDataFrame(data, schema), n, per_source, per_cells)) == sorted(want)


def test_mmr_prefers_a_different_pair(spark):
    data = [("A", "B", "1", "1", [1.0, 0.0], [1.0, 0.0], 0.99), ("A", "B", "2", "2", [1.0, 0.01], [1.0, 0.0], 0.98), ("A", "B", "3", "street", [0.0, 1.0], [0.0, 1.0], 0.90)]
    p = spark.createDataFrame(data, "city1 string, city2 string, id1 string, id2 string, vec1 array<double>, vec2 array<double>, similarity double")
    assert rows(pairs.mmr_rerank(p, 2, 0.8), "id2") == [("1",), ("street",)]


def test_mmr_pairs_chooses_from_the_whole_pool(spark):
    sf = "/root/testdata/sf0.1"
    c = similarity._cells(spark, sf)
    p = pairs.cosine_pairs(c, 0.1).withColumnsRenamed({"hex_id1": "id1", "hex_id2": "id2"})
    for k in "12":
        p = p.join(c.select(F.col("hex_id").alias(f"id{k}"), F.col("vec").alias(f"vec{k}")), f"id{k}")
    columns = ["city1", "city2", "id1", "id2", "mmr_rank"]
    assert rows(similarity.mmr_pairs(spark, sf), *columns) == rows(pairs.mmr_rerank(p, 10, candidates=200), *columns)


def test_js(spark):
    h = spark.createDataFrame([("a", "A", [0.5, 0.5, 0.0]), ("b", "B", [0.5, 0.5, 0.0]), ("c", "C", [0.0, 0.0, 1.0])], "hex_id string, city string, vec array<double>")
    found = {frozenset((a, b)): round(s, 9) for a, b, s in rows(pairs.js_pairs(h, -1.0), "hex_id1", "hex_id2", "similarity")}
    assert found[frozenset("ab")] == 1 and found[frozenset("ac")] == 0
    assert h.where("hex_id = 'a'").select(V.js_distance(F.col("vec"), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))).first()[0] == pytest.approx(1)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.normalise(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert df.select(V.normalise(F.col("v"), True)).collect()[1][0] is None
    assert len(df.select(V.project(F.col("v"), 5)).first()[0]) == 5
    wide = V.to_wide(df, "v", 2)
    assert wide.columns == ["e_0000", "e_0001"] and V.to_vector(wide, wide.columns).first()[0] == [3.0, 4.0]
    assert spark.createDataFrame([([1.0, math.inf],)], "v array<double>").select(V.all_finite(F.col("v"))).first()[0] is False


def test_city_pair_summary(spark):
    draw = np.random.default_rng(4)
    data = [(a, b, float(x)) for (a, b), x in zip([("oslo", "rome"), ("rome", "oslo"), ("lima", "rome"), ("oslo", "lima")] * 6, draw.uniform(-1, 1, 24), strict=True)]
    out = edges.summarise_pairs(spark.createDataFrame(data, "city1 string, city2 string, similarity double"))
    want = []
    for pair in sorted({tuple(sorted(x[:2])) for x in data}):
        own = np.array([x for a, b, x in data if tuple(sorted((a, b))) == pair])
        want.append((*pair, *(pytest.approx(float(v)) for v in (own.mean(), *np.quantile(own, [0.5, 0.9, 0.95]), own.max())), len(own)))
    assert rows(out) == want


def test_membership(spark):
    own = spark.createDataFrame([(f"{c}{i}", c) for c in ("turku", "lodz", "aosta") for i in range(3)], "hex_id string, city string")
    raw = [
        ("turku0", "lodz0", "Turku", "Łódź", 0.31), ("turku1", "aosta2", " TURKU ", "Aosta", 0.52),  # as named
        ("turku2", "aosta0", "aosta", "Turku", 0.44), ("turku0", "aosta1", "Aosta", "turku", 0.63), ("aosta2", "turku1", "Turku", "Aosta", 0.57),  # the other way round
        ("gone9", "aosta1", "Turku", "Aosta", 0.25), ("turku1", "aosta1", "Turku", "Vaduz", 0.35), ("turku1", "turku2", "Aosta", "Turku", 0.15),
    ]
    shards = spark.createDataFrame(raw, "hex_id1 string, hex_id2 string, c1 string, c2 string, similarity double")
    named = names.normalise_names(names.normalise_names(shards, "c1", "city1"), "c2", "city2").drop("c1", "c2").replace("łodz", "lodz", ["city1", "city2"])
    found = edges.classify_edges(named, own)
    assert rows(edges.audit(found)) == [("direct", 2), ("missing_city_h3", 2), ("reversed_fixed", 3), ("unresolved", 1)]
    kept = rows(edges.orient(found), "hex_id1", "hex_id2", "city_1", "city_2", "similarity")
    assert kept == [("aosta0", "turku2", "aosta", "turku", 0.44), ("aosta1", "turku0", "aosta", "turku", 0.63), ("aosta2", "turku1", "aosta", "turku", 0.57), ("lodz0", "turku0", "lodz", "turku", 0.31)]
    assert edges.quarantine(found).count() == 3


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("\tÅLESUND\n", "alesund"), ("Ålborg-Øst", "alborgst"), ("Salem OR.", "salem"), ("Salem-MA", "salem"), ("Salem North-Carolina", "salem"), ("O'Fallon, Illinois, U.S.", "ofallon"), ("New Mexico", "newmexico"),
        ("Kansas", "kansas"), ("Truth New Mexico", "truth"), ("La Paz", "lapaz"), ("Paris in", "paris"), ("", ""), (None, ""), (", CA", ""), ("5th St. 7", "5thst7"),
    ],
)
def test_canonical_names(name, key):
    assert names.canonical_name(name) == key


def test_demographics(spark):
    found = spark.createDataFrame([("i1", "p1", "female", "old"), ("i2", "p1", "male", "old"), ("i3", "p1", "male", "young"), ("i4", "p2", "female", "old"), ("i5", "elsewhere", "male", "old")], "img string, pano string, gender string, age string")
    places = spark.createDataFrame([("p1", "h", 2020), ("p2", "h", 2020), ("p3", "k", 2021)], "pano string, hex_id string, year int")
    got = rows(panels.demographics(found, places, [("female", "old"), ("male", "old"), ("male", "young")]))
    assert got == [("h", 2020, 2, 1, 1, 4, 2, pytest.approx((1 / 3 + 1) / 2), pytest.approx(1 / 3)), ("k", 2021, 0, 0, 0, 0, 0, None, None)]


def test_counts_of_things(spark):
    parts = spark.createDataFrame([("p", "car", True), ("p", "car", True), ("p", "bus", True), ("q", "bus", True), ("r", "car", False), (None, "car", True)], "pano string, category string, is_thing boolean")
    places = spark.createDataFrame([(x, "c") for x in "pqr"], "pano string, cell string")
    assert rows(panels.instance_counts(parts, places, "cell", ["car", "bus"])) == [("c", 1.0, 1.0, 2)]
    counts = spark.createDataFrame([("h", 1, "car", 4, 2), ("h", 1, "bus", 1, 2), ("h", 2, "0", 0, 3), ("k", 1, "0", 0, 1)], "hex_id string, year int, object_name string, n int, panoid_n int")
    assert rows(panels.per_panorama(counts, ["bus", "car"])) == [("h", 0.2, 0.8)]
    wide = spark.createDataFrame([("a", 1, None, 3)], "key string, x int, y int, z int")
    assert panels.collapse_columns(wide, ["key"], ["x", "y", "z"], {"x": "s", "y": "s"}).columns == ["key", "s"]
    assert rows(panels.collapse_columns(wide, ["key"], ["x", "y", "z"], {"x": "s", "y": "s", "z": "t"})) == [("a", 1, 3)]


def test_contracts(spark):
    found = spark.createDataFrame([("a", [0.5, 0.5]), ("a", [1.0, 0.0]), ("b", [0.5]), (None, [0.0, 0.0]), ("c", [-1.0, float("nan")]), ("d", None)], "name string, vec array<double>")
    assert dict(map(tuple, contracts.probability_faults(found, "name", "vec", 2).collect())) == {"null_name": 1, "size": 2, "not_finite": 1, "negative": 1, "no_mass": 1, "duplicate_name": 1}
    cells = spark.createDataFrame([("x", 6), ("y", 6), ("x", 7)], "city string, res int")
    assert contracts.refuse_sparse(cells, 6).count() == 2
    with pytest.raises(ValueError, match="resolution 7"):
        contracts.refuse_sparse(cells, 7)
    assert contracts.schema_faults(cells, {"city": "string", "res": "bigint", "n": "int"}) == ["missing n", "res is int, not bigint"]
    assert contracts.schema_faults(cells, {"res": "int", "city": "string"}) == ["order of columns"]
    assert contracts.schema_faults(cells, dict(cells.dtypes)) == []


def test_average_rank_matches_pandas(spark):
    draw = np.random.default_rng(9)
    values = pd.Series([*draw.integers(0, 40, 300).astype(float), *draw.normal(0, 30, 200)])
    df = spark.createDataFrame(list(enumerate(values.tolist())), "id int, x double")
    for by in (None, ["g"]):
        given = df.withColumn("g", F.col("id") % 3)
        group = values.groupby(values.index % 3) if by else values
        want = group.rank(ascending=False).astype(int)
        assert {r.id: r["rank"] for r in tables.average_rank(given, "x", by=by, slices=7).collect()} == want.to_dict()


def test_shards_are_summarised_as_they_are(spark):
    rows_ = [("s", "a", "b", "x", "y", -0.4), ("s", "b", "a", "y", "x", -0.2), ("t", "a", "b", "x", "y", -0.6)]
    df = spark.createDataFrame(rows_, "shard string, hex_id1 string, hex_id2 string, city1 string, city2 string, similarity double")
    assert rows(edges.summarise_shards(df, "shard")) == [("x", "y", pytest.approx(-0.4), 0.0, 2)]


def test_duplicates(spark):
    df = spark.createDataFrame([("h1", "v1"), ("h1", "v1"), ("h2", "v2"), ("h2", "v3"), ("h3", "v3")], "hex_id string, v string")
    assert rows(edges.duplicates(df, "hex_id", "v")) == [(5, 3, 2, 2, 1, 3, 4)]


def test_aggregate_vectors_with_exclusion(spark):
    obs = spark.createDataFrame([("t", "c1", [10.0, 0.0]), ("u", "c1", [1.0, 1.0]), ("a", "c2", [3.0, 4.0]), ("b", "c2", [0.0, 4.0])], "panoid string, cell_8 string, vec array<double>")
    left = cells.exclude_cells(obs, spark.createDataFrame([("t",)], "panoid string"), "cell_8", "panoid")
    ((cell, res, n, vec),) = rows(cells.aggregate_vectors(left, [8]), "hex_id", "res", "img_count", "vec")
    length = math.hypot(1.5, 4.0)
    assert (cell, res, n) == ("c2", 8, 2) and vec == pytest.approx([1.5 / length, 4 / length])


def test_holdout_counts(spark):
    df = spark.range(23).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    out = cells.stratified_holdout(df, "g", "k", 0.25, 1)
    assert rows(out.where("is_holdout").groupBy("g").count()) == [(0, 3), (1, 3)]
    again = cells.stratified_holdout(df.repartition(5), "g", "k", 0.25, 1)
    assert rows(out) == rows(again)


def test_first_per_group(spark):
    df = spark.createDataFrame([("h1", f"image-{i:03d}") for i in range(52)] + [("h2", "x")], "hex_id string, name string")
    out = cells.first_per_group(df.repartition(3), ["hex_id"], ["name"], 50)
    assert out.count() == 51 and out.agg(F.max("name")).where("1 = 1").first()[0] == "x"


def test_modes(spark):
    df = spark.createDataFrame([("c", "i1", [1.0, 0.0]), ("c", "i2", [0.0, 1.0])], "cell string, name string, vec array<double>")
    book = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "mode_id int, centroid array<double>")
    found = modes.assign_modes(df, book)
    hist = modes.mode_histogram(found, ["cell"])
    assert rows(hist, "mode_id", "mode_fraction") == [(0, 0.5), (1, 0.5)]
    assert rows(modes.dense_histogram(hist, ["cell"], 3), "vec") == [([0.5, 0.5, 0.0],)]
    assert modes.scorecard(found, 3).first()["empty_modes"] == 1
    assert modes.adjusted_rand(found, "name", "mode_id").first()[0] == pytest.approx(1)
    assert modes.fit_codebook(df, 2).select(F.round(V.norm(F.col("centroid")), 9)).distinct().count() == 1


def _vectors(spark, x):
    return spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")


def test_nearly_as_many_modes_as_rows_leave_none_empty(spark):
    df = _vectors(spark, np.random.default_rng(1).normal(size=(620, 8)))
    assert rows(modes.codebook_candidates(df, [4, 600, 620, 621])) == [(4, "ok", 4), (600, "ok", 600), (620, "ok", 620), (621, "invalid_k", 0)]
    assert modes.fit_codebook(df, 600).where("size(centroid) = 8").count() == 600


def test_thousands_of_modes_take_seconds(spark):
    x, began = np.random.default_rng(4).normal(size=(5000, 64)), time.monotonic()
    assert rows(modes.codebook_candidates(_vectors(spark, x), [4900])) == [(4900, "ok", 4900)]
    assert time.monotonic() - began < 90  # MLlib's choice of first centroids alone takes longer


def test_many_modes_find_the_nearest_centre_of_every_row(spark):
    x = np.random.default_rng(2).normal(size=(3000, 3))
    for rounds in (0, 1, 6):
        centres, n = many_modes.fit(_vectors(spark, x), 520, rounds=rounds)
        assert np.allclose(np.linalg.norm(centres, axis=1), 1)
        assert np.array_equal(n, np.bincount((x / np.linalg.norm(x, axis=1)[:, None] @ centres.T).argmax(1), minlength=520)) and n.min() > 0
    assert np.array_equal(many_modes.sizes(many_modes.units(_vectors(spark, x), "vec"), centres), n)


def test_modes_beyond_the_directions_stay_empty(spark):
    x = np.random.default_rng(3).normal(size=(100, 4))
    df = _vectors(spark, np.concatenate([k * x for k in range(8)]))  # 100 rows have no direction
    nothing = spark.createDataFrame([(None,), ([1.0, None, 0.0, 0.0],)], df.schema)
    assert rows(modes.codebook_candidates(df.unionByName(nothing), [600])) == [(600, "empty_modes", 100)]


def test_places(spark):
    df = spark.createDataFrame([(41.0, -72.0)], "lat double, lon double")
    fine = df.select(places.cell(F.col("lat"), F.col("lon"), 12).alias("c"))
    lat, lon = places.centre(F.col("c"))
    a, b = fine.select(lat, lon).first()
    assert abs(a - 41) < 0.1 and abs(b + 72) < 0.1
    assert df.select(places.haversine_km(F.col("lat"), F.col("lon"), F.col("lat") + 1, F.col("lon"))).first()[0] == pytest.approx(111.19, abs=0.01)


def test_nearest_pairs_meet_over_cell_borders(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lat double, lon double")
    b = spark.createDataFrame([(7, 0.00001, -0.00001), (8, 1.0, 1.0)], "id int, lat double, lon double")
    assert rows(spatial.nearest_pairs(a, b, 5.0), "id_first", "id_second") == [(1, 7)]


def test_tables(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 3.0), ("j", "a", 2.0)], "key string, label string, x double")
    assert rows(tables.pivot_filled(df, ["key"], "label", ["a", "b"], F.sum("x"))) == [("j", 2.0, 0.0), ("k", 1.0, 3.0)]
    assert rows(tables.composition(df, "key", "label", 2), "key", "label", "diversity")[1][2] == pytest.approx(1)
    assert rows(tables.balanced(df, "key", "label", 2), "key") == [("k",), ("k",)]
    assert rows(tables.completed_counts(df.where("label = 'b'"), df, ["key"], "label")) == [("j", "0", 0), ("k", "b", 1)]


def test_select_k(spark):
    shape = "k int, status string, stability double, min_mode_share double, held_out_mean_cohesion double"
    pick = lambda *xs: tuple(modes.select_k(spark.createDataFrame(list(xs), shape)).first())
    # The first that gains too little is chosen itself, and compared with the valid one before it.
    assert pick((10, "ok", 0.93, 0.1, 0.61), (20, "ok", 0.97, 0.1, 0.66), (30, "empty_modes", 0.99, 0.1, 0.9), (40, "ok", 0.95, 0.1, 0.664), (50, "ok", 0.9, 0.1, 0.665)) == (40, "smallest_valid_elbow")
    assert pick((10, "ok", 0.99, 0.1, 0.6), (20, "ok", 0.91, 0.1, 0.62), (30, "ok", 0.89, 0.1, 0.62), (40, "ok", 0.99, 0.0001, 0.62)) == (10, "max_stability_times_cohesion")
    with pytest.raises(Exception, match="no candidate"):
        pick((10, "ok", 0.5, 0.1, 0.6))


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for city, n in (("rome", 2), ("oslo", 1)):
        (tmp_path / "in" / f"{city}_pano.csv").write_text("id,v\n" + "".join(f"{i},#\n" for i in range(n)))
    df = sources.read_city_files(spark, f"{tmp_path}/in/*.csv", r"([^/]+)_pano\.csv", "csv", "id int, v double", header=True)
    assert rows(df, "city", "id", "v") == [("oslo", 0, None), ("rome", 0, None), ("rome", 1, None)]
    assert sources.first_existing(spark, [f"{tmp_path}/none/*", f"{tmp_path}/in/*"]) == f"{tmp_path}/in/*"
    assert rows(sources.list_files(spark, f"{tmp_path}/in", "*.csv"), "name") == [("oslo_pano.csv",), ("rome_pano.csv",)]
    kept, missing = sources.read_manifest(df, spark.createDataFrame([("rome",), ("bern",)], "city string"), ["city"])
    assert kept.count() == 2 and rows(missing) == [("bern",)]


def test_alerts_batch_and_stream(spark, tmp_path):
    alerts = [{"uuid": u, "type": t, "pubMillis": ms, "location": {"x": 1.0, "y": 2.0}} for u, t, ms in (("a", "JAM", 0), ("b", "JAM", 1000), ("a", "JAM", 90_000_000))]
    (tmp_path / "p1.json").write_text(json.dumps({"alerts": alerts[:2]}))
    (tmp_path / "p2.json").write_text(json.dumps({"alerts": alerts[2:]}))
    (tmp_path / "bad.json").write_text("{")
    df = sources.read_alerts(spark, str(tmp_path))
    assert df.count() == 3
    batch = streaming.daily_counts(df)
    assert [(str(d), k, n) for d, k, n in rows(batch)] == [("1970-01-01", "JAM", 2)]
    df.select("uuid", "type", "ts").write.parquet(f"{tmp_path}/feed")
    stream = streaming.alert_stream(spark, f"{tmp_path}/feed", "uuid string, type string, ts timestamp", fmt="parquet")
    q = streaming.daily_counts(stream).writeStream.outputMode("append").format("memory").queryName("days").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from days").columns == ["day", "type", "n"]


def test_sinks(spark, tmp_path, vectors):
    found = pairs.cosine_pairs(vectors)
    sources.write_pairs(found, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 3 and "city1" in back.columns
    sources.write_with_sidecar(found, f"{tmp_path}/t", {"rows": 3, "a": 1})
    assert spark.read.text(f"{tmp_path}/t.facts").first()[0] == '{"a":1,"rows":3}'
    assert sources.purge(spark, f"{tmp_path}", ["t", "none"]) == ["t"]


def _some_cells(spark, n=120, cities=4, seed=1):
    draw = np.random.default_rng(seed)
    data = [(f"{i}", f"c{draw.integers(cities)}", draw.normal(size=6).round(1).tolist()) for i in range(n)]  # ids aren't in order as texts
    return spark.createDataFrame([*data, ("null", "c0", None), ("zero", "c1", [0.0] * 6)], "hex_id string, city string, vec array<double>")


@pytest.mark.parametrize("block", [7, 1000])
def test_edges_have_the_smaller_id_first(spark, block):
    c = _some_cells(spark)
    found = rows(pairs.cosine_pairs(c, 0.3, block_rows=block).withColumn("similarity", F.round("similarity", 9)))
    assert found and all(r[0] < r[1] for r in found)
    assert found == rows(pairs.cosine_pairs_sql(c, 0.3).withColumn("similarity", F.round("similarity", 9)))


def test_sums_of_pairs_never_leave_their_blocks_as_edges(spark):
    c = _some_cells(spark)
    e = pairs.cosine_pairs(c, 0.1)
    parts = pairs.pair_sums(c, 0.1, block_rows=7)
    assert parts.count() < e.count() / 2
    keep = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows(df)]
    assert keep(edges.zero_filled_sums(parts, c)) == keep(edges.zero_filled(e, c))


def test_sums_of_pairs_by_the_label_of_the_smaller_id(spark):
    c = _some_cells(spark).withColumn("shard", F.length("hex_id"))
    found = pairs.pair_sums(c, -1.0, keep_all=True, label="shard", ordered=True, block_rows=7)
    e = pairs.cosine_pairs(c, -1.0, keep_all=True).withColumns({"a": F.length("hex_id1").cast("string"), "b": F.length("hex_id2").cast("string")})
    want = e.groupBy("city1", "a", "city2", "b").agg(F.count("*"), F.round(F.sum("similarity"), 6), F.round(F.max("similarity"), 6))
    assert rows(found.groupBy("city1", "label1", "city2", "label2").agg(F.sum("n"), F.round(F.sum("total"), 6), F.round(F.max("max"), 6))) == rows(want)


@pytest.mark.parametrize("copies", [False, True])
def test_percentiles_of_pairs_from_counts(spark, copies):
    c = _some_cells(spark)
    c = c.withColumn("vec", F.when(F.length("hex_id") < 3, F.array(*map(F.lit, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]))).otherwise(F.col("vec"))) if copies else c
    want = edges.summarise_pairs(pairs.cosine_pairs(c, -1.0, keep_all=True))
    found = pairs.pair_percentiles(c, [0.5, 0.9, 0.95], block_rows=7)
    flat = found.select("city_1", "city_2", "avg", *(F.get("p", F.lit(i)) for i in range(3)), "max", "pair_count")
    for a, b in zip(rows(flat), rows(want), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_capped_pairs_go_on_to_the_next_prefix(spark):
    c = _some_cells(spark, 60, 2)
    near = lambda m: pairs.best_pairs(c, -0.5, m, block_rows=7).withColumnsRenamed({"hex_id1": "id1", "hex_id2": "id2"}).withColumns({"hex_id1": F.col("id1"), "hex_id2": F.lit("x")})
    columns = ["city1", "city2", "id1", "id2"]
    assert rows(pairs.cap_best(near, 15, 1, 0, most=2), *columns) == rows(pairs.cap_pairs(near(10_000), 15, 1, 0), *columns)


def test_best_pairs_of_equals_have_the_smaller_ids(spark):
    c = spark.createDataFrame([(f"{k}{i:02}", k, [1.0, 0.0]) for k in "ab" for i in range(20)], "hex_id string, city string, vec array<double>")
    assert rows(pairs.best_pairs(c, 0.1, 3, block_rows=4), "hex_id1", "hex_id2") == [("a00", "b00"), ("a00", "b01"), ("a00", "b02")]


def test_topk_keeps_no_more_equals_than_k(spark):
    c = spark.createDataFrame([(f"{k}{i:02}", k, [1.0, 1e-12 * i]) for k in "ab" for i in range(20)], "id string, city string, vec array<double>")
    squares = pairs._squares(pairs._blocks(c, 4), pairs._blocks(c, 4), False)
    assert pairs._compare(squares, lambda: pairs._TopK(2, -np.inf), pairs.EDGE, False).count() <= 40 * 2 * 8
    assert {r[1][1:] for r in rows(pairs.topk_pairs(c, c, 2, block_rows=4), "id1", "id2")} == {"00", "01"}


def test_a_block_is_sent_once_to_each_square(spark):
    c = _some_cells(spark, 400).withColumnRenamed("hex_id", "id")
    blocks = pairs._blocks(c, 4)
    sent = pairs._squares(blocks, blocks, True).count()
    assert blocks[1] > 90 and sent == blocks[1] * (pairs.LEAST_SIDES + 1)


def test_diff_in_rows_is_diff(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.2), (3, 0.9)], "id int, s double")
    old, new = F.when(F.col("s") > 0.3, F.col("s")), F.when(F.col("s") < 0.8, F.col("s") * 2)
    one, two = (df.withColumn("s", x).where("s is not null") for x in (old, new))
    assert rows(edges.diff_in_rows(df, ["id"], old, new)) == rows(edges.diff(one, two, ["id"], "s"))


def test_pair_distances_by_blocks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    data = [(f"{i}", float(draw.uniform(-60, 60)), float(draw.uniform(-180, 180)), int(i % 3)) for i in range(60)] + [("7", 0.0, 0.0, 1), (None, 1.0, 1.0, 1), ("x", None, 1.0, 1)]
    p = spark.createDataFrame(data, "id string, lat double, lon double, city int")
    monkeypatch.setattr(spatial, "PLACES", 4)
    known = p.where("lat is not null")  # a place without a position has no distance
    a, b = (known.select("city", *(F.col(c).alias(f"{c}{k}") for c in ("id", "lat", "lon"))) for k in (1, 2))
    d = places.haversine_km(*(F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")))
    want = a.join(b, "city").where("id1 < id2").select("id1", "id2", "city", F.round(d, 6).alias("d")).where("d > 0")
    assert rows(spatial.pair_distances(p, "city", 6)) == rows(want)
    assert spatial.pair_distances(p, "city").rdd.getNumPartitions() >= 16  # three groups are more than three pieces of work


def test_places_that_share_a_position_meet_once(spark):
    left = spark.range(3000).select("id", F.lit(0.0).alias("lat"), (F.col("id") % 2).cast("double").alias("lon"))
    right = spark.range(5000, 8000).select("id", F.lit(0.0).alias("lat"), (F.col("id") % 2 + 0.25).cast("double").alias("lon"))
    found = spatial.nearest_pairs(left, right, 1_000_000.0)
    assert found.groupBy(F.col("id_first") % 2, "id_second").count().sort("id_second").collect() == [(0, 5000, 1500), (1, 5001, 1500)]
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [x_l" in joined and "Aggregate [x_r" in joined
