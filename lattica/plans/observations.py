"""Queries over observations. Users of events are panoramas, events their images, event types the objects seen; places follow
from ids by arithmetic. Orders and line items stand for images with labelled areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, places
from ..operators import cells, clusters, graphs, regions, spatial, tables
from ..sources import tables as read
from ..streaming import daily_counts

QUERIES, ORACLES = {}, {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _obs(spark: SparkSession, sf: str) -> DataFrame:
    (e,) = read(spark, sf, "events")
    k = F.col("event_id")
    return e.select("event_id", "user_id", "event_type", "value", "ts", F.to_date("ts").alias("day"), F.dayofmonth("ts").alias("dom"), ((k * 37 % 12000) / 100.0 - 60).alias("lat"), ((k * 91 % 36000) / 100.0 - 180).alias("lon"))


_O = "o AS (SELECT event_id, user_id, event_type, value, ts, CAST(ts AS DATE) AS day, day(ts) AS dom, (event_id * 37 % 12000) / 100.0::DOUBLE - 60 AS lat, (event_id * 91 % 36000) / 100.0::DOUBLE - 180 AS lon FROM events)"
_XY = "x AS (SELECT *, least(greatest(floor((lon + 180) / 360 * 256), 0), 255)::BIGINT AS gx, least(greatest(floor((lat + 90) / 180 * 256), 0), 255)::BIGINT AS gy FROM o), q AS (SELECT *, array_to_string(list_transform(range(7, -1, -1), lambda i: ((gx >> i) & 1) + 2 * ((gy >> i) & 1)), '') AS cell_8 FROM x)"
_Q = f"WITH {_O}, {_XY}"


def _celled(spark, sf) -> DataFrame:
    return cells.assign_cells(_obs(spark, sf), [4, 6, 8])


@_query(_Q + " SELECT event_id, cell_8, cell_8[1:6] AS cell_6, cell_8[1:4] AS cell_4 FROM q")
def cell_assignment(spark, sf):
    return _celled(spark, sf).select("event_id", "cell_8", "cell_6", "cell_4")


@_query(_Q + " SELECT DISTINCT cell_8, round((gy + 0.5) / 256 * 180 - 90, 6) AS lat, round((gx + 0.5) / 256 * 360 - 180, 6) AS lon FROM q")
def cell_centres(spark, sf):
    lat, lon = places.centre(F.col("cell_8"))
    return _rounded(_celled(spark, sf).select("cell_8").distinct().select("cell_8", lat.alias("lat"), lon.alias("lon")))


@_query(_Q + ", m AS (SELECT r, cell_8[1:r] AS hex_id, value FROM q, (SELECT unnest([4, 6, 8]) AS r)) SELECT hex_id, r::INTEGER AS res, count(*) AS img_count, round(avg(value), 6) AS v0, round(avg(value * value), 6) AS v1 FROM m GROUP BY 1, 2")
def multi_resolution_means(spark, sf):
    obs = _celled(spark, sf).withColumn("vec", F.array("value", F.col("value") * F.col("value")))
    out = cells.aggregate_vectors(obs, [4, 6, 8], l2=False)
    return _rounded(out.select("hex_id", "res", "img_count", F.get("vec", F.lit(0)).alias("v0"), F.get("vec", F.lit(1)).alias("v1")))


@_query(_Q + ", t AS (SELECT DISTINCT cell_8 FROM q WHERE user_id % 10 = 0) SELECT event_id, cell_8 FROM q WHERE cell_8 NOT IN (SELECT cell_8 FROM t)")
def leakage_exclusion(spark, sf):
    obs = _celled(spark, sf)
    return cells.exclude_cells(obs, obs.where("user_id % 10 = 0").select("user_id"), "cell_8", "user_id").select("event_id", "cell_8")


@_query(_Q + ", r AS (SELECT *, row_number() OVER (PARTITION BY cell_8[1:4] ORDER BY event_id) AS r FROM q) SELECT event_id, cell_8[1:4] AS cell_4 FROM r WHERE r <= 3")
def sampled_per_cell(spark, sf):
    return cells.first_per_group(_celled(spark, sf), ["cell_4"], ["event_id"], 3).select("event_id", "cell_4")


@_query(_Q + ", r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('3|' || event_id)) AS r FROM q) SELECT event_id, user_id FROM r WHERE r <= 2")
def random_sample_per_user(spark, sf):
    return cells.first_per_group(_obs(spark, sf), ["user_id"], [cells.hash_order(3, "event_id")], 2).select("event_id", "user_id")


@_query(_Q + ", c AS (SELECT cell_8[1:6] AS cell_6, event_type, count(*) AS n FROM q GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cell_6 ORDER BY n DESC, event_type DESC) AS r FROM c) SELECT cell_6, event_type, n AS votes FROM r WHERE r = 1")
def majority_vote(spark, sf):
    return cells.majority_vote(_celled(spark, sf), "cell_6", "event_type")


@_query(_Q + ", c AS (SELECT user_id, event_type, count(*) AS n FROM q GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) SELECT user_id, event_type, n FROM r WHERE r = 1")
def label_mapping(spark, sf):
    return cells.best_mapping(_obs(spark, sf), "user_id", "event_type")


_HAV = "2 * 6371.0 * asin(least(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)), 1))"
_PL = "p AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 12000) / 100.0::DOUBLE - 60 AS lat, (s_suppkey * 91 % 36000) / 100.0::DOUBLE - 180 AS lon, s_nationkey AS city FROM supplier)"


def _suppliers(spark, sf) -> DataFrame:
    (s,) = read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("id"), ((k * 37 % 12000) / 100.0 - 60).alias("lat"), ((k * 91 % 36000) / 100.0 - 180).alias("lon"), F.col("s_nationkey").alias("city"))


@_query(f"WITH {_PL} SELECT id1, id2, round(d, 6) AS dist_pair FROM (SELECT a.id AS id1, b.id AS id2, {_HAV.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} AS d FROM p a JOIN p b ON a.id < b.id WHERE a.city = b.city) WHERE d > 0")
def pair_distances(spark, sf):
    s = _suppliers(spark, sf)
    return spatial.pair_distances(s, "city", 6).select("id1", "id2", "dist_pair")


@_query(f"WITH {_PL}, c AS (SELECT city, avg(lat) AS a, avg(lon) AS o FROM p GROUP BY 1) SELECT id, round({_HAV.format(a='lat', b='a', c='lon', d='o')} * 1000, 3) AS h3_cbd_dist FROM p JOIN c USING (city)")
def centre_distances(spark, sf):
    s = _suppliers(spark, sf)
    c = s.groupBy("city").agg(F.avg("lat").alias("centre_lat"), F.avg("lon").alias("centre_lon"))
    return spatial.centre_distances(s, c, "city").select("id", F.round("h3_cbd_dist", 3).alias("h3_cbd_dist"))


_MX = "radians(lon) * 6378137.0 AS x, ln(tan(0.7853981633974483 + radians(lat) / 2)) * 6378137.0 AS y"


@_query(f"WITH {_O}, a AS (SELECT event_id, {_MX} FROM o WHERE dom <= 15), b AS (SELECT event_id, {_MX} FROM o WHERE dom > 15), g AS (SELECT event_id, x, y, floor(x / 1000000) + i AS gx, floor(y / 1000000) + j AS gy FROM a, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)), h AS (SELECT *, floor(x / 1000000) AS gx, floor(y / 1000000) AS gy FROM b), d AS (SELECT g.event_id AS i, h.event_id AS j, sqrt(pow(g.x - h.x, 2) + pow(g.y - h.y, 2)) AS d FROM g JOIN h USING (gx, gy)), r AS (SELECT i, min(d) AS d, arg_min(j, (d, j)) AS j FROM d WHERE d <= 1000000 GROUP BY i) SELECT i AS id_first, j AS id_second, round(d, 3) AS distance FROM r")
def nearest_pair_of_halves(spark, sf):
    """Every event of the month's first half and the nearest one of the second."""
    o = _obs(spark, sf).withColumnRenamed("event_id", "id")
    found = spatial.nearest_pairs(o.where("dom <= 15"), o.where("dom > 15"), 1_000_000.0)
    return found.select("id_first", "id_second", F.round("distance", 3).alias("distance"))


@_query(f"WITH {_O} SELECT event_id AS id, 0 AS polygon_id FROM o WHERE lat + abs(lon - 20) < 29.997 AND lat > -10.003")
def points_in_polygon(spark, sf):
    ring = spark.sql("select 0 as polygon_id, array(named_struct('x', -20D, 'y', -10.003D), named_struct('x', 60D, 'y', -10.003D), named_struct('x', 20D, 'y', 29.997D)) as ring")
    o = _obs(spark, sf).select(F.col("event_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return spatial.points_in_polygons(o, ring)


@_query(f"WITH {_O}, s AS (SELECT event_id, lon AS x1, lat AS y1, lon + value / 10 AS x2, lat + 5 AS y2 FROM o), b AS (SELECT *, -50.0 AS l, -20.0 AS b, 50.0 AS r, 20.0 AS t FROM s), k AS (SELECT event_id, greatest(0, CASE WHEN x2 = x1 THEN 0 ELSE least((l - x1) / (x2 - x1), (r - x1) / (x2 - x1)) END, least((b - y1) / (y2 - y1), (t - y1) / (y2 - y1))) AS lo, least(1, CASE WHEN x2 = x1 THEN 1 ELSE greatest((l - x1) / (x2 - x1), (r - x1) / (x2 - x1)) END, greatest((b - y1) / (y2 - y1), (t - y1) / (y2 - y1))) AS hi, x2 = x1 AND (x1 < l OR x1 > r) AS out FROM b) SELECT event_id, round(CASE WHEN out THEN 0 ELSE greatest(hi - lo, 0) END, 6) AS share FROM k")
def clipped_lines(spark, sf):
    o = _obs(spark, sf)
    end = (F.col("lon"), F.col("lat"), F.col("lon") + F.col("value") / 10, F.col("lat") + 5)
    return _rounded(o.select("event_id", places.clipped_share(*end, F.lit(-50.0), F.lit(-20.0), F.lit(50.0), F.lit(20.0)).alias("share")))


@_query(_Q + ", c AS (SELECT DISTINCT gx, gy FROM q), s AS (SELECT gx, gy, gx + i AS nx, gy + j AS ny FROM c, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j) WHERE i <> 0 OR j <> 0) SELECT s.gx, s.gy, count(b.gx) AS n_neighbours FROM s LEFT JOIN c b ON b.gx = s.nx AND b.gy = s.ny GROUP BY 1, 2")
def all_cell_adjacency(spark, sf):
    """Every occupied cell and how many of its neighbours are occupied."""
    x, y = places.cell_xy(F.col("lat"), F.col("lon"), 8)
    return spatial.adjacency(_obs(spark, sf).select(x.alias("gx"), y.alias("gy"))).select("gx", "gy", "n_neighbours")




@_query("WITH w AS (SELECT l_orderkey, year(l_shipdate) AS y, " + ", ".join(f"coalesce(sum(l_quantity) FILTER (l_linenumber = {k}), 0) AS a{k}" for k in range(1, 8)) + " FROM lineitem GROUP BY 1, 2) SELECT y::INTEGER AS year, " + ", ".join(f'round(avg(a{k}), 6) AS "{k}"' for k in range(1, 8)) + ", count(DISTINCT l_orderkey) AS n_images FROM w GROUP BY 1")
def segment_panel(spark, sf):
    (l,) = read(spark, sf, "lineitem")
    seg = l.withColumn("year", F.year("l_shipdate"))
    return _rounded(tables.panel_mean(seg, "l_orderkey", ["year"], "l_linenumber", list(range(1, 8)), F.sum("l_quantity")))


@_query("SELECT year(l_shipdate)::INTEGER AS year, " + ", ".join(f'coalesce(round(sum(l_quantity) FILTER (l_linenumber = {k}), 6), 0) AS "{k}"' for k in range(1, 8)) + " FROM lineitem GROUP BY 1")
def segment_sums(spark, sf):
    (l,) = read(spark, sf, "lineitem")
    return _rounded(tables.pivot_filled(l.withColumn("year", F.year("l_shipdate")), ["year"], "l_linenumber", list(range(1, 8)), F.sum("l_quantity")))


@_query(f"WITH {_O}, p AS (SELECT DISTINCT user_id, dom FROM o), c AS (SELECT user_id, dom, event_type, count(*) AS n FROM o WHERE event_type IN ('purchase', 'signup') GROUP BY ALL) SELECT p.user_id, p.dom::INTEGER AS dom, coalesce(event_type, '0') AS event_type, coalesce(n, 0) AS n FROM p LEFT JOIN c ON p.user_id = c.user_id AND p.dom = c.dom")
def object_panel(spark, sf):
    o = _obs(spark, sf)
    return tables.completed_counts(o.where(F.col("event_type").isin("purchase", "signup")), o, ["user_id", "dom"], "event_type")


@_query(f"WITH {_O} SELECT conf::DOUBLE AS conf, event_type, count(*) AS n FROM o, (SELECT unnest([0.2, 0.5, 0.7, 0.8]) AS conf) WHERE value / 100 >= conf::DOUBLE GROUP BY 1, 2")
def confidence_sweep(spark, sf):
    o = _obs(spark, sf).withColumn("c", F.col("value") / 100)
    return tables.threshold_sweep(o, "c", [0.2, 0.5, 0.7, 0.8]).groupBy("conf", "event_type").agg(F.count("*").alias("n"))


@_query(f"WITH {_O} SELECT user_id, round(count(*) FILTER (event_type = 'purchase')::DOUBLE / nullif(count(*) FILTER (event_type = 'click'), 0), 6) AS ratio, round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END), 6) AS presence FROM o GROUP BY 1")
def exposure_ratio(spark, sf):
    o = _obs(spark, sf)
    t = lambda x: F.count_if(F.col("event_type") == x)
    return _rounded(o.groupBy("user_id").agg(F.try_divide(t("purchase").cast("double"), t("click")).alias("ratio"), F.avg((F.col("event_type") == "view").cast("double")).alias("presence")))


_PER = "b AS (SELECT user_id, CASE WHEN dom <= 10 THEN 'a' WHEN dom <= 20 THEN 'b' ELSE 'c' END AS period, value FROM o)"


@_query(f"WITH {_O}, {_PER}, s AS (SELECT user_id, sum(value) FILTER (period = 'a') AS a, sum(value) FILTER (period = 'c') AS c FROM b GROUP BY 1) SELECT user_id, round(ln(c + 1) - ln(a + 1), 6) AS diff FROM s WHERE a IS NOT NULL AND c IS NOT NULL")
def log_change(spark, sf):
    o = _obs(spark, sf).withColumn("period", F.when(F.col("dom") <= 10, "a").when(F.col("dom") <= 20, "b").otherwise("c"))
    return _rounded(tables.log_change(o, "user_id", "period", "a", "c", "value"))


@_query(f"WITH {_O} SELECT user_id, count(*) AS n FROM o WHERE user_id IN (SELECT user_id FROM o GROUP BY 1 HAVING count(DISTINCT dom) = 29) GROUP BY 1")
def balanced_panel(spark, sf):
    return tables.balanced(_obs(spark, sf), "user_id", "dom", 29).groupBy("user_id").agg(F.count("*").alias("n"))


@_query(f"WITH {_O}, c AS (SELECT day, event_type, count(*) AS n FROM o GROUP BY 1, 2), s AS (SELECT unnest(generate_series((SELECT min(day) FROM c)::TIMESTAMP, (SELECT max(day) FROM c)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day) SELECT CAST(s.day AS VARCHAR) AS day, t.event_type, coalesce(n, 0) AS n FROM s CROSS JOIN (SELECT DISTINCT event_type FROM c) t LEFT JOIN c ON c.day = s.day AND c.event_type = t.event_type")
def daily_resample(spark, sf):
    return tables.daily_spine(_obs(spark, sf), "day", "event_type").withColumn("day", F.col("day").cast("string"))


@_query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2")
def daily_alerts(spark, sf):
    (e,) = read(spark, sf, "events")
    return daily_counts(e.withColumnsRenamed({"event_id": "uuid", "event_type": "type"})).withColumn("day", F.col("day").cast("string"))


@_query(f"WITH {_O}, c AS (SELECT user_id, event_type, count(*) AS n FROM o GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM c) SELECT user_id, event_type, n, round(p, 6) AS share, round(-sum(p * ln(p)) OVER (PARTITION BY user_id) / ln(5), 6) AS diversity FROM s")
def composition(spark, sf):
    return _rounded(tables.composition(_obs(spark, sf), "user_id", "event_type", 5))


_CONF = f"WITH {_O}, t AS (SELECT user_id % 20 AS cell, event_id % 5 AS truth, CASE WHEN event_id % 3 = 0 THEN (event_id + user_id) % 5 ELSE event_id % 5 END AS guess FROM o), g AS (SELECT cell, guess, count(*) AS n, count(*) FILTER (guess <> truth) AS wrong, count(*) FILTER (guess = truth) AS ok FROM t GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY cell) AS total, sum(ok) OVER (PARTITION BY cell) AS rt, rank() OVER (PARTITION BY cell ORDER BY n DESC) AS r, row_number() OVER (PARTITION BY cell ORDER BY wrong DESC, guess) AS w FROM g)"


@_query(_CONF + " SELECT a.cell, a.guess AS top_guess, round(a.n / a.total, 6) AS top_share, round(a.rt / a.total, 6) AS correct_share, b.guess AS top_false, round(b.wrong / b.total, 6) AS false_share FROM r a LEFT JOIN r b ON a.cell = b.cell AND b.w = 1 AND b.wrong > 0 WHERE a.r = 1")
def confusion_by_cell(spark, sf):
    i, u = F.col("event_id"), F.col("user_id")
    t = _obs(spark, sf).select((u % 20).alias("cell"), (i % 5).alias("truth"), F.when(i % 3 == 0, (i + u) % 5).otherwise(i % 5).alias("guess"))
    return _rounded(tables.confusion_by_cell(t, "cell", "truth", "guess"))


@_query("SELECT s_suppkey, (rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2)::DECIMAL(20, 1)::DOUBLE AS x FROM (SELECT s_suppkey, s_suppkey % 7 AS b FROM supplier)".replace("AS x FROM", "AS rank_ FROM").replace("SELECT s_suppkey, (rank", "SELECT s_suppkey, floor(rank").replace(")::DECIMAL(20, 1)::DOUBLE AS rank_", ")::INTEGER AS rank"))
def average_rank(spark, sf):
    (s,) = read(spark, sf, "supplier")
    return tables.average_rank(s.select("s_suppkey", (F.col("s_suppkey") % 7).alias("b")), "b").select("s_suppkey", "rank")


@_query("WITH q AS (SELECT quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM customer) SELECT c_custkey, len(list_filter(e, lambda x: x < c_acctbal))::INTEGER AS bin FROM customer, q")
def quantile_bins(spark, sf):
    (c,) = read(spark, sf, "customer")
    return tables.quantile_bins(c, "c_acctbal", 10).select("c_custkey", "bin")


@_query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER w) / nullif(max(c_acctbal) OVER w - min(c_acctbal) OVER w, 0), 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def min_max_profiles(spark, sf):
    (c,) = read(spark, sf, "customer")
    return _rounded(tables.min_max(c, "c_acctbal", "c_nationkey", "scaled").select("c_custkey", "scaled"))


@_query("SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS p_retailprice FROM part")
def standardised(spark, sf):
    (p,) = read(spark, sf, "part")
    return _rounded(clusters.standard_scores(p.select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


@_query(" UNION ALL ".join(f"SELECT '{c}' AS variable, count({c}) AS n, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(min({c})::DOUBLE, 3) AS min, round(max({c})::DOUBLE, 3) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")))
def describe_table(spark, sf):
    (l,) = read(spark, sf, "lineitem")
    return tables.describe(l, ["l_quantity", "l_extendedprice", "l_discount"])


@_query("SELECT c_custkey, coalesce(a.v, b.v, 1.0)::DOUBLE AS v, CASE WHEN a.v IS NOT NULL THEN 'segment' WHEN b.v IS NOT NULL THEN 'nation' ELSE 'world' END AS source FROM customer c LEFT JOIN (SELECT c_nationkey AS k, c_mktsegment AS m, count(*)::DOUBLE AS v FROM customer WHERE c_nationkey < 8 GROUP BY 1, 2 HAVING count(*) % 2 = 0) a ON a.k = c_nationkey AND a.m = c_mktsegment LEFT JOIN (SELECT c_nationkey AS k, count(*)::DOUBLE AS v FROM customer WHERE c_nationkey < 16 GROUP BY 1) b ON b.k = c_nationkey")
def fallback_lookup(spark, sf):
    (c,) = read(spark, sf, "customer")
    a = c.where("c_nationkey < 8").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").cast("double").alias("v")).where("v % 2 = 0")
    b = c.where("c_nationkey < 16").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("v"))
    out = tables.fallback_join(c.select("c_custkey", "c_nationkey", "c_mktsegment"), [("segment", a, ["c_nationkey", "c_mktsegment"]), ("nation", b, ["c_nationkey"])], "v")
    return out.select("c_custkey", F.coalesce("v", F.lit(1.0)).alias("v"), F.coalesce("source", F.lit("world")).alias("source"))


@_query("SELECT p_partkey, (SELECT min(n_name) FROM nation WHERE contains(upper(p_name || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'CHINA FRANCE' ELSE '' END), n_name)) AS n_name FROM part")
def first_contained_name(spark, sf):
    p, n = read(spark, sf, "part", "nation")
    named = p.select("p_partkey", F.upper(F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, "CHINA FRANCE").otherwise(""))).alias("name"))
    return tables.first_contained(named, "name", n, "n_name").select("p_partkey", "n_name")


@_query("SELECT n_nationkey, n_name, r_name, c.n AS customers, s.n AS suppliers, round(c.b, 2) AS balance FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey AS k, count(*) AS n, sum(c_acctbal) AS b FROM customer GROUP BY 1) c ON c.k = n_nationkey LEFT JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON s.k = n_nationkey")
def star_merge(spark, sf):
    n, r, c, s = read(spark, sf, "nation", "region", "customer", "supplier")
    base = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    cs = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    ss = s.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    return tables.star_merge(base, "n_nationkey", [cs, ss])


@_query("SELECT n_name, round(100000.0 * o.n / c.n, 6) AS rate FROM nation JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c ON c.k = n_nationkey JOIN (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1) o ON o.k = n_nationkey")
def rates_per_100k(spark, sf):
    n, c, o = read(spark, sf, "nation", "customer", "orders")
    people = c.groupBy("c_nationkey").agg(F.count("*").alias("p"))
    cases = o.where("o_totalprice > 100000").join(c, o["o_custkey"] == c["c_custkey"]).groupBy("c_nationkey").agg(F.count("*").alias("q"))
    return _rounded(n.join(people, n["n_nationkey"] == people["c_nationkey"]).drop("c_nationkey").join(cases, F.col("n_nationkey") == cases["c_nationkey"]).select("n_name", F.try_divide(F.col("q") * 100000.0, F.col("p")).alias("rate")))


_FACTORS = ("l_linenumber", "l_linestatus", "l_returnflag")
_SUBSETS = [[f for i, f in enumerate(_FACTORS) if mask >> i & 1] for mask in range(1, 8)]
_R2 = " UNION ALL ".join(f"SELECT '{','.join(x)}' AS s, sum(n * pow(a - m, 2)) / any_value(t) AS r FROM (SELECT count(*) AS n, avg(l_quantity) AS a FROM lineitem GROUP BY {', '.join(x)}), g" for x in _SUBSETS)
_GAIN = " UNION ALL ".join(
    f"SELECT '{f}' AS factor, " + " + ".join(f"{1 / 3 if len(o) != 1 else 1 / 6} * ((SELECT r FROM s WHERE s = '{','.join(sorted([*o, f]))}') - coalesce((SELECT r FROM s WHERE s = '{','.join(o)}'), 0))" for o in ([], *([y] for y in _FACTORS if y != f), [y for y in _FACTORS if y != f])) + " AS gain"
    for f in _FACTORS
)


@_query(f"WITH g AS (SELECT avg(l_quantity) AS m, count(*) * var_pop(l_quantity) AS t FROM lineitem), s AS ({_R2}), f AS ({_GAIN}) SELECT factor, round(100 * gain / sum(gain) OVER (), 6) AS percent FROM f")
def shapley_shares(spark, sf):
    """The parts that three factors have in the variance of a line's quantity between their groups."""
    (l,) = read(spark, sf, "lineitem")
    whole = l.agg(F.avg("l_quantity").alias("m"), (F.count("*") * F.var_pop("l_quantity")).alias("t"))
    rows = spark.createDataFrame([("", 0.0)], "subset string, r2 double")
    for x in _SUBSETS:
        means = l.groupBy(*x).agg(F.count("*").alias("n"), F.avg("l_quantity").alias("a")).join(F.broadcast(whole))
        rows = rows.unionByName(means.agg(F.lit(",".join(x)).alias("subset"), (F.sum(F.col("n") * F.pow(F.col("a") - F.col("m"), 2)) / F.first("t")).alias("r2")))
    return _rounded(tables.shapley_r2(rows, list(_FACTORS)))


@_query("SELECT s_nationkey, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY 1")
def ordered_lists(spark, sf):
    (s,) = read(spark, sf, "supplier")
    return s.groupBy("s_nationkey").agg(F.concat_ws(",", F.array_sort(F.collect_set("s_name"))).alias("names"))


@_query(f"WITH {_O}, d AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM o) SELECT user_id, event_type, event_id FROM d WHERE r = 1")
def first_of_duplicates(spark, sf):
    return cells.first_per_group(_obs(spark, sf), ["user_id", "event_type"], ["event_id"], 1).select("user_id", "event_type", "event_id")


@_query("SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1994 THEN '1992-1994' WHEN year(o_orderdate) IN (1995, 1996) THEN '1995-1996' ELSE 'later' END AS year_group, (year(o_orderdate) // 3 * 3)::INTEGER AS bin FROM orders WHERE year(o_orderdate) <> 1997 AND year(o_orderdate) BETWEEN 1993 AND 1998")
def year_groups(spark, sf):
    (o,) = read(spark, sf, "orders")
    y = F.year("o_orderdate")
    group = F.when(y <= 1994, "1992-1994").when(y.isin(1995, 1996), "1995-1996").otherwise("later")
    return o.where((y != 1997) & y.between(1993, 1998)).select("o_orderkey", group.alias("year_group"), (F.floor(y / 3) * 3).cast("int").alias("bin"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity >= 10 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 3)")
def images_with_three_labels(spark, sf):
    (l,) = read(spark, sf, "lineitem")
    large = l.where("l_quantity >= 10")
    rich = large.groupBy("l_orderkey").agg(F.countDistinct("l_returnflag").alias("n")).where("n >= 3").select("l_orderkey")
    return large.join(rich, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@_query("SELECT event_id, event_type, CASE WHEN contains(lower(event_type), 'click') OR contains(lower(event_type), 'view') THEN 'browse' WHEN event_type = 'purchase' THEN 'buy' ELSE 'other' END AS kind FROM events WHERE regexp_matches(event_type, '(?i)CLICK|sign') OR event_type IN ('purchase')")
def keyword_classes(spark, sf):
    (e,) = read(spark, sf, "events")
    t = F.lower("event_type")
    kind = F.when(t.contains("click") | t.contains("view"), "browse").when(F.col("event_type") == "purchase", "buy").otherwise("other")
    return e.where(F.col("event_type").rlike("(?i)CLICK|sign") | F.col("event_type").isin("purchase")).select("event_id", "event_type", kind.alias("kind"))


@_query("SELECT 'l_quantity' AS variable, sum(l_quantity) AS total FROM lineitem UNION ALL SELECT 'l_tax', round(sum(l_tax), 2) FROM lineitem")
def melted(spark, sf):
    (l,) = read(spark, sf, "lineitem")
    long = l.select("l_quantity", "l_tax").unpivot([], ["l_quantity", "l_tax"], "variable", "x")
    return long.groupBy("variable").agg(F.round(F.sum("x"), 2).alias("total"))


@_query(f"WITH {_O} SELECT min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat, bool_and(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) AS valid FROM o")
def bounds(spark, sf):
    ok = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    return _obs(spark, sf).agg(F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.bool_and(ok).alias("valid"))


_FLOWS = "t AS (SELECT c_nationkey AS a, s_nationkey AS b, sum(l_quantity)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def _flows(spark, sf) -> DataFrame:
    lines, orders, customers, suppliers = read(spark, sf, "lineitem", "orders", "customer", "supplier")
    found = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return found.groupBy(F.col("c_nationkey").alias("a"), F.col("s_nationkey").alias("b")).agg(F.sum("l_quantity").cast("double").alias("weight"))


@_query(f"WITH {_FLOWS}, g AS (SELECT x.n_regionkey AS ca, y.n_regionkey AS cb, weight FROM t JOIN nation x ON a = x.n_nationkey JOIN nation y ON b = y.n_nationkey), d AS (SELECT c, sum(weight) AS k FROM (SELECT ca AS c, weight FROM g UNION ALL SELECT cb, weight FROM g) GROUP BY c), m AS (SELECT sum(weight) AS m FROM g) SELECT round((SELECT sum(weight) FROM g WHERE ca = cb) / m - (SELECT sum(k * k) FROM d) / (4 * m * m), 6) AS modularity FROM m")
def region_modularity(spark, sf):
    (nations,) = read(spark, sf, "nation")
    return _rounded(graphs.modularity(_flows(spark, sf), nations.select("n_nationkey", "n_regionkey")))


@_query(f"WITH {_FLOWS} SELECT a, b, weight, round(weight / sum(weight) OVER (PARTITION BY a), 6) AS share FROM t")
def flow_shares(spark, sf):
    return _rounded(graphs.relation_shares(_flows(spark, sf)).select("a", "b", "weight", "share"))


_BOX = "k.lon AS x0, k.lat AS y0, k.lon + 3 AS x1, k.lat + 2 AS y1"


def _boxes(spark, sf, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    box = lambda x, y, w, h: regions.box_ring(x, y, x + w, y + h)
    k = events.select(F.col("event_id").alias("id"), box(F.col("lon"), F.col("lat"), 3, 2).alias("ring"))
    (suppliers,) = read(spark, sf, "supplier")
    key = F.col("s_suppkey")
    s = suppliers.select(key.alias("id"), box((key * 53 % 340) - F.lit(170.0), (key * 29 % 160) - F.lit(80.0), 5.5, 4.5).alias("ring"))
    return k, s


@_query(f"WITH {_O}, b AS (SELECT event_id AS id, lon AS x0, lat AS y0, lon + 3 AS x1, lat + 2 AS y1 FROM o), s AS (SELECT s_suppkey AS id, (s_suppkey * 53 % 340) - 170.0 AS x0, (s_suppkey * 29 % 160) - 80.0 AS y0 FROM supplier) SELECT b.id AS left_id, s.id AS right_id FROM b JOIN s ON b.x0 <= s.x0 + 5.5 AND s.x0 <= b.x1 AND b.y0 <= s.y0 + 4.5 AND s.y0 <= b.y1")
def all_boxes_that_meet(spark, sf):
    """The boxes of all events."""
    return regions.intersecting(*_boxes(spark, sf, _obs(spark, sf)))
