"""Registered queries of joins between relations and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import features, text
from plumbline.operators import linking, ranking, spatial

from .catalogue import _r, query, table


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_returnflag = 'N'")
def features_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of runs in one state."""
    runs = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.join(runs, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")


@query("""
SELECT l_partkey, l_orderkey FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber) AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') WHERE rn = 1
""")
def latest_artifact_of_done_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest artifact of each kind whose run succeeded."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_shipdate", "l_linenumber")
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    found = linking.latest_done(lines, runs, "l_orderkey", ["l_partkey"], F.col("o_orderstatus") == "F", [F.desc("l_shipdate"), F.desc("l_orderkey"), F.asc("l_linenumber")])
    return found.select("l_partkey", "l_orderkey")


@query("SELECT o_custkey, CAST(sum(l_suppkey) AS BIGINT) AS bytes, count(*) AS artifacts FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' GROUP BY o_custkey")
def artifact_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and number of each owner's live artifacts: added up by run before they meet their owner."""
    by_run = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.sum("l_suppkey").alias("b"), F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = by_run.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_custkey").agg(F.sum("b").alias("bytes"), F.sum("n").alias("artifacts"))


@query("SELECT o_orderkey, count(*) AS received, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS detections FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderkey")
def received_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles and detections that have come in for each run."""
    runs = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("received"), F.count_if(F.col("l_returnflag") == "R").alias("detections"))
    return runs.join(counts, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("""
SELECT c_custkey, o_orderkey, n_name FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' JOIN nation ON n_nationkey = c_nationkey AND n_regionkey = 1
""")
def join_with_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables with constants in the join conditions, which Spark pushes to the scans."""
    customer, orders, nation = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    two = customer.join(orders, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "P"))
    return two.join(nation, (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("n_regionkey") == 1)).select("c_custkey", "o_orderkey", "n_name")


@query("""
SELECT name, a, b FROM (SELECT p_name AS name, min(p_partkey) AS a FROM part WHERE p_size > 20 GROUP BY p_name) JOIN (SELECT p_name AS name, max(p_partkey) AS b FROM part WHERE p_size < 30 GROUP BY p_name) USING (name)
""")
def common_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two sides name alike."""
    part = table(spark, sf_dir, "part")
    left = part.where("p_size > 20").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("a"))
    right = part.where("p_size < 30").groupBy(F.col("p_name").alias("name")).agg(F.max("p_partkey").alias("b"))
    return linking.common_names(left, right, "name")


@query("""
WITH r AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS rank, count(*) OVER () AS n FROM supplier),
d AS (SELECT i AS draw, CAST('0x' || substr(md5('3:a:' || i), 1, 12) AS BIGINT) % n AS pa, CAST('0x' || substr(md5('3:b:' || i), 1, 12) AS BIGINT) % n AS pb FROM range(0, 500) t(i), (SELECT count(*) AS n FROM supplier))
SELECT draw, a.s_suppkey AS a, b.s_suppkey AS b FROM d JOIN r a ON pa = a.rank JOIN r b ON pb = b.rank WHERE pa <> pb
""")
def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred seeded draws of two suppliers."""
    rows = ranking.global_rank(table(spark, sf_dir, "supplier").select("s_suppkey"), [F.asc("s_suppkey")], "rank").withColumn("rank", F.col("rank") - 1)
    return linking.sampled_pairs(rows, "s_suppkey", rows.count(), 500, 3)


@query("SELECT round(max(sqrt(pow(a.s_acctbal - b.s_acctbal, 2) + pow(100.0 * a.s_nationkey - 100.0 * b.s_nationkey, 2))), 4) AS diameter FROM supplier a, supplier b")
def farthest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest distance of two suppliers."""
    at = table(spark, sf_dir, "supplier").select("s_acctbal", (F.col("s_nationkey") * 100.0).alias("y"))
    return linking.farthest_pair(at, "s_acctbal", "y").select(_r(F.col("diameter")).alias("diameter"))


@query("""
WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey * 400 AS DOUBLE) AS y FROM supplier),
n AS (SELECT a.id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id)
SELECT id AS s_suppkey, round(least(200.0, greatest(1.0, avg(d) / 2)), 4) AS scale FROM n WHERE rank <= 2 GROUP BY id
""")
def two_neighbour_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the mean distance of the two nearest neighbours, within limits."""
    at = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 400).cast("double").alias("y"))
    near = spatial.k_nearest(at, "s_suppkey", "s_acctbal", "y", 2, 500.0)
    scale = F.least(F.lit(200.0), F.greatest(F.lit(1.0), F.avg("distance") / 2))
    return near.groupBy(F.col("a").alias("s_suppkey")).agg(_r(scale).alias("scale"))


@query("""
WITH f AS (SELECT DISTINCT p_brand, p_partkey, p_retailprice FROM part WHERE p_size > 47), o AS (SELECT p_brand, p_partkey, p_size AS d FROM part),
r AS (SELECT p_brand, p_partkey, 0 AS tier, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS k FROM f
      UNION ALL SELECT p_brand, p_partkey, 1, row_number() OVER (PARTITION BY p_brand ORDER BY d, p_partkey) FROM o WHERE p_partkey NOT IN (SELECT p_partkey FROM f))
SELECT p_brand, p_partkey, tier, place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY tier, k) AS place FROM r) WHERE place <= 8
""")
def filled_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of each brand by price, then the rest by distance up to eight."""
    part = table(spark, sf_dir, "part")
    first = part.where("p_size > 47").select("p_brand", "p_partkey", "p_retailprice")
    others = part.select("p_brand", "p_partkey", F.col("p_size").alias("d"))
    return linking.filled_by_distance(first, others, "p_brand", "p_partkey", [F.asc("p_retailprice"), F.asc("p_partkey")], "d", 8)


@query("""
WITH b AS (SELECT p_partkey, p_retailprice AS depth, (p_size - 3) / 8.0 AS x0, (p_size + 3) / 8.0 AS x1, (p_partkey % 40 - 2) / 8.0 AS y0, (p_partkey % 40 + 2) / 8.0 AS y1 FROM part),
t AS (SELECT i AS tx, j AS ty FROM range(0, 6) a(i), range(0, 4) c(j))
SELECT ty * 6 + tx AS tile, p_partkey, row_number() OVER (PARTITION BY ty * 6 + tx ORDER BY depth, p_partkey) AS place FROM b JOIN t ON tx BETWEEN floor(x0) AND floor(x1) AND ty BETWEEN floor(y0) AND floor(y1)
""")
def tile_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes dealt to the tiles they cover, in depth order."""
    row = F.col("p_partkey") % 40
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("depth"), ((F.col("p_size") - 3) / 8).alias("x0"), ((F.col("p_size") + 3) / 8).alias("x1"), ((row - 2) / 8).alias("y0"), ((row + 2) / 8).alias("y1"))
    return linking.tile_intervals(part, "p_partkey", F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), 6, 4, "depth")


@query("""
WITH c AS (SELECT n_nationkey AS id, n_nationkey % 5 * 10.0 AS w, n_nationkey // 5 * 8.0 AS s, n_nationkey % 5 * 10.0 + 10.0005 AS e, n_nationkey // 5 * 8.0 + 8 AS n FROM nation),
p AS (SELECT a.id AS a, b.id AS b, 'x' AS axis FROM c a JOIN c b ON a.id <> b.id AND abs(a.e - b.w) <= 0.001 AND least(a.n, b.n) - greatest(a.s, b.s) > 0.001
      UNION ALL SELECT a.id, b.id, 'y' FROM c a JOIN c b ON a.id <> b.id AND abs(a.n - b.s) <= 0.001 AND least(a.e, b.e) - greatest(a.w, b.w) > 0.001)
SELECT a, b, min(axis) AS axis FROM p GROUP BY a, b
""")
def shared_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in a grid of cells."""
    k = F.col("n_nationkey")
    west, south = k % 5 * 10.0, F.floor(k / 5) * 8.0
    cells = table(spark, sf_dir, "nation").select(k.alias("id"), west.alias("w"), south.alias("s"), (west + 10.0005).alias("e"), (south + 8).alias("n"))
    return linking.shared_edges(cells, "id", ("w", "s", "e", "n"), 0.001)


@query("SELECT max(low) AS low, min(high) AS high, max(low) >= min(high) AS empty FROM (SELECT p_brand, quantile_cont(p_retailprice, 0.1) AS low, quantile_cont(p_retailprice, 0.9) AS high FROM part GROUP BY p_brand)")
def common_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all brands' price ranges have in common."""
    from plumbline.operators import statistics

    ranges = statistics.quantiles(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_retailprice"), {"low": ("linear", 0.1), "high": ("linear", 0.9)})
    return linking.common_bounds(ranges, ["low"], ["high"])


@query("""
WITH a AS (SELECT c_custkey AS id, 40 + c_custkey % 7 AS lat, 2 + c_custkey % 5 AS lon, c_acctbal AS alt, c_nationkey / 10.0 AS sigma FROM customer),
b AS (SELECT c_custkey AS id, 40 + c_custkey % 7 + (c_custkey % 11) * 0.000002 AS lat, 2 + c_custkey % 5 AS lon, c_acctbal + (c_custkey % 13) / 2.0 AS alt FROM customer),
d AS (SELECT a.id, 2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS h, abs(a.alt - b.alt) AS v, sigma FROM a JOIN b USING (id))
SELECT id, round(h, 3) AS horizontal_m, round(v, 3) AS vertical_m, h <= greatest(0.25, 6 * sigma) AND v <= greatest(0.5, 6 * sigma) AS agrees FROM d
""")
def validated_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from two sources that agree or do not."""
    k = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    a = customer.select(k.alias("id"), (40 + k % 7).alias("lat"), (2 + k % 5).alias("lon"), F.col("c_acctbal").alias("alt"), (F.col("c_nationkey") / 10.0).alias("sigma"))
    b = customer.select(k.alias("id"), (40 + k % 7 + (k % 11) * 0.000002).alias("lat"), (2 + k % 5).alias("lon"), (F.col("c_acctbal") + (k % 13) / 2.0).alias("alt"))
    found = linking.validated_positions(a, b, "id")
    return found.select("id", _r(F.col("horizontal_m"), 3).alias("horizontal_m"), _r(F.col("vertical_m"), 3).alias("vertical_m"), "agrees")


@query("SELECT p_partkey, backend, repetition FROM part, (VALUES ('cpu'), ('gpu')) b(backend), (SELECT CAST(i AS INT) AS repetition FROM range(1, 4) t(i)) WHERE p_size = 50")
def case_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases, backends and repetitions."""
    return linking.case_matrix(table(spark, sf_dir, "part").where("p_size = 50").select("p_partkey"), ["cpu", "gpu"], 3)


@query("""
SELECT o_orderkey, coalesce(c.org, nullif(CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'own' END, ''), 'legacy') AS org FROM orders LEFT JOIN (SELECT c_custkey, min(c_mktsegment) AS org FROM customer WHERE c_acctbal > 5000 GROUP BY 1) c ON o_custkey = c.c_custkey
""")
def filled_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners from a related row, the row itself or a default."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "").otherwise("own").alias("org"))
    owners = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return linking.filled_owner(orders, "c_custkey", owners, "segment", "org", "legacy").select("o_orderkey", "org")


@query("""
WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderpriority < '4'), b AS (SELECT o_orderkey AS id, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderpriority > '2')
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'drop' WHEN a.id IS NULL OR a.v IS DISTINCT FROM b.v THEN 'fetch' ELSE 'same' END AS action FROM a FULL JOIN b ON a.id = b.id
""")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client must fetch and drop."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"), "o_orderpriority", "o_totalprice")
    server = orders.where("o_orderpriority > '2'").withColumn("v", F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("v")))
    return linking.revision_diff(orders.where("o_orderpriority < '4'"), server, "id", "v")


@query("""
SELECT 'order' AS origin, o_orderkey AS id, o_orderstatus AS state, NULL AS flag FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'line', l_orderkey * 8 + l_linenumber, NULL, l_returnflag FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT 'part', p_partkey, NULL, NULL FROM part
""")
def scoped_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of three origins in one table; what an origin lacks is null."""
    a = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.lit("order").alias("origin"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    b = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.lit("line").alias("origin"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("flag"))
    c = table(spark, sf_dir, "part").select(F.lit("part").alias("origin"), F.col("p_partkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@query("SELECT n_regionkey AS id FROM nation UNION SELECT r_regionkey FROM region UNION SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def all_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids over four tables, made distinct in each before they meet."""
    parts = [("nation", "n_regionkey"), ("region", "r_regionkey"), ("customer", "c_nationkey"), ("supplier", "s_nationkey")]
    found = [table(spark, sf_dir, t).select(F.col(c).alias("id")).distinct() for t, c in parts]
    return found[0].union(found[1]).union(found[2]).union(found[3]).distinct()


@query("""
WITH t AS (SELECT p_partkey, [' ' || p_name || ' ', p_brand, p_name, '', p_type || p_type || p_type || p_type || p_type || p_type || p_type || p_type || p_type] AS raw FROM part)
SELECT p_partkey, list_aggregate(list_transform([trim(raw[1]), raw[2], raw[5]], lambda x: substr(x, 1, 64)), 'string_agg', '|') AS tags FROM t
""")
def feature_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags trimmed, made distinct in order and cut."""
    raw = F.array(F.concat(F.lit(" "), "p_name", F.lit(" ")), "p_brand", "p_name", F.lit(""), F.repeat("p_type", F.lit(9)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.tags(raw), "|").alias("tags"))


@query("""
WITH b AS (SELECT n_nationkey AS id, CASE n_nationkey % 6 WHEN 0 THEN '-10,40,10,' || (41 + n_nationkey) WHEN 1 THEN '5,5,1,9' WHEN 2 THEN 'x,1,2,3' WHEN 3 THEN '1,2,3' WHEN 4 THEN '-190,0,10,10' ELSE ' 1.5, 2 ,3,4.25' END AS raw FROM nation)
SELECT id, list_aggregate(list_transform(CASE WHEN id % 6 = 0 THEN [-10.0, 40.0, 10.0, 41.0 + id] WHEN id % 6 = 5 THEN [1.5, 2.0, 3.0, 4.25] END, lambda x: printf('%.3f', x::DOUBLE)), 'string_agg', ',') AS box FROM b
""")
def parsed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from text; what is no box on the globe is null."""
    k = F.col("n_nationkey")
    raw = F.when(k % 6 == 0, F.concat(F.lit("-10,40,10,"), (41 + k).cast("string"))).when(k % 6 == 1, "5,5,1,9").when(k % 6 == 2, "x,1,2,3").when(k % 6 == 3, "1,2,3").when(k % 6 == 4, "-190,0,10,10").otherwise(" 1.5, 2 ,3,4.25")
    box = features.parse_box(raw)
    shown = F.array_join(F.transform(box, lambda x: F.format_string("%.3f", x)), ",")
    return table(spark, sf_dir, "nation").select(k.alias("id"), shown.alias("box"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'POINT (' || printf('%.3f', p_retailprice) || ' ' || printf('%.3f', CAST(p_size AS DOUBLE)) || ')' ELSE 'POLYGON ((' || printf('%.3f', p_retailprice) || ' 0.000, ' || printf('%.3f', CAST(p_size AS DOUBLE)) || ' 1.000, 0.000 5.000, ' || printf('%.3f', p_retailprice) || ' 0.000))' END AS wkt FROM part
""")
def feature_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometries as well-known text; rings are closed."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    price, size = F.col("p_retailprice"), F.col("p_size")
    ring = F.array(point(price, F.lit(0)), point(size, F.lit(1)), point(F.lit(0), F.lit(5)))
    wkt = F.when(size % 3 == 0, features.point_wkt(price, size.cast("double"))).otherwise(features.polygon_wkt(ring))
    return table(spark, sf_dir, "part").select("p_partkey", wkt.alias("wkt"))


@query("""
SELECT p_partkey, round(p_size * p_retailprice / 1000 * 2, 5) AS area, round(p_size / 2.0, 5) AS cx, round(p_retailprice / 1000, 5) AS cy, round(least(p_size, 20.0) * least(p_retailprice / 1000 * 2, 1.5), 5) AS clipped FROM part
""")
def polygon_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area and centroid of rectangles, and their area inside a window."""
    w, h = F.col("p_size").cast("double"), F.col("p_retailprice") / 1000 * 2
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(corner(zero, zero), corner(w, zero), corner(w, h), corner(zero, h)).alias("ring"))
    centre = features.ring_centroid(F.col("ring"))
    from plumbline.functions.geometry import ring_area

    rows = rows.withColumn("clipped", features.clip_ring(F.col("ring"), -1.0, -1.0, 20.0, 1.5))
    return rows.select("p_partkey", _r(ring_area(F.col("ring")), 5).alias("area"), _r(centre["x"], 5).alias("cx"), _r(centre["y"], 5).alias("cy"), _r(ring_area(F.col("clipped")), 5).alias("clipped"))


@query("""
SELECT c_custkey, round(lon * 20037508.342789244 / 180, 2) AS x, round(ln(tan((90 + lat) * pi() / 360)) * 6378137, 2) AS y, round(500000 + 0.5 * col - 0.1 * row, 4) AS px, round(4000000 - 0.2 * col - 0.5 * row, 4) AS py
FROM (SELECT c_custkey, c_custkey % 160 - 80.0 AS lat, c_custkey * 7 % 360 - 180.0 AS lon, c_custkey % 512 AS col, c_nationkey AS row FROM customer)
""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in Web Mercator, and pixels by an affine transform."""
    k = F.col("c_custkey")
    lat, lon = k % 160 - 80.0, k * 7 % 360 - 180.0
    x, y = features.to_web_mercator(lat, lon)
    px, py = features.pixel_to_world((500000.0, 0.5, -0.1, 4000000.0, -0.2, -0.5), (k % 512).cast("double"), F.col("c_nationkey").cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", _r(x, 2).alias("x"), _r(y, 2).alias("y"), _r(px).alias("px"), _r(py).alias("py"))


@query("""
SELECT p_partkey, round(4 * pi() * pow((pow(a * b, 1.6075) + pow(a * c, 1.6075) + pow(b * c, 1.6075)) / 3, 1 / 1.6075), 4) AS area, CAST(floor(b + 1e-9 * greatest(1, abs(b))) AS BIGINT) AS low, CAST(ceil(b - 1e-9 * greatest(1, abs(b))) AS BIGINT) AS high,
       CASE WHEN p_size > 25 THEN round(b - p_size, 4) END AS height FROM (SELECT p_partkey, p_size, p_size / 10.0 AS a, p_retailprice / 100 AS b, 1.5 AS c FROM part)
""")
def shape_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of ellipsoids, floors and ceilings that bear rounding, heights from depths."""
    a, b = F.col("p_size") / 10.0, F.col("p_retailprice") / 100
    depth = F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).otherwise(F.lit(-1.0))
    return table(spark, sf_dir, "part").select(
        "p_partkey", _r(features.ellipsoid_area(a, b, F.lit(1.5))).alias("area"), features.stable_floor(b).alias("low"), features.stable_ceil(b).alias("high"), _r(features.depth_to_height(depth, b)).alias("height")
    )
