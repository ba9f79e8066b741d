"""Registered queries about scenes: prefixes and clocks of their files, lenses and turns, rings, objects found twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import features
from plumbline.operators import detections, matching, relational, spatial, stateful, views

from .catalogue import _r, query, table


@query("""
WITH p AS (
    SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL
), prefixes AS (
    SELECT DISTINCT split_part(path, '/', 1) AS prefix FROM p UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM p WHERE length(path) % 3 = 0 AND path LIKE '%/%'
)
SELECT path, (SELECT arg_max(prefix, length(prefix)) FROM prefixes WHERE path = prefix OR starts_with(path, prefix || '/')) AS prefix FROM p
""")
def longest_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest known folder above each page's path."""
    paths = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path")).distinct()
    parts = F.split("path", "/")
    deeper = paths.where((F.length("path") % 3 == 0) & F.contains("path", F.lit("/"))).select(F.concat_ws("/", parts[0], F.get(parts, 1)).alias("prefix"))
    prefixes = paths.select(parts[0].alias("prefix")).unionByName(deeper).distinct()
    return relational.longest_prefix(paths, "path", prefixes, "prefix").select("path", "prefix")


@query("""
WITH a AS (SELECT user_id, min(ts) AS a FROM events WHERE event_type = 'view' GROUP BY user_id), b AS (SELECT user_id, min(ts) AS b FROM events WHERE event_type = 'click' GROUP BY user_id),
t AS (SELECT user_id, o, abs(epoch(a) - epoch(b) - o * 3600) AS s FROM a JOIN b USING (user_id), range(-14, 15) r(o))
SELECT user_id, CAST(o AS INT) AS offset_hours, round(s, 3) AS seconds FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY s, abs(o), o) = 1
""")
def clock_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hours that bring each user's first click nearest to their first view."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    first = lambda kind: events.where(F.col("event_type") == kind).groupBy("user_id").agg((F.unix_micros(F.min("ts").cast("timestamp")) / 1e6).alias("at"))
    found = matching.clock_offset(first("view"), first("click"), "user_id", "at")
    return found.select("user_id", F.col("offset").alias("offset_hours"), _r(F.col("seconds"), 3).alias("seconds"))


@query("""
WITH q AS (
    SELECT p_partkey AS k, 1.0 + p_size AS w, p_partkey % 7 * 1.0 AS x, p_partkey % 5 * 1.0 AS y, p_partkey % 3 * 1.0 AS z FROM part
), u AS (
    SELECT k, w / n AS w, x / n AS x, y / n AS y, z / n AS z FROM (SELECT *, sqrt(w * w + x * x + y * y + z * z) AS n FROM q)
), l AS (
    SELECT k, CAST(0.1 AS DOUBLE) * (k % 9) AS a, CAST(-0.05 AS DOUBLE) * (k % 11) AS b FROM q
), r AS (
    SELECT *, a * a + b * b AS s FROM l
)
SELECT k, round(1 - 2 * (y * y + z * z), 6) AS m00, round(2 * (x * y - w * z), 6) AS m01, round(2 * (x * z + w * y), 6) AS m02, round(2 * (y * z + w * x), 6) AS m21,
       round(a * (1 + 0.1 * s - 0.02 * s * s), 6) AS radial_x, round(a * (1 + 0.1 * s - 0.02 * s * s) + 2 * 0.01 * a * b - 0.003 * (s + 2 * a * a), 6) AS full_x,
       round(b * (1 + 0.1 * s - 0.02 * s * s) - 2 * 0.003 * a * b + 0.01 * (s + 2 * b * b), 6) AS full_y
FROM u JOIN r USING (k)
""")
def turns_and_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations of quaternions and where two kinds of lenses put a point, for each part."""
    k = F.col("p_partkey")
    m = features.quaternion_matrix(1.0 + F.col("p_size"), k % 7 * 1.0, k % 5 * 1.0, k % 3 * 1.0)
    a, b = 0.1 * (k % 9), -0.05 * (k % 11)
    terms = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    part = table(spark, sf_dir, "part").select(k.alias("k"), m.alias("m"), features.distorted(F.lit("RADIAL"), terms(0.1, -0.02), a, b).alias("r"), features.distorted(F.lit("OPENCV"), terms(0.1, -0.02, 0.01, -0.003), a, b).alias("f"))
    cells = {"m00": 0, "m01": 1, "m02": 2, "m21": 7}
    return part.select("k", *[_r(F.col("m")[i], 6).alias(n) for n, i in cells.items()], _r(F.col("r.x"), 6).alias("radial_x"), _r(F.col("f.x"), 6).alias("full_x"), _r(F.col("f.y"), 6).alias("full_y"))


@query("""
SELECT c_custkey, (x >= 0 AND y >= 0 AND 3 * x + 5 * y <= 90) AS inside FROM (SELECT c_custkey, c_custkey % 41 - 5 AS x, c_custkey % 29 - 4 AS y FROM customer)
""")
def points_in_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer lies in a triangle, its edges included."""
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(corner(0, 0), corner(30, 0), corner(0, 18))
    return table(spark, sf_dir, "customer").select("c_custkey", features.ring_contains(ring, F.col("c_custkey") % 41 - 5.0, F.col("c_custkey") % 29 - 4.0).alias("inside"))


@query("""
WITH r AS (SELECT l_linenumber % 7 AS row, l_suppkey % 50 AS col, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
p AS (SELECT c_custkey, c_custkey % 600 / 10.0 AS x, c_custkey % 90 / 10.0 AS y FROM customer),
f AS (SELECT *, floor(x) AS c, floor(y) AS q FROM p)
SELECT c_custkey, round((x - c) * (y - q) * r11.v + (1 - (x - c)) * (y - q) * r01.v + (x - c) * (1 - (y - q)) * r10.v + (1 - (x - c)) * (1 - (y - q)) * r00.v, 4) AS value
FROM f LEFT JOIN r r00 ON r00.col = c AND r00.row = q LEFT JOIN r r10 ON r10.col = c + 1 AND r10.row = q LEFT JOIN r r01 ON r01.col = c AND r01.row = q + 1 LEFT JOIN r r11 ON r11.col = c + 1 AND r11.row = q + 1
""")
def bilinear_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of mean quantities between its pixels, at each customer."""
    lines = table(spark, sf_dir, "lineitem")
    raster = lines.groupBy((F.col("l_linenumber") % 7).alias("row"), (F.col("l_suppkey") % 50).alias("col")).agg(F.avg("l_quantity").alias("v"))
    at = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 600 / 10.0).alias("x"), (F.col("c_custkey") % 90 / 10.0).alias("y"))
    return spatial.bilinear(at, "x", "y", raster).select("c_custkey", _r(F.col("value")).alias("value"))


@query("""
WITH RECURSIVE e AS (
    SELECT user_id, epoch(ts) AS at, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id FROM events WHERE event_type = 'view'
), d AS (
    SELECT c.*, CASE WHEN p.at IS NOT NULL AND c.at - p.at <= 40000 AND c.at > p.at THEN (c.value - p.value) / (c.at - p.at) END AS v, p.at IS NULL OR c.at - p.at > 40000 OR c.at <= p.at AS starts FROM e c LEFT JOIN e p ON p.user_id = c.user_id AND p.n = c.n - 1
), s AS (
    SELECT user_id, n, event_id, CAST(NULL AS DOUBLE) AS velocity FROM d WHERE n = 1
    UNION ALL
    SELECT d.user_id, d.n, d.event_id, CASE WHEN d.starts THEN NULL WHEN s.velocity IS NULL THEN d.v ELSE s.velocity * 0.4 + d.v * 0.6 END FROM s JOIN d ON d.user_id = s.user_id AND d.n = s.n + 1
)
SELECT user_id, event_id, round(velocity, 8) AS velocity FROM s
""")
def smoothed_velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed rate of change of each user's views, new after half a day."""
    views_ = table(spark, sf_dir, "events").where("event_type = 'view'").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "value")
    found = stateful.smoothed_velocity(views_, "user_id", "at", "value", 0.6, 40_000.0)
    return found.select("user_id", "event_id", _r(F.col("velocity"), 8).alias("velocity"))


@query()
def objects_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which objects are kept where polygons of one class hold each other: rounds over pairs, so without SQL."""
    k, s = F.col("p_partkey"), F.col("p_size") / 10.0
    x, y = (k * 37 % 1009) / 2.0, (k * 91 % 997) / 2.0
    corner = lambda dx, dy: F.struct((x + dx * s).alias("x"), (y + dy * s).alias("y"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1.5, 0.5), corner(-1, 1))
    found = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_brand").alias("class_name"), (F.col("p_retailprice") / 2000).alias("confidence"), ring.alias("ring"), x.alias("x"), y.alias("y"))
    return detections.deduplicated(found, "id", "class_name", "confidence", "ring", "x", "y", near=4.0, iou=0.05).select("id", "kept")


@query()
def camera_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of each camera's image that shows a block of ground, for all suppliers and blocks around all nations: polygons, so without SQL."""
    k = F.col("s_suppkey")
    a, tilt = k % 12 / 4.0, k % 5 / 10.0
    c, s, t, u = F.cos(a), F.sin(a), F.cos(tilt), F.sin(tilt)
    rows = [[c, s, F.lit(0.0)], [s * t, -c * t, -u], [-s * u, c * u, -t]]
    centre = [k % 97 * 10.0, k % 89 * 10.0, 150.0 + k % 20]
    pose = F.array(*[x for r in rows for x in (*r, -sum((r[i] * centre[i] for i in range(3)), F.lit(0.0)))])
    number = lambda v: F.lit(float(v))
    cameras = table(spark, sf_dir, "supplier").select(k.alias("image"), F.lit(1000).cast("long").alias("width"), F.lit(800).cast("long").alias("height"), number(900).alias("fx"), number(900).alias("fy"), number(500).alias("cx"), number(400).alias("cy"), pose.alias("pose"))
    west, south = F.col("n_nationkey") % 5 * 200.0, F.floor(F.col("n_nationkey") / 5) * 200.0
    blocks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("block"), (west - 20).alias("west"), (south - 20).alias("south"), (west + 220).alias("east"), (south + 220).alias("north"))
    found = views.block_crops(cameras, blocks, 0.0, 12.0)
    return found.select("image", "block", "x", "y", "width", "height", _r(F.col("overlap"), 2).alias("overlap"))


@query("""
WITH s AS (SELECT DISTINCT user_id AS run, event_type AS stage FROM events WHERE value > 5),
needs(stage, upstream) AS (VALUES ('search', 'view'), ('click', 'search'), ('purchase', 'click'), ('purchase', 'view')),
given AS (SELECT user_id AS run, event_type AS stage, 'a' || min(event_id) AS artifact FROM events WHERE value > 60 GROUP BY ALL),
m AS (SELECT s.run, s.stage, n.upstream, g.artifact, h.run IS NOT NULL AS here FROM s LEFT JOIN needs n USING (stage) LEFT JOIN given g ON g.run = s.run AND g.stage = n.upstream LEFT JOIN s h ON h.run = s.run AND h.stage = n.upstream),
p AS (SELECT run, stage, CASE WHEN bool_or(here AND artifact IS NULL) THEN 'blocked' ELSE 'queued' END AS status, COALESCE(list_sort(list(artifact) FILTER (artifact IS NOT NULL)), []) AS inputs FROM m GROUP BY run, stage)
SELECT run, stage, status, array_to_string(inputs, ',') AS inputs,
       sha256('{"attempt":0,"inputs":[' || array_to_string(list_transform(inputs, lambda x: '"' || x || '"'), ',') || '],"parameters":"{}","run":"' || run || '","stage":"' || stage || '","version":"1"}') AS idempotency_key FROM p
""")
def stage_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stages of each user can start, what they start from, and the key of the attempt."""
    events = table(spark, sf_dir, "events")
    selected = events.where("value > 5").select(F.col("user_id").alias("run"), F.col("event_type").alias("stage")).distinct().withColumn("parameters", F.lit("{}"))
    needs = spark.createDataFrame([("search", "view"), ("click", "search"), ("purchase", "click"), ("purchase", "view")], "stage string, upstream string")
    given = events.where("value > 60").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("stage")).agg(F.concat(F.lit("a"), F.min("event_id").cast("string")).alias("artifact"))
    return stateful.planned_stages(selected, needs, given, "1").withColumn("inputs", F.array_join("inputs", ","))
