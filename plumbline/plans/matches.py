"""Registered queries of joins with fallbacks, point tables and mutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import graph, matching, points, ranking, raster, relational, sequences, spatial, statistics

from .catalogue import _r, query, table


@query("""
WITH b AS (SELECT p_partkey FROM part), a AS (SELECT p_partkey, p_size AS v FROM part WHERE p_size < 20), c AS (SELECT p_partkey, p_size + 1000 AS v FROM part WHERE p_brand > 'Brand#2')
SELECT p_partkey, coalesce(a.v, c.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'mrk' WHEN c.v IS NOT NULL THEN 'exif' END AS source FROM b LEFT JOIN a USING (p_partkey) LEFT JOIN c USING (p_partkey)
""")
def priority_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's value from the best source that has one."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("v"), "p_brand")
    sources = {"mrk": part.where("v < 20"), "exif": part.where("p_brand > 'Brand#2'").withColumn("v", F.col("v") + 1000)}
    return matching.priority_overlay(part.select("p_partkey"), "p_partkey", sources, "v")


@query("""
WITH l AS (SELECT o_orderkey, o_custkey % 40 AS folder, o_orderkey % 90 AS seq FROM orders), r AS (SELECT s_suppkey % 40 AS folder, s_suppkey * 3 % 90 AS seq, s_suppkey AS mark FROM supplier),
f AS (SELECT folder, seq, min(mark) AS m, count(*) AS n FROM r GROUP BY folder, seq), p AS (SELECT seq, min(mark) AS m, count(*) AS n FROM r GROUP BY seq)
SELECT l.*, CASE WHEN f.n = 1 THEN f.m WHEN f.n IS NULL AND p.n = 1 THEN p.m END AS mark,
       CASE WHEN f.n = 1 THEN 'exact' WHEN f.n > 1 THEN 'ambiguous' WHEN p.n = 1 THEN 'loose' WHEN p.n > 1 THEN 'ambiguous' ELSE 'none' END AS matched
FROM l LEFT JOIN f ON l.folder = f.folder AND l.seq = f.seq LEFT JOIN p ON l.seq = p.seq
""")
def fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match on folder and sequence, else on the sequence alone."""
    left = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 40).alias("folder"), (F.col("o_orderkey") % 90).alias("seq"))
    right = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("folder"), (F.col("s_suppkey") * 3 % 90).alias("seq"), F.col("s_suppkey").alias("mark"))
    return matching.fallback_join(left, right, ["folder", "seq"], ["seq"], "mark")


@query("""
WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT a.user_id, a.event_id AS a, b.event_id AS b, b.p - a.p AS gap FROM p a JOIN p b ON a.user_id = b.user_id AND b.p - a.p BETWEEN 1 AND 2
""")
def temporal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in each user's order."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return matching.temporal_band(events, "user_id", ["ts", "event_id"], "event_id", 2).withColumn("gap", F.col("gap").cast("long"))


@query("""
WITH r AS (SELECT l_orderkey % 60 AS col, l_linenumber AS row, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT p_partkey, p_size * 1.3 AS x, (p_partkey % 97) / 10.0 AS y FROM part)
SELECT p_partkey, round(v, 4) AS value, CASE WHEN NOT (floor(x) BETWEEN 0 AND 59 AND floor(y) BETWEEN 0 AND 7) THEN 'outside' WHEN v IS NULL THEN 'nodata' ELSE 'ok' END AS status
FROM p LEFT JOIN r ON floor(x) = col AND floor(y) = row
""")
def raster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels under points."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    raster = lines.groupBy((F.col("l_orderkey") % 60).alias("col"), F.col("l_linenumber").alias("row")).agg(F.avg("l_quantity").alias("v"))
    at = part.select("p_partkey", (F.col("p_size") * 1.3).alias("x"), ((F.col("p_partkey") % 97) / 10).alias("y"))
    found = matching.raster_lookup(at, F.col("x"), F.col("y"), raster, 60, 8)
    return found.select("p_partkey", _r(F.col("value")).alias("value"), "status")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) % 8 = 0 AS held_out FROM orders
""")
def hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eighth row of an order."""
    return matching.hold_out(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 8)


@query("""
WITH plan AS (SELECT o_orderkey AS run, o_orderkey % 5 + 1 AS n FROM orders), res AS (SELECT l_orderkey AS run, l_linenumber - 1 AS shard FROM lineitem),
g AS (SELECT run, count(*) AS k FROM res GROUP BY run), m AS (SELECT p.run, count(*) AS missing FROM (SELECT run, unnest(range(0, n)) AS s FROM plan) p WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.run = p.run AND res.shard = p.s) GROUP BY p.run)
SELECT plan.run, n AS n_shards, coalesce(k, 0) AS n_results, coalesce(missing, 0) AS n_missing, coalesce(missing, 0) = 0 AND coalesce(k = n, false) AS complete FROM plan LEFT JOIN g USING (run) LEFT JOIN m USING (run)
""")
def shard_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs have all of their shards."""
    plan = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderkey") % 5 + 1).alias("n_shards"))
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), (F.col("l_linenumber") - 1).cast("long").alias("shard"))
    found = matching.fan_in(plan, results, "run", "shard")
    return found.select("run", "n_shards", "n_results", F.size("missing").cast("long").alias("n_missing"), F.coalesce("complete", F.lit(False)).alias("complete"))


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE greatest(ln(l_quantity), ln(l_discount + 0.5)) <= ln(40.0) AND l_tax > ln(0.51 / 0.49) AND exp(greatest(ln(l_quantity), ln(l_discount + 0.5)) - least(ln(l_quantity), ln(l_discount + 0.5))) <= 60
""")
def splat_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points small, opaque and round enough."""
    lines = table(spark, sf_dir, "lineitem").withColumn("s0", F.log("l_quantity")).withColumn("s1", F.log(F.col("l_discount") + 0.5))
    return lines.where(points.visible(["s0", "s1"], "l_tax", 40.0, 0.51, 60.0)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey * 400 AS DOUBLE) AS y FROM supplier),
n AS (SELECT a.id AS a, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS rank FROM p a JOIN p b ON a.id <> b.id),
m AS (SELECT a, avg(d) AS d FROM n WHERE rank <= 6 GROUP BY a)
SELECT a AS s_suppkey FROM m WHERE d <= (SELECT avg(d) + 0.5 * stddev_pop(d) FROM m)
""")
def outlier_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose neighbours are not unusually far."""
    at = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 400).cast("double").alias("y"))
    near = spatial.k_nearest(at, "s_suppkey", "s_acctbal", "y", 6, 1000.0)
    return points.outliers_removed(at.select("s_suppkey"), "s_suppkey", near, 0.5)


@query("""
WITH c(cell, w, e) AS (VALUES ('a', 0.0, 20.0), ('b', 15.0, 40.0), ('c', 35.0, 60.0)),
m AS (SELECT p_partkey, cell, greatest(1e-9, least(1.0, greatest(0.0, least(p_size - w, e - p_size) / 5.0))) AS wt FROM part JOIN c ON p_size BETWEEN w AND e)
SELECT p_partkey, cell, round(wt / sum(wt) OVER (PARTITION BY p_partkey), 6) AS weight FROM m
""")
def feathered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of rows in overlapping cells."""
    cells = spark.createDataFrame([("a", 0.0, 20.0), ("b", 15.0, 40.0), ("c", 35.0, 60.0)], "cell string, west double, east double")
    cells = cells.withColumns({"south": F.lit(-1e6), "north": F.lit(1e6)})
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.lit(0.0).alias("y"))
    found = points.feathered_weights(part, "p_partkey", "p_size", "y", cells, 5.0)
    return found.select("p_partkey", "cell", _r(F.col("weight"), 6).alias("weight"))


@query("""
WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT p_partkey, CAST(round_even((p_retailprice - lo) / (hi - lo) * 65535, 0) AS INT) AS q FROM part, e
""")
def quantised_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column in 16 bits over its range."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("q"))
    return points.quantised(part, ["q"]).select("p_partkey", "q")


@query()
def spatial_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of a binary tree over points."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return points.split_tree(part, "p_partkey", ["x", "y"], 128).select("p_partkey", "node")


@query("""
WITH r AS (SELECT l_orderkey % 60 AS col, l_linenumber AS row, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
s AS (SELECT col, abs(v - lag(v) OVER (PARTITION BY row ORDER BY col)) AS step FROM r)
SELECT round(avg(CASE WHEN col = 30 THEN step END), 4) AS seam_mean, round(quantile_cont(CASE WHEN col = 30 THEN step END, 0.95), 4) AS seam_p95, round(avg(CASE WHEN col <> 30 THEN step END), 4) AS interior_mean,
       round(avg(CASE WHEN col = 30 THEN step END) / avg(CASE WHEN col <> 30 THEN step END), 4) AS ratio FROM s WHERE step IS NOT NULL
""")
def seam_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps across a seam against steps elsewhere."""
    lines = table(spark, sf_dir, "lineitem")
    raster = lines.groupBy((F.col("l_orderkey") % 60).alias("col"), F.col("l_linenumber").alias("row")).agg(F.avg("l_quantity").alias("v"))
    found = points.seam_ratio(raster, 30)
    return found.select(*[_r(F.col(c)).alias(c) for c in found.columns])


@query("""
SELECT c_mktsegment, count(*) AS n, round(sum(x) / count(*), 4) AS mean_x, round(var_pop(x), 3) AS var_x, round(covar_pop(x, y), 3) AS cov_xy, round(var_pop(y), 3) AS var_y
FROM (SELECT c_mktsegment, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer) GROUP BY c_mktsegment
""")
def scatter_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second moments of each group's points."""
    at = table(spark, sf_dir, "customer").select("c_mktsegment", (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return at.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), _r(F.avg("x")).alias("mean_x"), _r(F.var_pop("x"), 3).alias("var_x"), _r(F.covar_pop("x", "y"), 3).alias("cov_xy"), _r(F.var_pop("y"), 3).alias("var_y")
    )


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderstatus AS payload, CAST(NULL AS BIGINT) AS deleted_by FROM orders WHERE o_orderstatus <> 'P'),
n AS (SELECT o_orderkey AS id, 'new' AS payload FROM orders WHERE o_totalprice > 250000)
SELECT id, payload, CASE WHEN id IN (SELECT id FROM n) THEN CAST(2 AS BIGINT) ELSE deleted_by END AS deleted_by, 1 AS generation FROM o UNION ALL SELECT id, payload, NULL, 2 FROM n
""")
def refresh_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new generation of rows: old ones are marked as deleted by it, not removed."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("payload"), F.lit(None).cast("long").alias("deleted_by"), F.lit(1).alias("generation"))
    new = orders.where("o_totalprice > 250000").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("payload"))
    return relational.refresh_generation(old, new, "id", 2)


@query("""
SELECT event_id, step, at_us FROM (SELECT event_id, unnest(['created', 'started', 'done']) AS step, unnest([epoch_us(ts), CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) + 5 END, CASE WHEN event_id % 6 = 0 THEN epoch_us(ts) + 9 END]) AS at_us FROM events) WHERE at_us IS NOT NULL
""")
def lifecycle_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log row for each time that is set."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    events = table(spark, sf_dir, "events").select(
        "event_id", at.alias("created"), F.when(F.col("event_id") % 2 == 0, at + 5).alias("started"), F.when(F.col("event_id") % 6 == 0, at + 9).alias("done")
    )
    return sequences.lifecycle_log(events, "event_id", ["created", "started", "done"]).withColumnRenamed("at", "at_us")


@query("""
SELECT count(*) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_pop(x), 4) AS std, round(sqrt(avg(x * x)), 4) AS rmse, round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.95), 4) AS p95,
       round(min(x), 4) AS min, round(max(x), 4) AS max FROM (SELECT c_acctbal AS x FROM customer WHERE c_acctbal > 1e12)
""")
def describe_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of no rows: one row of nulls and a count of 0."""
    found = statistics.describe(table(spark, sf_dir, "customer").where("c_acctbal > 1e12"), [], F.col("c_acctbal"))
    return found.select("n", *[_r(F.col(c)).alias(c) for c in found.columns if c != "n"])


@query()
def greedy_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint pairs of near suppliers, the nearest first."""
    at = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 400).cast("double").alias("y"))
    near = spatial.k_nearest(at, "s_suppkey", "s_acctbal", "y", 4, 1000.0)
    return graph.greedy_matching(near, "a", "b", "distance").select("a", "b", _r(F.col("cost")).alias("cost"))


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey >= 3),
r AS (SELECT child AS node, parent AS ancestor FROM e UNION SELECT r.node, e.parent FROM r JOIN e ON r.ancestor = e.child)
SELECT node, ancestor FROM r
""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each node of a tree."""
    part = table(spark, sf_dir, "part").where("p_partkey >= 3")
    return graph.ancestors(part.select("p_partkey", F.expr("p_partkey div 3").alias("parent")), "p_partkey", "parent")


@query("""
SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, ln(CAST(p_size AS DOUBLE)) - ln(-ln((CAST('0x' || substr(md5('9:' || CAST(p_partkey AS VARCHAR)), 1, 12) AS BIGINT) + 0.5) / pow(2.0, 48))) AS key FROM part WHERE p_size > 0)
ORDER BY key DESC, p_partkey LIMIT 100
""")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows drawn by weight."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return ranking.weighted_sample(part, "p_partkey", "p_size", 100, 9).select("p_partkey", "p_size")


@query("""
WITH f AS (SELECT 'org/' || c_mktsegment || '/' || CASE WHEN c_custkey % 3 = 0 THEN 'IMG_' || c_custkey || '.JPG' ELSE 'note.txt' END AS path FROM customer UNION ALL SELECT 'org/readme.jpg' UNION ALL SELECT 'other/x.jpg')
SELECT split_part(substr(path, 5), '/', 1) AS entry, count(*) AS n_files, count(*) FILTER (WHERE lower(path) LIKE '%.jpg') AS n_wanted, bool_or(contains(substr(path, 5), '/')) AS is_folder
FROM f WHERE starts_with(path, 'org/') GROUP BY 1
""")
def browse_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders below a prefix with their files."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("IMG_"), F.col("c_custkey").cast("string"), F.lit(".JPG"))).otherwise("note.txt")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("org/"), F.col("c_mktsegment"), F.lit("/"), name).alias("path"))
    more = spark.createDataFrame([("org/readme.jpg",), ("other/x.jpg",)], "path string")
    return relational.browse_rollup(files.union(more), "path", "org/", (".jpg", ".jpeg"))


@query("""
SELECT c_mktsegment || '.txt' AS name, min(sha256(CASE WHEN c_custkey % 2 = 0 OR c_mktsegment < 'C' THEN 'same' ELSE c_name END)) AS sha256, count(*) AS n_files,
       count(DISTINCT CASE WHEN c_custkey % 2 = 0 OR c_mktsegment < 'C' THEN 'same' ELSE c_name END) > 1 AS conflict FROM customer GROUP BY c_mktsegment
""")
def identical_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose files differ."""
    content = F.when((F.col("c_custkey") % 2 == 0) | (F.col("c_mktsegment") < "C"), "same").otherwise(F.col("c_name"))
    files = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.lit(".txt")).alias("name"), content.alias("content"))
    return relational.identical_content(files, "name", "content")


@query("""
WITH s AS (SELECT count(*) AS n, avg(l_discount) AS d, max(l_tax) AS t FROM lineitem)
SELECT name, round(actual, 4) AS actual, lim AS "limit", passed, bool_and(passed) OVER () AS accepted FROM (
  SELECT 'rows' AS name, CAST(n AS DOUBLE) AS actual, 100.0 AS lim, n >= 100 AS passed FROM s UNION ALL SELECT 'discount', d, 0.2, d <= 0.2 FROM s UNION ALL SELECT 'tax', t, 0.01, t <= 0.01 FROM s)
""")
def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named limits on one row of figures."""
    figures = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("d"), F.max("l_tax").alias("t"))
    found = relational.gate_checks(figures, {"rows": ("n", ">=", 100.0), "discount": ("d", "<=", 0.2), "tax": ("t", "<=", 0.01)})
    return found.withColumn("actual", _r(F.col("actual")))


_RASTER = "SELECT l_orderkey % 60 AS col, l_linenumber AS row, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


def _raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy((F.col("l_orderkey") % 60).alias("col"), F.col("l_linenumber").cast("long").alias("row")).agg(F.avg("l_quantity").alias("v"))


@query(f"""
WITH r AS ({_RASTER}), q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM r)
SELECT col, CAST(row AS BIGINT) AS row, CAST(round_even(least(1.0, greatest(0.0, (v - lo) / (hi - lo))) * 255, 0) AS INT) AS shown FROM r, q
""")
def raster_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster as 0 to 255 between its percentiles."""
    return raster.stretched(_raster(spark, sf_dir)).select("col", "row", "shown")


@query(f"""
WITH r AS ({_RASTER}), t AS (SELECT i AS c, j AS r FROM range(0, 24) a(i), range(0, 4) b(j)),
w AS (SELECT t.c, t.r, v, greatest(0, least(col + 1, (c + 1) * 2.5) - greatest(col, c * 2.5)) * greatest(0, least(row + 1, (t.r + 1) * 2.5) - greatest(row, t.r * 2.5)) AS w FROM r JOIN t ON true)
SELECT c AS col, r AS row, round(sum(w * v) / sum(w), 6) AS v FROM w WHERE w > 1e-12 GROUP BY c, r
""")
def raster_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster at two fifths of its resolution."""
    return raster.downsampled(_raster(spark, sf_dir), 2.5).withColumn("v", _r(F.col("v"), 6))


@query(f"""
WITH r AS ({_RASTER}), a AS (SELECT DISTINCT col, row FROM r WHERE v > 25), b AS (SELECT DISTINCT col, row FROM r WHERE v < 26)
SELECT round(count(*) FILTER (WHERE a.col IS NOT NULL AND b.col IS NOT NULL) / count(a.col), 6) AS retained, round(count(*) FILTER (WHERE a.col IS NOT NULL AND b.col IS NOT NULL) / count(*), 6) AS iou,
       round(1 - count(*) FILTER (WHERE a.col IS NOT NULL AND b.col IS NOT NULL) / count(b.col), 6) AS new FROM a FULL JOIN b ON a.col = b.col AND a.row = b.row
""")
def occupancy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two sets of cells overlap."""
    r = _raster(spark, sf_dir)
    found = raster.occupancy_comparison(r.where("v > 25"), r.where("v < 26"))
    return found.select(*[_r(F.col(c), 6).alias(c) for c in found.columns])


@query(f"""
WITH r AS ({_RASTER}) SELECT CAST(floor(row / 4) AS BIGINT) AS cell_row, CAST(floor(col / 4) AS BIGINT) AS cell_col, count(*) AS n, round(count(*) FILTER (WHERE v > 25) / count(*), 6) AS coverage, count(*) FILTER (WHERE v > 25) / count(*) >= 0.5 AS covered FROM r GROUP BY 1, 2
""")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of valid pixels of each cell."""
    r = _raster(spark, sf_dir).withColumn("v", F.when(F.col("v") > 25, F.col("v")).otherwise(float("nan")))
    return raster.coverage_report(r, 4, 0.5).withColumn("coverage", _r(F.col("coverage"), 6))


@query()
def raster_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of two rasters."""
    r = _raster(spark, sf_dir)
    found = raster.structural_similarity(r, r.withColumn("v", F.col("v") + F.col("col") % 3), 50.0)
    return found.select(*[_r(F.col(c), 6).alias(c) for c in found.columns])
