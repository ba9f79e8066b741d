"""Registered queries of usage, telemetry, quality and scene aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import points, ranking, statistics, usage

from .catalogue import _r, query, table


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS n_active, CAST(coalesce(sum(CASE WHEN event_type <> 'error' THEN coalesce(CASE WHEN value > 10 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END, 1) END), 0) AS BIGINT) AS units,
       count(*) FILTER (WHERE value > 50) AS n_eligible FROM events GROUP BY user_id
""")
def organization_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active rows, their units and what retention may take, by owner."""
    units = F.when(F.col("value") > 10, F.get_json_object("props", "$.k").try_cast("bigint"))
    return usage.organization_usage(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", units, F.col("value") > 50)


@query("SELECT c_custkey, least(\"limit\", 4) AS \"limit\" FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS \"limit\" FROM customer) WHERE \"limit\" IS NOT NULL AND c_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)")
def effective_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners' limits, none above the platform's."""
    policies = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("limit"))
    return usage.effective_limits(policies, "c_custkey", "limit", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89], 4)


@query("SELECT CAST(lang AS VARCHAR) AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a column and how often each occurs."""
    return usage.value_counts(table(spark, sf_dir, "documents"), "lang")


@query("""
SELECT o_custkey, max(o_orderkey % 7) + 1 AS next_attempt, CAST(sum(length(o_orderpriority)) AS BIGINT) AS tiles FROM orders GROUP BY o_custkey
""")
def next_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next attempt of each owner, and the tiles of all of its runs."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg((F.max(F.col("o_orderkey") % 7) + 1).alias("next_attempt"), F.sum(F.length("o_orderpriority")).alias("tiles"))


@query("""
SELECT c_mktsegment, count(*) AS n, round(sqrt(avg(c_acctbal * c_acctbal)), 4) AS rmse_c_acctbal, round(sqrt(avg(c_nationkey * c_nationkey)), 4) AS rmse_c_nationkey, max(abs(c_acctbal)) AS max_c_acctbal, max(abs(c_nationkey)) AS max_c_nationkey
FROM customer GROUP BY c_mktsegment
""")
def role_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each role."""
    found = usage.role_metrics(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"])
    return found.withColumns({c: _r(F.col(c)) for c in ("rmse_c_acctbal", "rmse_c_nationkey")})


@query("""
SELECT n, round(mx, 4) AS mean_x, round(my, 4) AS mean_y, round(mz, 4) AS level, round((xz * yy - yz * xy) / (xx * yy - xy * xy), 6) AS slope_x, round((yz * xx - xz * xy) / (xx * yy - xy * xy), 6) AS slope_y FROM (
 SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS my, avg(l_extendedprice) AS mz, var_pop(l_quantity) AS xx, var_pop(l_discount) AS yy, covar_pop(l_quantity, l_discount) AS xy, covar_pop(l_quantity, l_extendedprice) AS xz, covar_pop(l_discount, l_extendedprice) AS yz FROM lineitem)
""")
def plane_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane through points that leaves least squares."""
    found = usage.plane_fit(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_extendedprice"), "l_quantity", "l_discount", "l_extendedprice")
    digits = {"mean_x": 4, "mean_y": 4, "level": 4, "slope_x": 6, "slope_y": 6}
    return found.select("n", *[_r(F.col(c), d).alias(c) for c, d in digits.items()])


@query("SELECT DISTINCT CAST(least(7, greatest(0, floor(x * 8))) AS INT) AS cell_x, CAST(least(7, greatest(0, floor(y * 8))) AS INT) AS cell_y FROM (SELECT s_acctbal / 9000 AS x, s_nationkey / 24 AS y FROM supplier)")
def camera_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid that hold a camera."""
    at = table(spark, sf_dir, "supplier").select((F.col("s_acctbal") / 9000).alias("x"), (F.col("s_nationkey") / 24).alias("y"))
    return usage.clamped_cells(at, "x", "y", 8)


@query("""
WITH c AS (SELECT l_orderkey % 40 AS cell, count(*) FILTER (WHERE l_quantity > 25) / count(*) AS coverage FROM lineitem GROUP BY 1)
SELECT cell, round(coverage, 6) AS coverage FROM c ORDER BY round(coverage, 6), cell LIMIT 10
""")
def worst_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten cells with least coverage."""
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("cell")).agg(_r(F.count_if(F.col("l_quantity") > 25) / F.count(F.lit(1)), 6).alias("coverage"))
    return usage.worst(cells, [F.asc("coverage"), F.asc("cell")])


@query("SELECT min(p_retailprice - 3.0 * p_size) AS low_p_retailprice, max(p_retailprice + 3.0 * p_size) AS high_p_retailprice FROM part")
def support_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of points with their extent."""
    return usage.support_bounds(table(spark, sf_dir, "part"), ["p_retailprice"], ["p_size"])


@query("""
SELECT l_returnflag, round(sum(l_discount), 4) AS mass, round(sum(l_discount * l_quantity) / sum(l_discount), 4) AS mean, round(sum(l_discount * l_quantity * l_quantity) / sum(l_discount) - pow(sum(l_discount * l_quantity) / sum(l_discount), 2), 3) AS variance
FROM lineitem WHERE l_discount > 0 GROUP BY l_returnflag
""")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean and variance of each group."""
    found = usage.weighted_moments(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_quantity"), F.col("l_discount"))
    return found.select("l_returnflag", _r(F.col("mass")).alias("mass"), _r(F.col("mean")).alias("mean"), _r(F.col("variance"), 3).alias("variance"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(l_suppkey) OVER w - l_suppkey AS BIGINT) AS exclusive, CAST(sum(l_suppkey) OVER w AS BIGINT) AS inclusive FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING)")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums over all rows."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    order = [F.asc(c) for c in lines.columns]
    return usage.prefix_sums(lines, order, "l_suppkey").drop("l_suppkey", "l_extendedprice")


@query("""
WITH e AS (SELECT o_custkey AS a, o_orderkey % 50 - 100 AS b FROM orders), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
SELECT count(*) AS nodes, min(degree) AS min, max(degree) AS max, round(avg(degree), 4) AS mean FROM d
""")
def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of a graph's nodes."""
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 50 - 100).alias("b"))
    return usage.degree_stats(edges, "a", "b").withColumn("mean", _r(F.col("mean")))


@query("SELECT event_type, round(coalesce(sum(value), 0), 3) AS value, CAST(coalesce(sum(user_id), 0) AS BIGINT) AS user_id FROM events GROUP BY event_type")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters added up field by field."""
    found = usage.telemetry(table(spark, sf_dir, "events"), ["event_type"], ["value", "user_id"])
    return found.withColumn("value", _r(F.col("value"), 3))


@query("""
WITH r AS (SELECT l_linenumber AS run, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1), b AS (SELECT q AS bq, d AS bd FROM r WHERE run = 1)
SELECT run, round(q - bq, 5) AS q_delta, round(q / bq, 5) AS q_ratio, round(d - bd, 6) AS d_delta, round(d / bd, 5) AS d_ratio FROM r, b
""")
def against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs against the first one."""
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("run")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    found = usage.against_baseline(runs, "run", F.col("run") == 1, ["q", "d"])
    return found.select("run", _r(F.col("q_delta"), 5).alias("q_delta"), _r(F.col("q_ratio"), 5).alias("q_ratio"), _r(F.col("d_delta"), 6).alias("d_delta"), _r(F.col("d_ratio"), 5).alias("d_ratio"))


@query("""
WITH b AS (SELECT min(p_size) AS low_p_size, max(p_size) AS high_p_size, avg(p_size) AS cx, min(p_retailprice) AS low_p_retailprice, max(p_retailprice) AS high_p_retailprice, avg(p_retailprice) AS cy, min(p_partkey) AS low_p_partkey, max(p_partkey) AS high_p_partkey, avg(p_partkey) AS cz FROM part)
SELECT any_value(low_p_size) AS low_p_size, any_value(low_p_retailprice) AS low_p_retailprice, any_value(low_p_partkey) AS low_p_partkey, any_value(high_p_size) AS high_p_size, any_value(high_p_retailprice) AS high_p_retailprice, any_value(high_p_partkey) AS high_p_partkey,
       round(any_value(cx), 4) AS centre_p_size, round(any_value(cy), 4) AS centre_p_retailprice, round(any_value(cz), 4) AS centre_p_partkey, round(max(sqrt(pow(p_size - cx, 2) + pow(p_retailprice - cy, 2) + pow(p_partkey - cz, 2))), 4) AS radius FROM part, b
""")
def scene_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds, centre and radius of a scene."""
    found = usage.scene_extent(table(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_partkey")
    rounded = {c: _r(F.col(c)) for c in ("centre_p_size", "centre_p_retailprice", "centre_p_partkey", "radius")}
    return found.withColumns(rounded)


@query("""
WITH l AS (SELECT user_id, event_type, arg_max(CASE WHEN value > 40 THEN 'failed' WHEN value > 15 THEN 'running' ELSE 'done' END, event_id) AS s, arg_max(CAST(floor(value) AS INT), event_id) AS p FROM events GROUP BY 1, 2)
SELECT user_id, CASE WHEN bool_or(s = 'failed') THEN 'failed' WHEN bool_or(s = 'running') THEN 'running' ELSE 'done' END AS status, CAST(round_even(avg(p), 0) AS INT) AS progress, count(*) AS stages FROM l GROUP BY user_id
""")
def mission_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest stages as one status and progress."""
    status = F.when(F.col("value") > 40, "failed").when(F.col("value") > 15, "running").otherwise("done")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", status.alias("status"), F.floor("value").cast("int").alias("progress"))
    return usage.mission_projection(events, "user_id", "event_type", "event_id", "status", "progress", {"failed": 0, "running": 1, "done": 2})


@query("""
SELECT count(*) AS images, count(lat) AS placed, round(100.0 * count(lat) / count(*), 4) AS coverage_percent, min(value) AS alt_min, max(value) AS alt_max, round(avg(value), 4) AS alt_mean, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north,
       round(avg(lon), 5) AS centre_lon, round(avg(lat), 5) AS centre_lat, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at
FROM (SELECT ts, value, CASE WHEN event_type <> 'error' THEN 40 + user_id % 7 END AS lat, CASE WHEN event_type <> 'error' THEN 1 + user_id % 5 END AS lon FROM events)
""")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a set of geotagged images holds."""
    there = F.col("event_type") != "error"
    events = table(spark, sf_dir, "events").select(
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value", F.when(there, 40 + F.col("user_id") % 7).alias("lat"), F.when(there, 1 + F.col("user_id") % 5).alias("lon")
    )
    found = usage.dataset_summary(events, "at", "lat", "lon", "value")
    return found.withColumns({"coverage_percent": _r(F.col("coverage_percent")), "alt_mean": _r(F.col("alt_mean")), "centre_lon": _r(F.col("centre_lon"), 5), "centre_lat": _r(F.col("centre_lat"), 5)})


@query("""
WITH p AS (SELECT l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z, 2 * l_discount * 100 + 5 AS u, -2 * l_quantity + 7 AS v, 2 * l_tax * 100 - 1 AS w FROM lineitem)
SELECT count(*) AS n, 2.0 AS scale, 0.0 AS rmse, 5.0 AS tx, 7.0 AS ty, -1.0 AS tz FROM p
""")
def sim3_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity between two sets of points, one of which is a turned, scaled and moved copy of the other."""
    lines = table(spark, sf_dir, "lineitem")
    pairs = lines.select(
        F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"),
        (2 * F.col("l_discount") * 100 + 5).alias("u"), (-2 * F.col("l_quantity") + 7).alias("v"), (2 * F.col("l_tax") * 100 - 1).alias("w"),
    )
    fit = points.similarity_fit(pairs, ["x", "y", "z"], ["u", "v", "w"])
    row = (fit["n"], round(fit["scale"], 6), round(fit["rmse"], 3), *[round(float(t), 4) + 0.0 for t in fit["translation"]])
    return spark.createDataFrame([row], "n long, scale double, rmse double, tx double, ty double, tz double")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm FROM embeddings ORDER BY round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) DESC, vec_id LIMIT 50")
def vector_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty longest vectors."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", _r(F.sqrt(square), 6).alias("norm"))
    return usage.worst(rows, [F.desc("norm"), F.asc("vec_id")], 50)


@query("""
WITH h AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) SELECT user_id, event_id FROM h WHERE rn <= 30
""")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty rows of each user."""
    return ranking.bounded_history(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], [F.desc("event_id")], 30)


@query("""
SELECT p_brand, p_partkey, start, stop, coalesce(start <= lag(stop) OVER (PARTITION BY p_brand ORDER BY start, stop, p_partkey), false) AS overlaps FROM (SELECT p_brand, p_partkey, CAST(round(p_retailprice) AS BIGINT) AS start, CAST(round(p_retailprice) AS BIGINT) + p_size AS stop FROM part)
""")
def overlapping_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sorted intervals begin before, or where, the one before them ends."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.round("p_retailprice").cast("long").alias("start"), (F.round("p_retailprice").cast("long") + F.col("p_size")).alias("stop"))
    return ranking.overlap_flags(part, ["p_brand"], "start", "stop", "p_partkey")


@query("""
WITH r AS (SELECT p_partkey, p_size * 13 + 1 AS w, p_size * 7 + 1 AS h, CASE WHEN p_size > 30 THEN 4 WHEN p_size > 15 THEN 2 ELSE 1 END AS n FROM part)
SELECT p_partkey, i AS part, i * w // n AS x0, (i + 1) * w // n AS x1 FROM (SELECT *, CAST(unnest(range(0, n)) AS INT) AS i FROM r)
""")
def even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths cut into one, two or four even parts at whole pixels."""
    from plumbline.operators import sequences

    size = F.col("p_size")
    part = table(spark, sf_dir, "part").select("p_partkey", (size * 13 + 1).alias("w"), F.when(size > 30, 4).when(size > 15, 2).otherwise(1).alias("n"))
    return sequences.even_parts(part, "p_partkey", "w", "n")


@query("""
SELECT p_partkey, CAST(least(1000, greatest(0, round_even((p_retailprice - 900) * 2.5, 0))) AS INT) AS first, CAST(least(1000, greatest(0, round_even((p_retailprice - 900 + p_size) * 2.5, 0))) AS INT) AS last FROM part
""")
def pixel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds as pixels, half to even and clamped to the raster."""
    from plumbline.operators import sequences

    low = F.col("p_retailprice") - 900
    return table(spark, sf_dir, "part").select("p_partkey", *sequences.pixel_window(low, low + F.col("p_size"), 2.5, 1000))


@query("""
SELECT o_orderkey, position FROM (SELECT o_orderkey, row_number() OVER (ORDER BY CASE WHEN o_orderpriority > '3' THEN o_orderpriority END NULLS FIRST, o_orderdate, o_orderkey) AS position FROM orders) WHERE position <= 200
""")
def nulls_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of an order in which missing values come first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") > "3", F.col("o_orderpriority")).alias("p"), "o_orderdate")
    return ranking.top_n_truncated(orders, [F.asc_nulls_first("p"), F.asc("o_orderdate"), F.asc("o_orderkey")], 200).select("o_orderkey", "position")


@query("""
WITH s AS (SELECT p_brand, sum(p_size) AS need FROM part GROUP BY p_brand), g AS (SELECT p_brand, need, unnest(range(1, 65)) AS rows FROM s),
c AS (SELECT *, CAST(ceil(need / (rows * 10.0)) AS BIGINT) AS cols FROM g)
SELECT p_brand, best.rows AS rows, best.cols AS cols FROM (SELECT p_brand, min(struct_pack(penalty := abs(rows - cols), cells := rows * cols, rows := rows, cols := cols)) AS best FROM c GROUP BY p_brand)
""")
def best_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid nearest to a square that is large enough."""
    need = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sum("p_size").alias("need"))
    return ranking.best_grid(need, "p_brand", F.col("need") / 10.0, 64)


@query("""
SELECT l_orderkey, round(quantile_cont(l_quantity, 0.5), 4) AS median FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey
""")
def many_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of many keys by rank."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    found = statistics.quantiles(lines, ["l_orderkey"], F.col("l_quantity"), {"median": ("linear", 0.5)})
    return found.select("l_orderkey", _r(F.col("median")).alias("median"))
