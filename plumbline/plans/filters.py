"""Registered queries of filters and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import features, text
from plumbline.functions.geometry import circular_difference
from plumbline.operators import matching, points, ranking

from .catalogue import _r, query, table


@query("""
WITH p AS (SELECT c_custkey, c_acctbal / 100 AS pitch, c_custkey * 13 % 720 - 360 AS yaw FROM customer)
SELECT c_custkey FROM p WHERE abs(pitch) <= 30 AND least((yaw + 720 - 40) % 360, 360 - (yaw + 720 - 40) % 360) <= 50
""")
def facing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that look level enough and the right way round the compass."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("pitch"), (F.col("c_custkey") * 13 % 720 - 360).alias("yaw"))
    return rows.where((F.abs("pitch") <= 30) & (circular_difference(F.col("yaw"), F.lit(40)) <= 50)).select("c_custkey")


@query("""
WITH s(word, label) AS (VALUES ('small ring', 'ring'), ('red widget', 'widget'), ('blue bolt', 'bolt')), l AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(replace(p_name, ' ', '_-')), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS word FROM part)
SELECT p_partkey, coalesce(label, word) AS label, label IS NOT NULL AS known FROM l LEFT JOIN s USING (word)
""")
def resolved_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in one spelling, then by their synonyms."""
    synonyms = spark.createDataFrame([("small ring", "ring"), ("red widget", "widget"), ("blue bolt", "bolt")], "word string, known_as string")
    rows = table(spark, sf_dir, "part").select("p_partkey", text.label(F.replace("p_name", F.lit(" "), F.lit("_-"))).alias("word"))
    joined = rows.join(F.broadcast(synonyms), "word", "left")
    return joined.select("p_partkey", F.coalesce("known_as", "word").alias("label"), F.col("known_as").isNotNull().alias("known"))


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00') AND NOT contains(c_name, '%')")
def literal_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that begin with a prefix, whose wildcards mean themselves."""
    return table(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#00") & ~F.contains("c_name", F.lit("%"))).select("c_custkey", "c_name")


@query("""
SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A') AS has_parts FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1997-06-01'
""")
def expired_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open uploads that are past their time, and whether any part has come."""
    due = table(spark, sf_dir, "orders").where("o_orderstatus IN ('O', 'P') AND o_orderdate <= TIMESTAMP '1997-06-01'").select("o_orderkey")
    parts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_orderkey").distinct()
    return due.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("l_orderkey").isNotNull().alias("has_parts"))


@query("""
WITH p AS (SELECT p_partkey, p_size AS x, p_retailprice AS y FROM part), b AS (SELECT avg(x) AS cx, avg(y) AS cy, max(x) - min(x) AS wx, max(y) - min(y) AS wy FROM p),
r AS (SELECT p_partkey, row_number() OVER (ORDER BY round(pow((x - cx) / wx, 2) + pow((y - cy) / wy, 2), 9), p_partkey) AS k, count(*) OVER () AS n FROM p, b)
SELECT p_partkey, CASE WHEN k <= ceil(n / 10.0) THEN 'held_out' WHEN k <= ceil(n / 10.0) + ceil(n / 20.0) THEN 'guard' ELSE 'train' END AS part FROM r
""")
def spatial_hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tenth of the points nearest to the middle is held out, a band around it ignored."""
    at = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return matching.spatial_hold_out(at, "p_partkey", "x", "y", 10, 20).select("p_partkey", "part")


@query("""
SELECT o_orderkey AS id, '{"deleted":' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || ',"priority":"' || o_orderpriority || '","updated_at":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"}' AS body FROM orders
""")
def projected_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with derived flags and ISO times, keys in order."""
    from plumbline.sources.imagery import canonical_json

    at = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = canonical_json({"updated_at": at, "deleted": F.col("o_orderstatus") == "F", "priority": F.col("o_orderpriority")})
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), body.alias("body"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 20 THEN CAST(p_size AS VARCHAR) ELSE '10' END AS tile, CASE WHEN p_brand > 'Brand#2' THEN p_brand ELSE 'auto' END AS mode, abs(CAST(CASE WHEN p_size > 20 THEN p_size ELSE 10 END AS DOUBLE) - 30.0) <= 3e-8 AS matches FROM part
""")
def merged_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults overridden by maps of which some lack values, and whether a value matches."""
    given = F.create_map(F.lit("tile"), F.when(F.col("p_size") > 20, F.col("p_size").cast("string")), F.lit("unknown"), F.lit("x"))
    more = F.create_map(F.lit("mode"), F.when(F.col("p_brand") > "Brand#2", F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select("p_partkey", features.merged_parameters(F.create_map(F.lit("tile"), F.lit("10"), F.lit("mode"), F.lit("auto")), given, more).alias("m"))
    return rows.select("p_partkey", F.col("m")["tile"].alias("tile"), F.col("m")["mode"].alias("mode"), features.parameter_matches(F.col("m")["tile"], F.lit("30.0")).alias("matches"))


@query("""
WITH c AS (SELECT s_suppkey, s_acctbal AS x, s_nationkey * 100.0 AS y FROM supplier WHERE s_nationkey < 5), p AS (SELECT c_custkey, c_acctbal AS x, c_nationkey * 100.0 AS y FROM customer)
SELECT c_custkey FROM p WHERE (SELECT min(sqrt(pow(p.x - c.x, 2) + pow(p.y - c.y, 2))) FROM c) <= 300
""")
def near_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that have a camera within a distance: an equi-join on cells as wide as that."""
    cameras = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    at = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    return points.within_reach(at, "x", "y", cameras, "x", "y", 300.0).select("c_custkey")


@query("""
SELECT l_orderkey, l_linenumber, l_shipdate IS NULL AS undated, epoch_us(greatest(l_shipdate, CASE WHEN l_returnflag = 'R' THEN TIMESTAMP '1998-01-01' END)) AS newest_us FROM lineitem
""")
def newest_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of two times of which one may be missing."""
    late = F.when(F.col("l_returnflag") == "R", F.lit("1998-01-01 00:00:00").cast("timestamp"))
    newest = features.newest(F.col("l_shipdate").cast("timestamp"), late)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").isNull().alias("undated"), F.unix_micros(newest).alias("newest_us"))


@query("""
SELECT p_partkey, round(1 / (1 + exp(-x)), 8) AS sigmoid, round(x, 6) AS back, q, round(lo + q / 255.0 * (hi - lo), 6) AS value FROM (
 SELECT p_partkey, (p_size - 25) / 5.0 AS x, CAST(round_even((p_retailprice - lo) / (hi - lo) * 255, 0) AS INT) AS q, lo, hi FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part))
""")
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic function and back, quantised values and back."""
    from plumbline.functions.geometry import dequantise, logit, sigmoid

    part = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 25) / 5.0).alias("x"), F.col("p_retailprice").alias("q"))
    quantised = points.quantised(part, ["q"], 255)
    s = sigmoid(F.col("x"))
    return quantised.select("p_partkey", _r(s, 8).alias("sigmoid"), _r(logit(s), 6).alias("back"), "q", _r(dequantise(F.col("q"), F.col("q_low"), F.col("q_high"), 255), 6).alias("value"))


@query("""
WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) SELECT conv_id, turn, role FROM t WHERE k <= 2 UNION ALL SELECT conv_id, turn, role FROM t WHERE k > 2 AND role = 'user'
""")
def merged_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persisted log and a derived one as one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    first = ranking.bounded_history(turns, ["conv_id"], [F.asc("turn")], 2)
    rest = turns.join(first.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti").where("role = 'user'")
    return first.unionByName(rest).orderBy("conv_id", "turn")
