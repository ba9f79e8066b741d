"""Registered queries about geometries and depths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import shapes
from plumbline.operators import fits

from .catalogue import _r, query, table

_GEOMETRY = """concat('{"type": "', CASE p_size % 7 WHEN 0 THEN 'Point' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Polygon' WHEN 3 THEN 'Circle' WHEN 4 THEN 'MultiPoint' WHEN 5 THEN 'MultiPolygon' ELSE 'MultiLineString' END,
'", "coordinates": ', CASE p_partkey % 5 WHEN 0 THEN concat('[', p_size, ', ', p_partkey % 100, ']') WHEN 1 THEN concat('[[', p_size, '.5, 1], [2, ', p_partkey % 95, ']]')
WHEN 2 THEN concat('[[[0, 0], [', p_size * 4, ', 0], [1, 1e1, 7], [0, 0]]]') WHEN 3 THEN concat('[[1, 2], ', p_size, ']') ELSE concat('[[[[0,0],[0,', p_size, '],[1,1],[0,0]]], []]') END, '}')"""


@query("""
WITH g AS (
    SELECT p_partkey, p_size % 7 AS t, p_partkey % 5 AS c, p_size, p_partkey % 100 AS lat, p_partkey % 95 AS other FROM part
), n AS (
    SELECT *, CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS n, CASE WHEN t IN (0, 4) THEN 1 WHEN t IN (1, 6) THEN 2 ELSE 4 END AS least,
           CASE c WHEN 0 THEN lat <= 90 WHEN 1 THEN other <= 90 WHEN 2 THEN p_size * 4 <= 180 ELSE p_size <= 90 END AS inside FROM g
)
SELECT p_partkey, CASE WHEN t = 3 THEN 'type' WHEN c = 3 THEN 'structure' WHEN NOT inside THEN 'range' WHEN n < least THEN 'few' END AS problem, CASE WHEN c = 3 THEN 1 ELSE n END AS positions FROM n
""")
def geometry_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a geometry of each part, and how many positions it has."""
    g = table(spark, sf_dir, "part").select("p_partkey", F.expr(_GEOMETRY).alias("g"))
    return g.select("p_partkey", shapes.geometry_problem(F.col("g")).alias("problem"), F.size(shapes.flat_coordinates(F.get_json_object("g", "$.coordinates"))).alias("positions"))


@query("""
WITH r AS (
    SELECT o_orderpriority AS k, o_totalprice / 1000 * CASE WHEN o_orderpriority < '3' THEN -1 ELSE 1 END + o_custkey % 7 AS d, o_totalprice / 1000 AS r FROM orders
), b AS (
    SELECT k, s AS sign, r - s * d AS o, r, s * d AS sd FROM r, unnest([1, -1]) AS t(s)
), m AS (
    SELECT k, sign, quantile_cont(o, 0.5) AS offs FROM b GROUP BY k, sign
), e AS (
    SELECT b.*, offs, offs - o AS e FROM b JOIN m USING (k, sign)
), q AS (
    SELECT k, sign, count(*) AS n, any_value(offs) AS offs, quantile_cont(abs(e), 0.5) AS mad, quantile_cont(abs(e), 0.95) AS p95, sqrt(avg(e * e)) AS rmse, corr(sd, r) AS c FROM e GROUP BY k, sign
)
SELECT k AS o_orderpriority, n, sign, round(offs, 4) AS offs, round(mad, 4) AS median_absolute, round(p95, 4) AS p95, round(rmse, 4) AS rmse, round(c, 6) AS correlation
FROM q WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY k ORDER BY mad, sign DESC) = 1
""")
def depth_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign and offset by which the depths of each group fit their reference."""
    price, k = F.col("o_totalprice") / 1000, F.col("o_orderpriority")
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_custkey")
    found = fits.depth_comparison(orders, ["o_orderpriority"], price * F.when(k < "3", -1).otherwise(1) + F.col("o_custkey") % 7, price, 20)
    return found.select("o_orderpriority", "n", "sign", _r(F.col("offset")).alias("offs"), *[_r(F.col(c)).alias(c) for c in ("median_absolute", "p95", "rmse")], _r(F.col("correlation"), 6).alias("correlation"))
