"""Registered queries about cameras and what they see; suppliers stand for cameras, customers for points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import views

from .catalogue import _r, query, table


@query("""
WITH c AS (
    SELECT s_suppkey, s_suppkey % 97 * 10.0 AS ox, s_suppkey % 89 * 10.0 AS oy, 100.0 + s_suppkey % 20 AS oz, s_suppkey % 7 / 10.0 AS a, s_suppkey % 3 AS m FROM supplier
), p AS (
    SELECT c_custkey, c_custkey % 1009 * 1.0 AS x, c_custkey % 907 * 1.0 AS y, c_acctbal / 1000 AS z FROM customer
), v AS (
    -- x to the right, y down, z ahead: a camera that looks straight down, turned by a
    SELECT s_suppkey, c_custkey, m, (cos(a) * (x - ox) + sin(a) * (y - oy)) / (oz - z) AS u, (sin(a) * (x - ox) - cos(a) * (y - oy)) / (oz - z) AS w FROM c, p WHERE oz - z > 0
), d AS (
    SELECT *, CASE m WHEN 1 THEN 1 - 0.05 * (u * u + w * w) WHEN 2 THEN 1 + 0.02 * (u * u + w * w) - 0.01 * pow(u * u + w * w, 2) ELSE 1 END AS k FROM v
), f AS (
    SELECT *, 800 * u * k + 500 AS px, 800 * w * k + 400 AS py FROM d
), s AS (
    SELECT *, sqrt(pow((px - 500) / 500, 2) + pow((py - 400) / 400, 2)) AS score FROM f WHERE px >= 50 AND px < 950 AND py >= 40 AND py < 760
), r AS (
    SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(score, 9), s_suppkey) AS rank FROM s
)
SELECT c_custkey AS point, s_suppkey AS image, round(px, 4) AS pixel_x, round(py, 4) AS pixel_y, rank FROM r WHERE rank <= 3
""")
def point_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three images that see each point best, through three kinds of lenses."""
    k = F.col("s_suppkey")
    ox, oy, oz, a = k % 97 * 10.0, k % 89 * 10.0, 100.0 + k % 20, k % 7 / 10.0
    c, s = F.cos(a), F.sin(a)
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(c, s, zero, -(c * ox + s * oy), s, -c, zero, -(s * ox - c * oy), zero, zero, -one, oz)
    lens = lambda *p: F.array(*[F.lit(float(v)) for v in p])
    cameras = table(spark, sf_dir, "supplier").select(
        k.alias("image"), F.lit(1000).cast("long").alias("width"), F.lit(800).cast("long").alias("height"), F.when(k % 3 == 0, "PINHOLE").when(k % 3 == 1, "SIMPLE_RADIAL").otherwise("RADIAL").alias("model"),
        F.when(k % 3 == 0, lens(800, 800, 500, 400)).when(k % 3 == 1, lens(800, 500, 400, -0.05)).otherwise(lens(800, 500, 400, 0.02, -0.01)).alias("params"), pose.alias("pose"),
    )
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), (F.col("c_custkey") % 1009 * 1.0).alias("x"), (F.col("c_custkey") % 907 * 1.0).alias("y"), (F.col("c_acctbal") / 1000).alias("z"))
    found = views.views(points, cameras, 50.0, margin=0.05, limit=3)
    return found.select("point", "image", _r(F.col("pixel_x")).alias("pixel_x"), _r(F.col("pixel_y")).alias("pixel_y"), "rank")
