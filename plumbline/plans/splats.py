"""Registered queries about splats; customers stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import harmonics
from plumbline.operators import generations

from .catalogue import _r, query, table


def _splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, a = F.col("c_custkey"), F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("tile"), k.alias("id"), (a / 100).alias("x"), (k % 101 * 1.0).alias("y"), (k % 37 * 1.0).alias("z"),
        F.array((k % 11 / 10.0) - 1, (k % 7 / 10.0) - 1, (k % 5 / 10.0) - 1).alias("scale"), F.array(F.lit(1.0), k % 3 / 3.0, k % 4 / 4.0, k % 5 / 5.0).alias("rotation"),
        (a / 5000).alias("opacity"), F.array(k % 13 / 13.0, k % 17 / 17.0, k % 19 / 19.0).alias("opacity_sh"), F.array(k % 23 / 23.0, k % 29 / 29.0, k % 31 / 31.0, a / 10000).alias("colour"), F.lit(0.0).alias("error"),
    )


@query()
def coarser_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's splats merged until twenty at most are left: iterated, so without SQL."""
    found = generations.coarser(_splats(spark, sf_dir), 20)
    return found.select("tile", "id", *[_r(F.col(c), 3) for c in ("x", "y", "z", "opacity", "error")])


@query("""
WITH d AS (
    SELECT c_custkey, c_acctbal / 12000 AS z, sqrt(1 - pow(c_acctbal / 12000, 2)) AS ring, (c_custkey % 360 + 0.5) * pi() / 180 AS turn FROM customer
), u AS (
    SELECT c_custkey, ring * cos(turn) AS x, ring * sin(turn) AS y, z FROM d
)
SELECT c_custkey, round(sqrt(1 / (4 * pi())), 6) AS y0, round(-sqrt(3 / (4 * pi())) * y, 6) AS y1, round(sqrt(3 / (4 * pi())) * z, 6) AS y2, round(sqrt(5 / (16 * pi())) * (3 * z * z - 1), 6) AS y6,
       round(sqrt(15 / (16 * pi())) * (x * x - y * y), 6) AS y8, round(sqrt(105 / (4 * pi())) * x * y * z, 6) AS y10, round(sqrt(7 / (16 * pi())) * z * (5 * z * z - 3), 6) AS y12, round(-sqrt(35 / (32 * pi())) * x * (x * x - 3 * y * y), 6) AS y15
FROM u
""")
def harmonic_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some harmonics of the direction that each customer stands for."""
    z, turn = F.col("c_acctbal") / 12000, F.radians(F.col("c_custkey") % 360 + 0.5)
    ring = F.sqrt(1 - z * z)
    values = harmonics.basis(3, ring * F.cos(turn), ring * F.sin(turn), z)
    return table(spark, sf_dir, "customer").select("c_custkey", *[_r(values[i], 6).alias(f"y{i}") for i in (0, 1, 2, 6, 8, 10, 12, 15)])


@query("""
SELECT c_custkey AS id FROM customer
WHERE greatest(c_custkey % 11, c_custkey % 7, c_custkey % 5) / 10.0 - 1 > ln(0.5)
  AND c_acctbal / 1000 - 4 + sqrt(3 / (4 * pi())) * sqrt(pow(c_custkey % 13 / 13.0, 2) + pow(c_custkey % 17 / 17.0, 2) + pow(c_custkey % 19 / 19.0, 2)) < ln(0.02 / 0.98)
""")
def invisible_giants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large splats that no direction sees well."""
    s = _splats(spark, sf_dir).withColumn("opacity", F.col("opacity") * 5 - 4)
    return s.where(harmonics.invisible_giant([F.col("scale")[i] for i in range(3)], F.col("opacity"), F.col("opacity_sh"), 3, 0.5, 0.02)).select("id")
