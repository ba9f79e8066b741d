"""Registered queries about trees of tiles; parts stand for nodes, a part's number halved for its parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.cameras import Camera, seen
from plumbline.operators import ranking, trees

from .catalogue import query, table


@query("""
WITH RECURSIVE n AS (
    SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS node, p_size, p_retailprice AS r,
           CAST(CASE WHEN p_partkey = 1 THEN NULL WHEN p_size = 13 THEN p_partkey WHEN p_size = 14 THEN p_partkey + 1000000 ELSE p_partkey // 2 END AS VARCHAR) AS parent
    FROM part
), edges AS (
    SELECT parent, node FROM n WHERE parent IN (SELECT node FROM n)
    UNION ALL SELECT node, 'x' || node FROM n WHERE p_size = 15
    UNION ALL SELECT CAST(k // 2 + 1 AS VARCHAR), node FROM n WHERE p_size = 16 AND CAST(k // 2 + 1 AS VARCHAR) IN (SELECT node FROM n)
), kids AS (
    SELECT parent AS node, count(*) AS kids FROM edges GROUP BY parent
), t AS (
    SELECT n.*, COALESCE(kids, 0) AS kids, CASE WHEN kids IS NULL THEN p_size ELSE 1 END AS held, k % 20 AS pack FROM n LEFT JOIN kids USING (node)
), placed AS (
    SELECT *, 32 + 96 * (sum(held) OVER (PARTITION BY pack ORDER BY k) - held + CASE WHEN p_size = 20 THEN 1 ELSE 0 END) AS off, 96 * held AS len FROM t
), packs AS (
    SELECT pack, 32 + 96 * sum(held) AS len FROM t GROUP BY pack
), ranges AS (
    SELECT pack, off, len FROM placed UNION ALL SELECT pack, len, 0 FROM packs
), steps AS (
    SELECT pack, off - COALESCE(max(off + len) OVER (PARTITION BY pack ORDER BY off, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 32) AS step FROM ranges
), reached(node) AS (
    SELECT '1' UNION SELECT e.node FROM reached JOIN (SELECT node, min(parent) AS parent FROM edges GROUP BY node) e ON e.parent = reached.node
)
SELECT 'parts' AS tree, * FROM (
    SELECT 'child_count' AS kind, node AS id FROM t WHERE kids > 0 AND kids <> 2
    UNION ALL SELECT 'unknown_child', 'x' || node FROM n WHERE p_size = 15
    UNION ALL SELECT 'shared_child', node FROM edges GROUP BY node HAVING count(*) > 1
    UNION ALL SELECT 'unreachable', node FROM n WHERE node NOT IN (SELECT node FROM reached)
    UNION ALL SELECT 'parent_misses_child', e.node FROM edges e JOIN n c ON c.node = e.node JOIN n p ON p.node = e.parent WHERE p.r < c.r
    UNION ALL SELECT 'path', CAST(pack AS VARCHAR) FROM packs WHERE pack = 3
    UNION ALL SELECT 'tile_range', node FROM placed JOIN packs USING (pack) WHERE off + placed.len > packs.len
    UNION ALL SELECT DISTINCT CASE WHEN step > 0 THEN 'gap' ELSE 'overlap' END, CAST(pack AS VARCHAR) FROM steps WHERE step <> 0
)
""")
def tree_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a tree of all parts; some have a wrong parent, one child too many or a shifted tile by their size."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size", F.col("p_retailprice").alias("r")).withColumn("node", F.col("k").cast("string"))
    size = F.col("p_size")
    half = F.floor(F.col("k") / 2)
    parent = F.when(F.col("k") == 1, None).when(size == 13, F.col("k")).when(size == 14, F.col("k") + 1_000_000).otherwise(half).cast("string")
    ids = part.select(F.col("node").alias("parent"))
    edges = part.select(parent.alias("parent"), "node").unionByName(part.where(size == 16).select((half + 1).cast("string").alias("parent"), "node")).join(ids, "parent", "left_semi")
    edges = edges.unionByName(part.where(size == 15).select(F.col("node").alias("parent"), F.concat(F.lit("x"), "node").alias("node")))
    kids = edges.groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("node")).alias("children"))
    known = part.join(kids, "node", "left").withColumn("held", F.when(F.col("children").isNull(), size).otherwise(1).cast("long")).withColumn("pack", (F.col("k") % 20).cast("string"))
    known = ranking.running_sums(known, ["pack"], [F.col("k")], {"upto": F.col("held")})
    digest = F.lit("a" * 64)
    tile = F.struct("pack", (32 + 96 * (F.col("upto") - F.col("held") + F.when(size == 20, 1).otherwise(0))).alias("offset"), (96 * F.col("held")).alias("length"), F.col("held").alias("records"), digest.alias("sha256"))
    box = lambda by: F.struct(F.array(*[-by * F.col("r")] * 3).alias("min"), F.array(*[by * F.col("r")] * 3).alias("max"))
    nodes = known.select(
        F.lit("parts").alias("tree"), "node", "children", box(1).alias("box"), box(3).alias("support"), F.col("r").alias("error"), size.cast("long").alias("records"),
        F.when(F.col("children").isNull(), tile).alias("tile"), F.when(F.col("children").isNotNull(), tile).alias("merged"),
    )
    packs = known.groupBy("pack").agg(F.sum("held").alias("records")).select(
        F.lit("parts").alias("tree"), "pack", F.concat(F.when(F.col("pack") == "3", "../").otherwise("packs/"), "pack").alias("path"),
        F.lit(32).cast("long").alias("offset"), (32 + 96 * F.col("records")).alias("length"), "records", digest.alias("sha256"),
    )
    leaves = known.where("children IS NULL").agg(F.sum("held").alias("records"))
    return trees.tree_violations(leaves.select(F.lit("parts").alias("tree"), F.lit("1").alias("root"), "records"), nodes, packs)


_CAMERA = Camera(position=(700.0, -150.0, 1500.0), direction=(0.2, 0.1, -1.0), up=(0.0, 1.0, 0.0), opening=0.6, width=1920, height=1080)


@query("""
WITH RECURSIVE c AS (
    SELECT 700.0::DOUBLE AS px, -150.0::DOUBLE AS py, 1500.0::DOUBLE AS pz, tan(0.3) AS ty, tan(0.3) * 1920 / 1080 AS tx, 1080 / (2 * tan(0.3)) AS focal,
           0.2 / sqrt(1.05) AS fx, 0.1 / sqrt(1.05) AS fy, -1 / sqrt(1.05) AS fz
), axes AS (
    -- right = ahead x up, up = right x ahead
    SELECT *, -fz / sqrt(fx * fx + fz * fz) AS rx, 0.0::DOUBLE AS ry, fx / sqrt(fx * fx + fz * fz) AS rz FROM c
), a AS (
    SELECT *, ry * fz - rz * fy AS ux, rz * fx - rx * fz AS uy, rx * fy - ry * fx AS uz FROM axes
), b AS (
    SELECT (p_partkey + 1) AS k, p_size AS records, p_retailprice - 15 AS x0, p_retailprice + 15 AS x1, 10.0 * ((p_partkey + 1) % 97) - 495 AS y0, 10.0 * ((p_partkey + 1) % 97) - 465 AS y1, -5.0 AS z0, 5.0 AS z1,
           3000 / sqrt((p_partkey + 1)) AS e, NOT EXISTS (FROM part q WHERE (q.p_partkey + 1) // 2 = part.p_partkey + 1) AS leaf FROM part
), m AS (
    SELECT b.*, a.*, (x0 + x1) / 2 - px AS cx, (y0 + y1) / 2 - py AS cy, (z0 + z1) / 2 - pz AS cz, (x1 - x0) / 2 AS hx, (y1 - y0) / 2 AS hy, (z1 - z0) / 2 AS hz FROM b, a
), p AS (
    SELECT *, cx * fx + cy * fy + cz * fz AS depth, sqrt(hx * hx + hy * hy + hz * hz) AS size,
           sqrt(pow(greatest(x0 - px, 0, px - x1), 2) + pow(greatest(y0 - py, 0, py - y1), 2) + pow(greatest(z0 - pz, 0, pz - z1), 2)) AS away,
           list_bool_and(list_transform([[fx, fy, fz], [fx * tx + rx, fy * tx + ry, fz * tx + rz], [fx * tx - rx, fy * tx - ry, fz * tx - rz], [fx * ty + ux, fy * ty + uy, fz * ty + uz], [fx * ty - ux, fy * ty - uy, fz * ty - uz]],
               lambda n: cx * n[1] + cy * n[2] + cz * n[3] + hx * abs(n[1]) + hy * abs(n[2]) + hz * abs(n[3]) >= 0)) AS visible
    FROM m
), s AS (
    SELECT k, k // 2 AS parent, records, leaf, visible, CASE WHEN visible THEN size * focal / greatest(depth - size, 1e-6) ELSE 0 END AS radius, e * focal / greatest(greatest(away, 1e-6), e) AS scene, focal FROM p
), v AS (
    SELECT *, CASE WHEN visible AND NOT leaf THEN greatest(scene, least(radius, focal) / 64) ELSE 0 END AS error,
           visible AND EXISTS (FROM s q WHERE q.parent = s.k AND q.visible) AS refinable FROM s
), down AS (
    SELECT v.*, CAST('inf' AS DOUBLE) AS until FROM v WHERE k = 1
    UNION ALL SELECT v.*, least(down.until, CASE WHEN down.refinable THEN down.error ELSE -1 END) FROM down JOIN v ON v.parent = down.k
), spans AS (
    SELECT k, records, error, radius, leaf, CASE WHEN refinable THEN error ELSE 0 END AS since, until FROM down WHERE visible AND (leaf OR refinable)
), budget AS (
    SELECT sum(p_size) // 9 AS budget FROM part
), thresholds AS (
    SELECT bound, row_number() OVER (ORDER BY bound) AS n FROM (SELECT 0.0::DOUBLE AS bound UNION SELECT error FROM v WHERE visible AND NOT leaf AND error > 0)
), costs AS (
    SELECT n, bound, (SELECT COALESCE(sum(records), 0) FROM spans WHERE since <= bound AND until > bound) AS cost FROM thresholds
), search(lo, hi, found) AS (
    SELECT 1::BIGINT, max(n), CASE WHEN (SELECT cost FROM costs WHERE bound = 0) <= (SELECT budget FROM budget) THEN 0.0::DOUBLE END FROM costs
    UNION ALL
    SELECT CASE WHEN cost <= budget THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN cost <= budget THEN (lo + hi) // 2 - 1 ELSE hi END, CASE WHEN cost <= budget THEN bound ELSE found END
    FROM search JOIN costs ON n = (lo + hi) // 2, budget WHERE lo <= hi AND NOT (found IS NOT NULL AND found = 0.0)
), chosen AS (
    SELECT found AS threshold FROM search ORDER BY hi - lo LIMIT 1
)
SELECT k AS node, records, round(error, 4) AS error, round(radius, 2) AS radius, leaf AS exact, round(threshold, 4) AS threshold FROM spans, chosen WHERE since <= threshold AND until > threshold
""")
def tile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles of a tree of all parts to show from a camera, with a ninth of their records as budget."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    k, size, price = F.col("p_partkey") + 1, F.col("p_size"), F.col("p_retailprice")
    parents = part.select(F.floor(k / 2).alias("__parent")).distinct()
    low = [price - 15, 10.0 * (k % 97) - 495, F.lit(-5.0)]
    high = [price + 15, 10.0 * (k % 97) - 465, F.lit(5.0)]
    nodes = part.join(parents, k == F.col("__parent"), "left").withColumn("leaf", F.col("__parent").isNull())
    nodes = nodes.select(k.alias("node"), F.when(k > 1, F.floor(k / 2)).alias("parent"), size.cast("long").alias("records"), "leaf", seen(_CAMERA, low, high, 3000 / F.sqrt(k), ~F.col("leaf")).alias("s"))
    nodes = nodes.select("node", "parent", "records", "leaf", "s.*")
    budget = part.agg(F.floor(F.sum("p_size") / 9)).first()[0]
    found = trees.best_cut(nodes, budget, 2.0)
    return found.select("node", "records", F.round("error", 4).alias("error"), F.round("radius", 2).alias("radius"), "exact", F.round("threshold", 4).alias("threshold"))
