"""Registered queries over the shared tables and, where SQL can express them, their DuckDB equivalents.

Floating-point results are rounded on both sides, as the order of a sum differs from run to run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry, text
from plumbline.operators import graph, ranking, relational, sequences, spatial, stateful, statistics, suppression

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "feature_search"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c: Column, digits: int = 4) -> Column:
    return F.round(c, digits)


@query("""
SELECT d.doc_id, d.source, d.n_chars, l.quality,
       row_number() OVER (ORDER BY d.n_chars DESC, d.doc_id) AS position,
       count(*) OVER () > 200 AS truncated
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE d.text ILIKE '%the%' AND d.lang IN ('en', 'de') AND (l.quality IS NULL OR l.quality >= 1) AND d.n_chars >= 200
ORDER BY position LIMIT 200
""")
def feature_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, set, range and joined predicates, the longest 200 documents and whether there were more."""
    found = relational.feature_search(
        table(spark, sf_dir, "documents"), "the", ("text",), one_of={"lang": ["en", "de"]}, at_least={"n_chars": 200}
    ).select("doc_id", "source", "n_chars")
    joined = found.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    good = joined.where(F.col("quality").isNull() | (F.col("quality") >= 1))
    return ranking.top_n_truncated(good, [F.desc("n_chars"), F.asc("doc_id")], 200)


@query("SELECT doc_id, lang, source FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), lower('SRC1 '))")
def artifact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-folded substring search over joined columns, without wildcards."""
    docs = table(spark, sf_dir, "documents")
    return relational.folded_contains(docs, ["lang", "source", "text"], "SRC1 ").select("doc_id", "lang", "source")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey BETWEEN 100 AND 900 AND c_acctbal BETWEEN 0 AND 5000")
def bbox_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a closed box; both ranges reach the scan as pushed filters."""
    box = ("c_custkey", "c_acctbal", (100, 0, 900, 5000))
    return relational.feature_search(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), box=box)


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation))
""")
def tenant_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one tenant: a semi-join on owners, which are scoped themselves."""
    nation = table(spark, sf_dir, "nation").orderBy("n_name").limit(1)
    owners = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return orders.join(owners, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS units, min(epoch_us(o_orderdate)) AS oldest_us
FROM orders GROUP BY o_orderstatus, o_orderpriority
""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, units and oldest time of each status and class."""
    orders = table(spark, sf_dir, "orders")
    oldest = F.min(F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), _r(F.sum("o_totalprice"), 2).alias("units"), oldest.alias("oldest_us")
    )


@query("""
SELECT *, orders + lineitems + parts AS total FROM
 (SELECT CAST(coalesce(sum(CAST(round(o_totalprice) AS BIGINT)), 0) AS BIGINT) AS orders FROM orders),
 (SELECT CAST(coalesce(sum(CAST(round(l_extendedprice) AS BIGINT)), 0) AS BIGINT) AS lineitems FROM lineitem WHERE l_returnflag = 'R'),
 (SELECT CAST(coalesce(sum(CAST(p_size AS BIGINT)), 0) AS BIGINT) AS parts FROM part WHERE p_size > 100000)
""")
def storage_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over three sources, 0 for a source without rows, and their total."""
    parts = {
        "orders": (table(spark, sf_dir, "orders"), F.round("o_totalprice").cast("long")),
        "lineitems": (table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.round("l_extendedprice").cast("long")),
        "parts": (table(spark, sf_dir, "part").where("p_size > 100000"), F.col("p_size").cast("long")),
    }
    return relational.storage_totals(parts)


@query("""
SELECT o_orderkey, c_mktsegment, o_orderstatus FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
WHERE c_custkey IS NULL OR c_mktsegment = 'BUILDING'
""")
def left_outer_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join whose missing side passes the filter."""
    active = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    joined = orders.join(active, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.where("c_custkey IS NULL OR c_mktsegment = 'BUILDING'").select("o_orderkey", "c_mktsegment", "o_orderstatus")


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders,
       NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS none_finished
FROM customer
""")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners with children, and those without a child in one state, from one pass over the children."""
    children = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "F").alias("finished"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(children, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.col("o_custkey").isNotNull().alias("has_orders"), (~F.coalesce("finished", F.lit(False))).alias("none_finished"))


@query("""
SELECT o_custkey, sha256(string_agg(concat_ws(':', CAST(o_orderkey AS VARCHAR), o_orderstatus, CAST(epoch_us(o_orderdate) AS VARCHAR)), '|' ORDER BY o_orderkey)) AS revision,
       count(*) AS n_rows
FROM orders GROUP BY o_custkey
""")
def catalogue_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of each owner's rows in order."""
    orders = table(spark, sf_dir, "orders").withColumn("micros", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    return relational.revision_hash(orders, "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus", "micros"])


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM
 (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1
""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each owner."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return ranking.latest_per_key(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("""
SELECT p_partkey, p_brand, tier FROM
 (SELECT p_partkey, p_brand, p_retailprice, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_size // 5 ORDER BY p_retailprice DESC, p_partkey) = 1 THEN 0 ELSE 1 END AS tier FROM part)
ORDER BY tier, p_retailprice DESC, p_partkey LIMIT 400
""")
def best_per_cell_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each cell, then the best of the rest up to a capacity."""
    parts = table(spark, sf_dir, "part").withColumn("cell", F.expr("p_size div 5"))
    best = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return sequences.best_per_cell_then_fill(parts, ["p_brand", "cell"], best, 400).select("p_partkey", "p_brand", "tier")


@query("""
SELECT user_id, round(coalesce(sum(abs(value - before)), 0), 4) AS length, count(*) AS n FROM
 (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY user_id
""")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each user's path through its values in order."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    found = sequences.path_length(events, "user_id", ["event_id"], F.abs(F.col("value") - F.col("prev.value")))
    return found.withColumn("length", _r(F.col("length")))


@query("""
WITH s AS (
    SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + event_id % 3 AS seq, event_id FROM events
), f AS (
    SELECT user_id, seq, CASE WHEN lag(seq) OVER w IS NULL OR seq - lag(seq) OVER w <= 0 OR seq - lag(seq) OVER w > 3 OR abs(value - lag(value) OVER w) > 60 THEN 1 ELSE 0 END AS s
    FROM (SELECT user_id, seq, min(value) AS value FROM s GROUP BY user_id, seq) WINDOW w AS (PARTITION BY user_id ORDER BY seq)
), r AS (
    SELECT user_id, run, count(*) AS n, min(seq) AS first, max(seq) AS last
    FROM (SELECT user_id, seq, sum(s) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM f) GROUP BY user_id, run
)
SELECT user_id, CAST(run AS BIGINT) AS run, n, first, last FROM (SELECT *, max(n) OVER (PARTITION BY user_id) AS longest FROM r)
WHERE n >= greatest(3, 0.25 * longest)
""")
def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without gaps or jumps of each user, without the short ones."""
    from pyspark.sql.window import Window

    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    events = table(spark, sf_dir, "events").select("user_id", "value", (order + F.col("event_id") % 3).alias("seq"))
    steps = events.groupBy("user_id", "seq").agg(F.min("value").alias("value"))
    return sequences.passes(steps, "user_id", "seq", "value", 3, 60, 3)


@query("""
SELECT o_orderkey, o_custkey, turn FROM
 (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn FROM orders)
ORDER BY turn, o_custkey LIMIT 500
""")
def fair_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 rows when owners take turns."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ranking.round_robin(orders, "o_custkey", [F.asc("o_orderdate"), F.asc("o_orderkey")], 500).drop("o_orderdate")


@query("""
SELECT l_orderkey, l_linenumber, total FROM
 (SELECT l_orderkey, l_linenumber, count(*) OVER () AS total FROM lineitem WHERE l_returnflag = 'A') ORDER BY l_orderkey, l_linenumber LIMIT 50 OFFSET 100
""")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page in order, with the number of rows in all."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber")
    return ranking.page_with_total(lines, [F.asc("l_orderkey"), F.asc("l_linenumber")], 100, 50)


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 4) AS linear, round(quantile_disc(l_extendedprice, 0.95), 4) AS nearest_rank,
       round(max(CASE WHEN r = 1 + CAST(floor((n - 1) * 0.75) AS BIGINT) THEN l_extendedprice END), 4) AS floor_index,
       round(coalesce(median(CASE WHEN l_discount > 0 THEN l_discount END), -1), 4) AS median_positive
FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) GROUP BY l_returnflag
""")
def percentile_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four definitions of a percentile side by side."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_discount")
    price = statistics.quantiles(
        lines, ["l_returnflag"], F.col("l_extendedprice"),
        {"linear": ("linear", 0.9), "nearest_rank": ("nearest", 0.95), "floor_index": ("floor", 0.75)},
    )
    positive = statistics.median_of_positives(lines, ["l_returnflag"], F.col("l_discount"), -1.0, "median_positive")
    found = price.join(positive, "l_returnflag")
    return found.select("l_returnflag", *[_r(F.col(c)).alias(c) for c in ("linear", "nearest_rank", "floor_index", "median_positive")])


@query("""
WITH m AS (SELECT p_brand, median(abs(p_retailprice)) AS med, count(*) AS n FROM part GROUP BY p_brand),
d AS (SELECT p_brand, median(abs(abs(p_retailprice) - med)) AS mad FROM part JOIN m USING (p_brand) GROUP BY p_brand)
SELECT p_partkey, p_brand, n < 4 OR abs(p_retailprice) <= greatest(1.0, med + 0.5 * 1.4826 * mad) AS inlier FROM part JOIN m USING (p_brand) JOIN d USING (p_brand)
""")
def mad_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within a robust limit of their group."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return statistics.mad_inliers(parts, ["p_brand"], "p_retailprice", 1.0, 0.5).select("p_partkey", "p_brand", "inlier")


@query("""
SELECT event_type, user_id % 4 AS backend, count(*) AS runs, count(x) AS successes, round(min(x), 4) AS min, round(avg(x), 4) AS mean, round(median(x), 4) AS median,
       round(quantile_disc(x, 0.95), 4) AS p95, round(max(x), 4) AS max, round(stddev_samp(x), 4) AS std, round(1.96 * stddev_samp(x) / sqrt(count(x)), 4) AS ci95
FROM (SELECT *, CASE WHEN value > 5 THEN value END AS x FROM events) GROUP BY event_type, user_id % 4
""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each case and backend."""
    events = table(spark, sf_dir, "events").withColumn("backend", F.col("user_id") % 4)
    found = statistics.benchmark_summary(events, ["event_type", "backend"], "value", F.col("value") > 5)
    return found.select("event_type", "backend", "runs", "successes", *[_r(F.col(c)).alias(c) for c in ("min", "mean", "median", "p95", "max", "std", "ci95")])


@query("""
SELECT l_linestatus, count(x) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_pop(x), 4) AS std, round(sqrt(avg(x * x)), 4) AS rmse,
       round(quantile_cont(x, 0.05), 4) AS p05, round(quantile_cont(x, 0.95), 4) AS p95, round(min(x), 4) AS min, round(max(x), 4) AS max
FROM (SELECT l_linestatus, l_quantity AS x FROM lineitem) GROUP BY l_linestatus
""")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine statistics of the finite values of each group."""
    lines = statistics.describe(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_quantity"))
    return lines.select("l_linestatus", "n", *[_r(F.col(c)).alias(c) for c in ("mean", "median", "std", "rmse", "p05", "p95", "min", "max")])


@query("""
WITH c AS (SELECT floor(l_quantity / 2) AS cx, floor(l_discount * 100) AS cy, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT sum(n) AS total, count(*) AS occupied FROM c),
r AS (SELECT *, n / total AS p, row_number() OVER (ORDER BY n DESC, cx, cy) AS r FROM c, t)
SELECT max(occupied) AS occupied, round(max(occupied) / 400.0, 4) AS occupied_ratio, round(exp(-sum(p * ln(p))), 3) AS effective_cells,
       round(sum(CASE WHEN r <= ceil(occupied * 0.01) THEN p ELSE 0 END), 5) AS top1, round(sum(CASE WHEN r <= ceil(occupied * 0.05) THEN p ELSE 0 END), 5) AS top5,
       round(sum(CASE WHEN r <= ceil(occupied * 0.1) THEN p ELSE 0 END), 5) AS top10, round(median(n), 2) AS median, round(quantile_cont(n, 0.9), 2) AS p90 FROM r
""")
def grid_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly points fill a grid."""
    lines = table(spark, sf_dir, "lineitem")
    found = statistics.occupancy(lines, F.floor(F.col("l_quantity") / 2), F.floor(F.col("l_discount") * 100), 20, 20)
    digits = {"occupied_ratio": 4, "effective_cells": 3, "top1": 5, "top5": 5, "top10": 5, "median": 2, "p90": 2}
    return found.select("occupied", *[_r(F.col(c).cast("double"), d).alias(c) for c, d in digits.items()])


@query("""
WITH c AS (SELECT DISTINCT CAST(floor(l_quantity) AS BIGINT) AS x, CAST(floor(l_extendedprice / 20000) AS BIGINT) AS y FROM lineitem)
SELECT c.x, c.y FROM c JOIN (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) d(i, j) ON true JOIN c n ON n.x = c.x + d.i AND n.y = c.y + d.j
GROUP BY c.x, c.y HAVING count(*) = 8
""")
def coverage_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered cells whose eight neighbours are covered."""
    lines = table(spark, sf_dir, "lineitem")
    cells = lines.select(F.floor("l_quantity").alias("x"), F.floor(F.col("l_extendedprice") / 20000).alias("y"))
    return spatial.interior_cells(cells, "x", "y")


@query("""
WITH p AS (SELECT s_suppkey AS id, s_acctbal AS x, CAST(s_nationkey * 400 AS DOUBLE) AS y FROM supplier),
n AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.id <> b.id),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM n)
SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM r WHERE rank <= 8
""")
def knn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of 8 nearest neighbours."""
    points = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 400).cast("double").alias("y"))
    near = spatial.k_nearest(points, "s_suppkey", "s_acctbal", "y", 8, 1000.0)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@query("""
WITH n AS (SELECT a.p_partkey AS a, b.p_partkey AS b, sqrt(pow(a.p_retailprice - b.p_retailprice, 2) + pow(a.p_size - b.p_size, 2)) AS d
           FROM part a JOIN part b ON a.p_partkey <> b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 5 AND abs(a.p_size - b.p_size) <= 5)
SELECT a, b, round(d, 4) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS rank FROM n WHERE d <= 5) WHERE rank <= 3
""")
def radius_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest parts within a radius."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return spatial.radius_top_k(parts, "p_partkey", "p_retailprice", "p_size", 5.0, 3).withColumn("distance", _r(F.col("distance")))


@query("""
WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) / 10 AS u, (p_retailprice - 900) / 300 AS v FROM part),
g AS (SELECT i AS cell_col, j AS cell_row FROM range(0, 5) a(i), range(0, 4) b(j))
SELECT p_partkey, cell_col, cell_row,
       (CASE WHEN u = 5 THEN 4 ELSE floor(u) END) = cell_col AND (CASE WHEN v = 4 THEN 3 ELSE floor(v) END) = cell_row AS core
FROM p JOIN g ON u >= cell_col - 0.1 AND u <= cell_col + 1.1 AND v >= cell_row - 0.1 AND v <= cell_row + 1.1
""")
def cell_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core and buffer cells of each point."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_size").cast("double") / 10).alias("u"), ((F.col("p_retailprice") - 900) / 300).alias("v")
    )
    return spatial.assign_cells(parts, "u", "v", (0.0, 0.0), 1.0, (5, 4), 0.1).select("p_partkey", "cell_col", "cell_row", "core")


_BOXES = """
SELECT l_orderkey * 8 + l_linenumber AS id, min(l_returnflag) AS cls, min(l_quantity) AS x0, min(l_extendedprice) / 10 AS y0,
       min(l_quantity) + 1 + l_linenumber % 3 AS x1, min(l_extendedprice) / 10 + 2 AS y1 FROM lineitem GROUP BY l_orderkey, l_linenumber
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("cls"), F.min("l_quantity").alias("x0"), (F.min("l_extendedprice") / 10).alias("y0"))
    return rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "cls", "x0", "y0",
        (F.col("x0") + 1 + F.col("l_linenumber") % 3).alias("x1"), (F.col("y0") + 2).alias("y1"),
    )


_PAIRS = f"""
WITH boxes AS ({_BOXES}), cells AS (SELECT *, unnest(range(CAST(floor(y0 / 4) AS BIGINT), CAST(floor(y1 / 4) AS BIGINT) + 1)) AS cell FROM boxes), m AS (
    SELECT DISTINCT a.cls, a.id AS a, b.id AS b, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter,
           (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas
    FROM cells a JOIN cells b ON a.cls = b.cls AND a.cell = b.cell AND a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
)"""


@query(f"{_PAIRS} SELECT cls, a, b, round(inter / (areas - inter), 5) AS iou FROM m WHERE inter / (areas - inter) >= 0.4")
def bucket_dedupe_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes of one class that overlap enough."""
    pairs = spatial.overlapping_pairs(_boxes(spark, sf_dir), "id", ["cls"], ("x0", "y0", "x1", "y1"), 4.0, 0.4)
    return pairs.withColumn("iou", _r(F.col("iou"), 5))


@query()
def dedupe_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression of overlapping boxes, the largest and then the first one first."""
    boxes = _boxes(spark, sf_dir)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    ranked = ranking.global_rank(boxes.select("id", "cls", area.alias("area")), [F.desc("area"), F.asc("id")], "priority")
    placed = boxes.withColumn("area", area).withColumnsRenamed({"x0": "w", "y0": "s", "x1": "e", "y1": "n"})
    kept = suppression.first_of_boxes(placed, "cls", [-F.col("area"), F.col("id")], 0.4).withColumn("kept", F.lit(True))
    return ranked.join(kept, "id", "left").select("id", "cls", "priority", F.coalesce("kept", F.lit(False)).alias("kept"))


@query("""
WITH p AS (SELECT l_returnflag AS g, l_quantity AS w, l_extendedprice / 1000 AS x, l_discount AS y FROM lineitem),
s AS (SELECT g, sum(w) AS m, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy FROM p GROUP BY g)
SELECT g AS l_returnflag, round(m, 2) AS mass, round(sx / m, 4) AS mean_x, round(sy / m, 5) AS mean_y, round(sxx / m - (sx / m) * (sx / m), 3) AS cov_x_x,
       round(sxy / m - (sx / m) * (sy / m), 4) AS cov_x_y, round(syy / m - (sy / m) * (sy / m), 6) AS cov_y_y FROM s
""")
def group_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted centroids and covariances of groups."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_discount").alias("y"))
    m = statistics.group_moments(lines, "l_returnflag", F.col("l_quantity"), ["x", "y"])
    digits = {"mass": 2, "mean_x": 4, "mean_y": 5, "cov_x_x": 3, "cov_x_y": 4, "cov_y_y": 6}
    return m.select("l_returnflag", *[_r(F.col(c), d).alias(c) for c, d in digits.items()])


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 + 1 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 3 FROM part),
r(node, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE r.depth < 64)
SELECT node, min(depth) AS depth FROM r GROUP BY node
""")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one root reaches, and in how many steps."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    edges = part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2 + 1).alias("dst")).union(
        part.select("p_partkey", F.col("p_partkey") * 3)
    )
    return graph.reachable(edges, spark.createDataFrame([(1,)], "root long"), "src", "dst")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey * 2 + 1 AS dst FROM part UNION ALL SELECT p_partkey, p_partkey * 3 FROM part),
r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)
SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT node FROM r) AND p_size > 30
""")
def mark_and_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows that no root reaches."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    edges = part.select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 2 + 1).alias("dst")).union(
        part.select("p_partkey", F.col("p_partkey") * 3)
    )
    return graph.unreachable(part.where("p_size > 30"), "p_partkey", edges, spark.createDataFrame([(1,)], "root long"), "src", "dst")


@query("""
WITH RECURSIVE e AS (SELECT s_suppkey AS a, (s_suppkey * 7) % 50 AS b FROM supplier),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, other) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.node, u.b FROM r JOIN u ON r.other = u.a)
SELECT node, min(other) AS component FROM r GROUP BY node
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest member of each node's component."""
    nodes = table(spark, sf_dir, "supplier").select("s_suppkey")
    edges = nodes.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") * 7 % 50).alias("b"))
    found = graph.components(nodes.union(edges.select("b")), "s_suppkey", edges, "a", "b")
    return found.join(nodes, F.col("node") == F.col("s_suppkey"), "left_semi")


@query("""
SELECT p_partkey, layer, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY layer DESC) AS rn FROM
 (SELECT p_partkey, p_size, 0 AS layer FROM part UNION ALL SELECT p_partkey, p_size + 100, 1 FROM part WHERE p_size > 25
  UNION ALL SELECT p_partkey, p_size + 200, 2 FROM part WHERE p_brand > 'Brand#2')) WHERE rn = 1
""")
def overlay_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of one table, the last one first."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    second = part.where("p_size > 25").withColumn("p_size", F.col("p_size") + 100)
    third = part.where("p_brand > 'Brand#2'").withColumn("p_size", F.col("p_size") + 200)
    return relational.overlay_last_wins([part, second, third], "p_partkey").drop("p_brand")


@query("""
WITH e AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'A'), a AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P')
SELECT k, 'missing' AS status FROM e WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'unexpected' FROM a WHERE k NOT IN (SELECT k FROM e)
""")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and unexpected keys against the expected ones."""
    actual = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    expected = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("k"))
    return relational.set_difference(expected, actual, "k")


@query("""
WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderpriority <> '5-LOW'),
b AS (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderpriority <> '2-HIGH')
SELECT coalesce(a.k, b.k) AS k, a.v AS old_value, b.v AS new_value, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v
""")
def key_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two versions of a map."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), "o_orderpriority", "o_totalprice")
    new = orders.where("o_orderpriority <> '2-HIGH'").withColumn("v", F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("v")))
    return relational.key_diff(orders.where("o_orderpriority <> '5-LOW'"), new, "k", "v")


@query("""
WITH r AS (SELECT p_partkey, 300 + p_size * 37 AS w, 256 + p_size * 11 AS h FROM part),
x AS (SELECT p_partkey, w, h, CAST(floor((w - 256) / 192.0) AS BIGINT) AS nx, CAST(floor((h - 256) / 192.0) AS BIGINT) AS ny FROM r),
sx AS (SELECT p_partkey, w, h, ny, unnest(CASE WHEN w <= 256 THEN [0] WHEN w - 256 = nx * 192 THEN list_transform(range(0, nx + 1), lambda i: i * 192)
        WHEN w - 256 - nx * 192 < 64 AND nx >= 1 THEN list_append(list_transform(range(0, nx), lambda i: i * 192), w - 256)
        ELSE list_append(list_transform(range(0, nx + 1), lambda i: i * 192), w - 256) END) AS ox FROM x),
sy AS (SELECT p_partkey, w, h, ox, unnest(CASE WHEN h <= 256 THEN [0] WHEN h - 256 = ny * 192 THEN list_transform(range(0, ny + 1), lambda i: i * 192)
        WHEN h - 256 - ny * 192 < 64 AND ny >= 1 THEN list_append(list_transform(range(0, ny), lambda i: i * 192), h - 256)
        ELSE list_append(list_transform(range(0, ny + 1), lambda i: i * 192), h - 256) END) AS oy FROM sx)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY oy, ox) - 1 AS tile_index, CAST(ox AS INTEGER) AS offset_x, CAST(oy AS INTEGER) AS offset_y,
       CAST(least(256, w - ox) AS INTEGER) AS tile_width, CAST(least(256, h - oy) AS INTEGER) AS tile_height,
       (row_number() OVER (PARTITION BY p_partkey ORDER BY oy, ox) - 1) // 8 AS shard FROM sy
""")
def tile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles and shards of rasters of many sizes."""
    rasters = table(spark, sf_dir, "part").select("p_partkey", (300 + F.col("p_size") * 37).alias("w"), (256 + F.col("p_size") * 11).alias("h"))
    return sequences.tile_plan(rasters, "p_partkey", "w", "h", 256, 64, 8)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a path into their JSON."""
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return events.where("k IS NOT NULL")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE value > 20) GROUP BY event_type")
def inbox_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted once each, though many of them arrive twice."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return events.union(events.where("value > 20")).dropDuplicates(["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_STATUS = "CASE WHEN value > 110 THEN 'error' WHEN value > 100 THEN 'cancelled' WHEN value > 20 THEN 'success' ELSE 'processing' END"


@query(f"""
WITH l AS (SELECT user_id, event_type, arg_max({_STATUS}, event_id) AS state FROM events GROUP BY user_id, event_type)
SELECT user_id, CASE WHEN bool_or(state = 'error') THEN 'error' WHEN bool_or(state = 'cancelled') THEN 'cancelled'
       WHEN bool_and(state = 'success') AND count(DISTINCT CASE WHEN event_type IN ('click', 'view') THEN event_type END) = 2 THEN 'success' ELSE 'processing' END AS overall, count(*) AS services
FROM l GROUP BY user_id
""")
def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's overall status from the last state of its services."""
    events = table(spark, sf_dir, "events").withColumn("status", F.expr(_STATUS))
    return stateful.status_fold(events, "user_id", "event_type", "status", "event_id", ["click", "view"])


_STAGES = ["view", "search", "click", "purchase"]


@query(f"""
WITH e AS (SELECT user_id, list_position(['view', 'search', 'click', 'purchase'], event_type) AS p, event_id, {_STATUS} AS s, CAST(greatest(0, least(100, floor(value))) AS INT) AS n FROM events),
l AS (SELECT user_id, p, max(event_id) AS o, arg_max(s, event_id) AS s, arg_max(n, event_id) AS n FROM e WHERE p > 0 GROUP BY user_id, p),
a AS (SELECT k.user_id, t.p, l.o, l.n, CASE l.s WHEN 'processing' THEN 'running' WHEN 'success' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE l.s END AS s, (SELECT max(o) FROM l q WHERE q.user_id = k.user_id AND q.p > t.p) AS later
      FROM (SELECT DISTINCT user_id FROM l) k CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS p) t LEFT JOIN l ON l.user_id = k.user_id AND l.p = t.p)
SELECT user_id, ['view', 'search', 'click', 'purchase'][p] AS stage, CASE WHEN later IS NOT NULL AND (o IS NULL OR (s = 'running' AND later > o)) THEN 'succeeded' ELSE s END AS status,
       CASE WHEN later IS NOT NULL AND (o IS NULL OR (s = 'running' AND later > o)) THEN 100 ELSE n END AS progress
FROM a WHERE o IS NOT NULL OR later IS NOT NULL
""")
def stage_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's four stages; a later stage's event closes the earlier ones."""
    events = table(spark, sf_dir, "events").withColumn("status", F.expr(_STATUS)).withColumn("progress", F.floor("value"))
    return stateful.projected_stages(events, "user_id", "event_type", "status", "progress", "event_id", _STAGES)


_OUTBOX = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'publishing' ELSE 'published' END AS status, CAST(event_id % 9 AS INT) AS attempts,
       CAST(event_id % 1000 AS DOUBLE) AS available_at, CAST(event_id % 700 AS DOUBLE) AS locked_at FROM events
"""


@query(f"""
WITH o AS ({_OUTBOX})
SELECT *, attempts + 1 AS next_attempts, CASE WHEN attempts + 1 >= 8 THEN 'dead' ELSE 'failed' END AS next_status, 500 + least(300.0, 5 * pow(2, attempts)) AS next_available_at
FROM o WHERE (status IN ('pending', 'failed') AND available_at <= 500) OR (status = 'publishing' AND locked_at <= 500 - 60)
""")
def outbox_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due rows of an outbox and their state after a failure."""
    table(spark, sf_dir, "events").createOrReplaceTempView("outbox_events")
    outbox = spark.sql(_OUTBOX.replace("FROM events", "FROM outbox_events"))
    return stateful.outbox_step(outbox, F.lit(500.0), 60, 8, 5.0, 300.0)


@query("""
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT event_id, user_id, t, i, t AS last, CAST(1.0 AS DOUBLE) AS tokens, true AS allowed FROM e WHERE i = 1
      UNION ALL
      SELECT event_id, user_id, t, i, greatest(last, t), full_ - CASE WHEN full_ >= 1 THEN 1 ELSE 0 END, full_ >= 1
      FROM (SELECT e.*, b.last, least(2.0, b.tokens + greatest(0.0, e.t - b.last) * (1 / 3600)) AS full_ FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1))
SELECT event_id, user_id, allowed, round(tokens, 6) AS tokens FROM b
""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of each user's requests a token bucket lets through."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    events = table(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"))
    return stateful.token_bucket(events, "user_id", "at", ["at", "event_id"], 1 / 3600, 2.0).select("event_id", "user_id", "allowed", _r(F.col("tokens"), 6).alias("tokens"))


@query("""
WITH a AS (SELECT l_orderkey % 100 AS x, l_linenumber AS y, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_partkey % 100 AS x, l_linenumber AS y, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2)
SELECT count(*) AS n, round(avg(a.v - b.v), 4) AS bias, round(sqrt(avg((a.v - b.v) * (a.v - b.v))), 4) AS rmse, round(sqrt(var_pop(a.v - b.v)), 4) AS rmse_corrected,
       round(avg(abs(a.v - b.v)), 4) AS mae, round(20 * log10(50.0 / sqrt(avg((a.v - b.v) * (a.v - b.v)))), 4) AS psnr, round(corr(a.v, b.v), 4) AS correlation
FROM a JOIN b ON a.x = b.x AND a.y = b.y
""")
def raster_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two aligned rasters against each other."""
    lines = table(spark, sf_dir, "lineitem")
    grid = [lines.groupBy((F.col(k) % 100).alias("x"), F.col("l_linenumber").alias("y")).agg(F.avg("l_quantity").alias(v)) for k, v in (("l_orderkey", "a"), ("l_partkey", "b"))]
    found = grid[0].join(grid[1], ["x", "y"]).agg(*statistics.signed_difference("a", "b", 50.0))
    return found.select("n", *[_r(F.col(c)).alias(c) for c in found.columns if c != "n"])


@query("""
WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi, min(p_retailprice) AS lp, max(p_retailprice) AS hp, min(p_partkey) AS lk, max(p_partkey) AS hk FROM part),
q AS (SELECT p_partkey AS id, CAST(round_even((CAST(p_size AS DOUBLE) - lo) / (hi - lo) * 2097151, 0) AS BIGINT) AS x, CAST(round_even((p_retailprice - lp) / (hp - lp) * 2097151, 0) AS BIGINT) AS y,
             CAST(round_even((CAST(p_partkey AS DOUBLE) - lk) / (hk - lk) * 2097151, 0) AS BIGINT) AS z FROM part, e),
c AS (SELECT id, list_sum(list_transform(range(0, 21), lambda i: ((x >> i) & 1) * CAST(pow(2, 3 * i) AS HUGEINT) + ((y >> i) & 1) * CAST(pow(2, 3 * i + 1) AS HUGEINT) + ((z >> i) & 1) * CAST(pow(2, 3 * i + 2) AS HUGEINT))) AS code FROM q),
r AS (SELECT id, row_number() OVER (ORDER BY code, id) AS rank FROM c)
SELECT a.id AS a, b.id AS b, CAST(b.rank - a.rank AS INT) AS lead FROM r a JOIN r b ON b.rank - a.rank BETWEEN 1 AND 8
""")
def morton_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with the next eight in Z-order."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice", F.col("p_partkey").alias("k"))
    return spatial.morton_neighbours(part, "p_partkey", "p_size", "p_retailprice", "k", 8)


@query("""
SELECT c_custkey, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(lat - 43) / 2), 2) + cos(radians(43)) * cos(radians(lat)) * pow(sin(radians(lon - 1) / 2), 2)))), 2) AS metres,
       CAST(CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + least(60, greatest(1, floor((lon + 180) / 6) + 1)) AS INT) AS epsg
FROM (SELECT c_custkey, (c_custkey % 170) - 85.0 AS lat, (c_custkey * 7 % 360) - 180.0 AS lon FROM customer)
""")
def geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from a place, and the projected zone, of each point."""
    points = table(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 170) - 85.0).alias("lat"), ((F.col("c_custkey") * 7 % 360) - 180.0).alias("lon"))
    metres = geometry.haversine(F.lit(43.0), F.lit(1.0), F.col("lat"), F.col("lon"))
    return points.select("c_custkey", _r(metres, 2).alias("metres"), geometry.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


@query("""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || '__x-Y'), '[-_]', ' ', 'g'), '\\s+', ' ', 'g')) AS label,
       'org/blobs/sha256/' || substr(sha256(p_name), 1, 2) || '/' || sha256(p_name) AS key, CASE WHEN p_size % 2 = 0 THEN '#a0b' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS colour
FROM part
""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, content keys and colours."""
    part = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("#A0B"), F.lpad(F.col("p_size").cast("string"), 3, "0"))).otherwise("none")
    return part.select(
        "p_partkey", text.label(F.concat("p_name", F.lit("__x-Y"))).alias("label"),
        text.content_key(F.col("p_name"), F.lit("org")).alias("key"), text.colour(raw).alias("colour"),
    )


@query("""
WITH s AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS position, count(*) OVER () AS n FROM documents),
w AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 24.0, 0) AS BIGINT) AS p FROM range(0, 25) t(i), (SELECT count(*) AS n FROM documents))
SELECT doc_id, n_chars, position FROM s JOIN w ON position = p
""")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 evenly spaced rows of an order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return ranking.evenly_spaced(docs, [F.asc("n_chars"), F.asc("doc_id")], 25)


@query("SELECT * FROM (SELECT p_partkey, p_retailprice FROM part, (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.75) AS b FROM part) WHERE p_retailprice BETWEEN a - 0.25 * (b - a) AND b + 0.25 * (b - a))")
def iqr_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows near the quartiles."""
    return statistics.iqr_filter(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 0.25)


@query("""
WITH k AS (SELECT DISTINCT c_custkey, unnest([c_name, substr(c_name, 1, 15), c_mktsegment]) AS lookup FROM customer)
SELECT lookup, min(c_custkey) AS c_custkey FROM k WHERE lookup IS NOT NULL GROUP BY lookup HAVING count(DISTINCT c_custkey) = 1
""")
def unambiguous_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that name one row only."""
    return relational.unambiguous_lookup(table(spark, sf_dir, "customer"), "c_custkey", [F.col("c_name"), F.substring("c_name", 1, 15), F.col("c_mktsegment")])


@query("""
WITH d AS (SELECT o_orderkey AS run, 'k' || (o_orderkey % 11) AS item FROM orders UNION ALL SELECT o_orderkey, 'k' || (o_orderkey % 5) FROM orders),
h AS (SELECT 'k' || i AS item FROM range(0, 8) t(i))
SELECT run, count(*) AS n_needed FROM d LEFT JOIN h USING (item) GROUP BY run HAVING count(*) = count(h.item)
""")
def dependency_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all of whose dependencies are there."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"))
    needs = orders.withColumn("item", F.concat(F.lit("k"), (F.col("run") % 11).cast("string"))).unionAll(orders.withColumn("item", F.concat(F.lit("k"), (F.col("run") % 5).cast("string"))))
    has = spark.range(8).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("item"))
    return relational.relational_division(needs, has, "run", "item")
