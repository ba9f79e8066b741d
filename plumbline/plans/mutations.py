"""Registered queries of mutations: the tables as they are after each change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import mutations, ranking

from .catalogue import query, table


@query("""
WITH t AS (SELECT o_orderkey AS id, o_custkey % 4 AS version, o_orderstatus AS payload FROM orders),
c AS (SELECT l_orderkey AS id, min(l_linenumber % 4) AS version, min(l_returnflag) AS payload FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey UNION ALL SELECT -1 - s_suppkey, 0, 'N' FROM supplier)
SELECT coalesce(t.id, c.id) AS id, CASE WHEN t.version = c.version THEN t.version + 1 ELSE t.version END AS version, CASE WHEN t.version = c.version THEN c.payload ELSE t.payload END AS payload,
       CASE WHEN t.id IS NULL THEN 'missing' WHEN t.version = c.version THEN 'updated' WHEN c.id IS NOT NULL THEN 'conflict' END AS outcome
FROM t FULL JOIN c ON t.id = c.id
""")
def optimistic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that expect a version, against rows that may have moved on."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("version"), F.col("o_orderstatus").alias("payload"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("id"))
    changes = lines.agg(F.min(F.col("l_linenumber") % 4).cast("long").alias("version"), F.min("l_returnflag").alias("payload"))
    strangers = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.lit(0).cast("long").alias("version"), F.lit("N").alias("payload"))
    return mutations.optimistic_update(rows, changes.unionByName(strangers), "id", "version", "payload")


_STATES = "CASE WHEN o_orderstatus = 'F' THEN 'deleted' WHEN o_orderstatus = 'O' THEN 'live' ELSE 'reviewed' END"
_ACTIONS = "CASE WHEN o_orderpriority < '2' THEN 'delete' WHEN o_orderpriority < '3' THEN 'restore' WHEN o_orderpriority < '4' THEN 'review' WHEN o_orderpriority < '5' THEN 'unreview' ELSE 'unknown' END"


@query(f"""
WITH t AS (SELECT o_orderkey, {_STATES} AS state, {_ACTIONS} AS action FROM orders),
n AS (SELECT *, CASE WHEN action = 'delete' AND state IN ('live', 'reviewed') THEN 'deleted' WHEN action = 'restore' AND state = 'deleted' THEN 'live' WHEN action = 'review' AND state = 'live' THEN 'reviewed' WHEN action = 'unreview' AND state = 'reviewed' THEN 'live' END AS next FROM t)
SELECT o_orderkey, coalesce(next, state) AS state, next IS NOT NULL AS changed FROM n
""")
def lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions, restorations and reviews, with those that do nothing."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_STATES).alias("state"), F.expr(_ACTIONS).alias("action"))
    return mutations.transition(rows, "state", F.col("action")).drop("action")


@query("""
WITH c AS (SELECT p_brand, min(p_partkey) AS p_partkey FROM part WHERE p_size > 45 GROUP BY p_brand)
SELECT part.p_partkey, part.p_brand, CASE WHEN c.p_partkey IS NULL THEN p_size > 25 ELSE part.p_partkey = c.p_partkey END AS is_default FROM part LEFT JOIN c ON part.p_brand = c.p_brand
""")
def one_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One default of each brand that names one."""
    part = table(spark, sf_dir, "part")
    chosen = part.where("p_size > 45").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    rows = part.select("p_partkey", "p_brand", (F.col("p_size") > 25).alias("is_default"))
    return mutations.one_default(rows, ["p_brand"], "p_partkey", "is_default", chosen)


@query("""
WITH l AS (SELECT DISTINCT user_id || ':' || event_type AS k FROM events WHERE value > 60), e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN user_id || ':' || event_type END AS k FROM events)
SELECT event_id, k FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS rn FROM e) WHERE k IS NULL OR (rn = 1 AND k NOT IN (SELECT k FROM l))
""")
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose idempotency key the ledger lacks, each key once."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("k")
    events = table(spark, sf_dir, "events")
    ledger = events.where("value > 60").select(key).distinct()
    entries = events.select("event_id", F.when(F.col("event_type") != "view", key).alias("k"))
    return mutations.append_once(ledger, entries, "k", [F.asc("event_id")])


@query("""
WITH h AS (SELECT c_nationkey, c_custkey % 5 AS version, max(c_mktsegment) AS plan FROM customer GROUP BY 1, 2), n AS (SELECT s_nationkey AS c_nationkey, min(CASE WHEN s_acctbal > 3000 THEN 'BUILDING' ELSE 'MACHINERY' END) AS plan FROM supplier GROUP BY 1),
l AS (SELECT c_nationkey, max(version) AS version, arg_max(plan, version) AS plan FROM h GROUP BY 1)
SELECT n.c_nationkey, coalesce(l.version, 0) + 1 AS version, n.plan FROM n LEFT JOIN l USING (c_nationkey) WHERE l.version IS NULL OR l.plan IS DISTINCT FROM n.plan
""")
def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New versions of policies that change."""
    history = table(spark, sf_dir, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 5).alias("version")).agg(F.max("c_mktsegment").alias("plan"))
    wanted = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min(F.when(F.col("s_acctbal") > 3000, "BUILDING").otherwise("MACHINERY")).alias("plan"))
    return mutations.next_versions(history, wanted, "c_nationkey", "version", ["plan"])


@query("""
SELECT event_id, CASE WHEN event_type = 'error' AND value > 20 THEN 'pending' WHEN event_type = 'error' THEN 'dead' ELSE 'published' END AS status, CASE WHEN event_type = 'error' AND value > 20 THEN 0 ELSE 8 END AS attempts FROM events
""")
def replay_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead rows of an outbox that are asked for again."""
    events = table(spark, sf_dir, "events")
    outbox = events.select("event_id", F.when(F.col("event_type") == "error", "dead").otherwise("published").alias("status"), F.lit(8).alias("attempts"))
    return mutations.replay_dead(outbox, events.where("value > 20").select("event_id"), "event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_orderstatus = 'P' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))")
def delete_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a deletion by condition or subquery leaves."""
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return mutations.delete_in(orders, F.col("o_orderstatus") == "P", poor, "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'stale' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose owner is in a subquery get another status."""
    chosen = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return mutations.update_in(orders, "o_custkey", chosen, {"o_orderstatus": F.lit("stale")}).drop("o_custkey")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 100000 THEN o_orderdate END DESC NULLS LAST, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS images FROM lineitem GROUP BY l_orderkey)
SELECT o_custkey, o_orderkey AS session, coalesce(images, 0) AS images FROM s LEFT JOIN n ON o_orderkey = l_orderkey WHERE rn = 1
""")
def first_session_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest finished session of each owner, undated ones last, with its count of files."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("done", F.when(F.col("o_totalprice") > 100000, F.col("o_orderdate")))
    newest = ranking.latest_per_key(orders, ["o_custkey"], [F.desc_nulls_last("done"), F.asc("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("session"))
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("images"))
    return newest.join(files, F.col("session") == F.col("l_orderkey"), "left").select("o_custkey", "session", F.coalesce("images", F.lit(0)).alias("images"))


_AGE = "datediff('day', o_orderdate, TIMESTAMP '1999-01-01')"
_CLAIMED = f"""
p AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 400 + c_nationkey * 20 END AS retention_days FROM customer),
r AS (SELECT o_orderkey FROM orders JOIN p ON o_custkey = c_custkey WHERE o_orderstatus IN ('F', 'P') AND {_AGE} >= retention_days)
"""


@query(f"WITH {_CLAIMED} SELECT o_orderkey FROM r")
def retention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished rows older than their owner's policy allows."""
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus", age.alias("days"))
    policies = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, 400 + F.col("c_nationkey") * 20).alias("retention_days"))
    return mutations.retention_plan(orders, policies, "c_custkey", "o_orderstatus", "days", ["F", "P"]).select("o_orderkey")


@query(f"WITH {_CLAIMED} SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM r) GROUP BY l_orderkey")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows that are left when retention removes their parents."""
    left = mutations.cascade(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey", retention_candidates(spark, sf_dir), "o_orderkey")
    return left.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


_RUN = "CASE WHEN event_type = 'view' THEN 'running' WHEN event_type = 'click' THEN 'succeeded' WHEN event_type = 'error' THEN 'failed' ELSE 'cancelled' END"


@query(f"""
WITH e AS (SELECT user_id, event_id AS t, {_RUN} AS s FROM events),
a AS (SELECT user_id, min(t) FILTER (WHERE s IN ('running', 'cancelled')) AS t1, count(*) AS n FROM e GROUP BY user_id),
b AS (SELECT a.user_id, t1, n, s AS s1 FROM a LEFT JOIN e ON e.user_id = a.user_id AND t = t1),
c AS (SELECT b.user_id, min(t) AS t2 FROM b JOIN e ON e.user_id = b.user_id WHERE s1 = 'running' AND t > t1 AND s <> 'running' GROUP BY b.user_id)
SELECT b.user_id, coalesce(e.s, s1, 'queued') AS state, n - CASE WHEN t1 IS NULL THEN 0 ELSE 1 END - CASE WHEN t2 IS NULL THEN 0 ELSE 1 END AS n_refused
FROM b LEFT JOIN c ON b.user_id = c.user_id LEFT JOIN e ON e.user_id = b.user_id AND e.t = c.t2
""")
def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's run after its events, and how many of them were refused."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_RUN).alias("state"))
    return mutations.run_states(events, "user_id", "event_id", "state")
