"""Changes of tables as new tables: optimistic updates, transitions, ledgers, versions, retention.

Spark's files are not updated in place. Each function takes the table as it is and gives the table as it is to
be, or the rows to append, so that a writer can put them in place in one commit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.shapes import geometry_problem
from plumbline.functions.text import colour, tags


def optimistic_update(table: DataFrame, changes: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """The table after changes (key, expected version, value), with `outcome`: updated, conflict or null.

    A change applies where its version is the row's, which then goes up by one. Changes to rows that are not
    there come out as `missing`, without a version. Of several changes to one row that expect the same version
    the one with the smallest value applies; the others are lost as they would be in a race.
    """
    one = changes.select(key).distinct()
    right = changes.groupBy(key, F.col(version).alias("__v")).agg(F.min(value).alias("__new"))
    joined = table.join(one.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "full_outer")
    joined = joined.join(right.withColumnRenamed(key, "__rk"), (F.col(key) == F.col("__rk")) & (F.col(version) == F.col("__v")), "left")
    hit, asked = F.col("__rk").isNotNull(), F.col("__k").isNotNull()
    outcome = F.when(F.col(key).isNull(), "missing").when(hit, "updated").when(asked, "conflict")
    changed = {value: F.when(hit, F.col("__new")).otherwise(F.col(value)), version: F.when(hit, F.col(version) + 1).otherwise(F.col(version)), key: F.coalesce(key, "__k")}
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in table.columns], outcome.alias("outcome"))


#: From which states an action leads where (fixed values).
TRANSITIONS = {
    "delete": {"live": "deleted", "reviewed": "deleted"},
    "restore": {"deleted": "live"},
    "review": {"live": "reviewed"},
    "unreview": {"reviewed": "live"},
}


def transition(table: DataFrame, state: str, action: Column) -> DataFrame:
    """Apply each row's action to its state; `changed` is false where the action does nothing there."""
    steps = F.create_map(*[F.lit(x) for a, moves in TRANSITIONS.items() for old, new in moves.items() for x in (f"{a}:{old}", new)])
    after = F.try_element_at(steps, F.concat_ws(":", action, F.col(state)))
    return table.withColumn("changed", after.isNotNull()).withColumn(state, F.coalesce(after, F.col(state)))


def one_default(table: DataFrame, scope: list[str], row_id: str, flag: str, chosen: DataFrame) -> DataFrame:
    """Clear a flag in each scope that has a chosen row (scope, row id), except on that row."""
    picked = chosen.select(*[F.col(c).alias(f"__{c}") for c in scope], F.col(row_id).alias("__id"))
    on = F.lit(True)
    for c in scope:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = table.join(picked, on, "left")
    return joined.withColumn(flag, F.when(F.col("__id").isNull(), F.col(flag)).otherwise(F.col(row_id) == F.col("__id"))).select(*table.columns)


def append_once(ledger: DataFrame, entries: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The entries to append: the first of each key that the ledger lacks. Entries without a key are all new."""
    keyed = entries.where(F.col(key).isNotNull())
    first = keyed.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")
    return first.join(ledger.select(key).distinct(), key, "left_anti").select(*entries.columns).unionByName(entries.where(F.col(key).isNull()))


def next_versions(history: DataFrame, wanted: DataFrame, key: str, version: str, values: list[str]) -> DataFrame:
    """The rows to append so that each key's latest version has the wanted values: only where any differs."""
    latest = history.groupBy(key).agg(F.max(F.struct(version, *values)).alias("__now"))
    joined = wanted.join(latest, key, "left")
    same = F.lit(True)
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"__now.{c}"))
    new = joined.where(F.col("__now").isNull() | ~same)
    return new.select(key, (F.coalesce(F.col(f"__now.{version}"), F.lit(0)) + 1).alias(version), *values)


def replay_dead(outbox: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    """Dead rows that are asked for become pending again, without attempts."""
    asked = ids.select(F.col(row_id).alias("__id")).distinct()
    joined = outbox.join(asked, F.col(row_id) == F.col("__id"), "left")
    again = F.col("__id").isNotNull() & (F.col("status") == "dead")
    return joined.withColumn("attempts", F.when(again, F.lit(0)).otherwise(F.col("attempts"))).withColumn("status", F.when(again, "pending").otherwise(F.col("status"))).drop("__id")


def delete_in(table: DataFrame, where: Column, keys: DataFrame, key: str) -> DataFrame:
    """DELETE ... WHERE condition OR key IN (keys); a null key is in no list."""
    return table.where(~F.coalesce(where, F.lit(False))).join(keys.select(F.col(keys.columns[0]).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def update_in(table: DataFrame, key: str, keys: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET changes WHERE key IN (keys)."""
    joined = table.join(keys.select(F.col(keys.columns[0]).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    hit = F.col("__k").isNotNull()
    return joined.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns])


def retention_plan(missions: DataFrame, policies: DataFrame, owner: str, state: str, updated_days: str, terminal: list[str], default_days: int | None = None) -> DataFrame:
    """Rows whose owner's policy (owner, retention_days) lets them go: in a terminal state and untouched for so many days."""
    days = F.coalesce("retention_days", F.lit(default_days)) if default_days is not None else F.col("retention_days")
    joined = missions.join(policies.select(F.col(owner).alias("__o"), "retention_days"), F.col(owner) == F.col("__o"), "left")
    return joined.where(F.col(state).isin(*terminal) & (F.col(updated_days) >= days)).select(*missions.columns)


def cascade(children: DataFrame, parent: str, removed: DataFrame, key: str) -> DataFrame:
    """What is left of child rows when parents are removed."""
    return children.join(removed.select(F.col(key).alias("__p")).distinct(), F.col(parent) == F.col("__p"), "left_anti")


def append_only(df: DataFrame, path: str, row_id: str) -> None:
    """Append rows to an audit table; an id that is there already is an error, as rows are never replaced."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(path).select(row_id)
        if df.join(known, row_id, "left_semi").limit(1).count():
            raise ValueError("rows of an audit table cannot be written again")
    df.write.mode("append").parquet(path)


#: States that a run may go to from each (fixed values).
RUN_STEPS = {"queued": ("running", "cancelled"), "running": ("succeeded", "failed", "cancelled")}


def run_states(events: DataFrame, run: str, order: str, state: str) -> DataFrame:
    """The state of each run after its events in order; an event that its state does not allow is refused and counted.

    A run begins as queued. Its longest chain of states has three links, so three aggregates settle it.
    """
    now = events.select(F.col(run).alias("run"), F.col(order).alias("at"), F.col(state).alias("to"))
    settled = now.groupBy("run").agg(F.count(F.lit(1)).alias("n_events")).select("run", "n_events", F.lit("queued").alias("state"), F.lit(None).cast(events.schema[order].dataType).alias("since"), F.lit(0).alias("n_taken"))
    for _ in range(2):
        allowed = F.lit(False)
        for old, new in RUN_STEPS.items():
            allowed = allowed | ((F.col("state") == old) & F.col("to").isin(*new))
        later = now.join(settled, "run").where((F.col("since").isNull() | (F.col("at") > F.col("since"))) & allowed)
        first = later.groupBy("run").agg(F.min(F.struct("at", "to")).alias("__n"))
        settled = settled.join(first, "run", "left").select(
            "run", "n_events", F.coalesce("__n.to", "state").alias("state"), F.coalesce("__n.at", "since").alias("since"), (F.col("n_taken") + F.col("__n").isNotNull().cast("int")).alias("n_taken")
        )
    return settled.select(F.col("run").alias(run), "state", (F.col("n_events") - F.col("n_taken")).alias("n_refused"))


def inserted_features(requests: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Features that requests create, and the audit rows of their creation.

    `requests` has id, mission, geometry (GeoJSON), name, description, color, tags, actor. Names and descriptions are trimmed,
    colours and tags brought into their forms. A request with an unsound geometry or an empty name creates nothing; its
    audit row has the problem instead of the new state. Of requests with one id the smallest geometry counts.
    """
    one = requests.groupBy("id").agg(F.min(F.struct("geometry", *[c for c in requests.columns if c not in ("id", "geometry")])).alias("r")).select("id", "r.*")
    named = one.withColumns({"name": F.trim(F.coalesce("name", F.lit(""))), "description": F.trim(F.coalesce("description", F.lit(""))), "color": colour(F.col("color")), "tags": tags(F.coalesce("tags", F.array().cast("array<string>")))})
    judged = named.withColumn("problem", F.when(F.col("name") == "", "name").otherwise(geometry_problem(F.col("geometry"))))
    judged = judged.withColumns({"source": F.lit("manual"), "created_at": at})
    created = judged.where("problem IS NULL").drop("problem")
    after = F.when(F.col("problem").isNull(), F.to_json(F.struct("color", "description", "geometry", "mission", "name", "source", "tags")))
    audit = judged.select("id", "mission", F.when(F.col("problem").isNull(), "created").otherwise("refused").alias("action"), F.lit(None).cast("string").alias("before_state"), after.alias("after_state"), "problem", F.col("actor"), F.col("created_at").alias("at"))
    return created, audit
