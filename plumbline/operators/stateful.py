"""Per-key state over ordered rows, as batch queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def token_bucket(df: DataFrame, key: str, at: str, order: list[str], per_second: float, burst: float) -> DataFrame:
    """Add `allowed` and `tokens` (what is left) for each request of a key, in a total order. A null key is a key.

    A bucket starts full. Before each request it gains per_second for each second since the last one (never
    a negative time), up to the burst; a request takes one token if there is one. The rows of a key come to
    one task sorted, and are read in batches, with one number kept between them.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, allowed boolean, tokens double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, tokens, last = object(), burst, None
        for batch in batches:
            allowed, left = [], []
            keys = batch[key].astype(object).where(batch[key].notna(), None)
            for k, t in zip(keys, batch[at].astype("float64"), strict=True):
                if k != last_key:
                    last_key, tokens, last = k, burst, t
                tokens = min(burst, tokens + max(0.0, t - last) * per_second)
                last = max(t, last)
                ok = tokens >= 1
                tokens -= ok
                allowed.append(bool(ok))
                left.append(tokens)
            yield batch.assign(allowed=allowed, tokens=left)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


#: What an event's status makes of a stage, and the states that end one.
STAGE_STATES = {"processing": "running", "success": "succeeded", "error": "failed", "cancelled": "cancelled"}
STAGE_ENDS = ("succeeded", "failed", "cancelled")


def outbox_step(df: DataFrame, now: Column, lease_seconds: float, most_attempts: int, base: float, cap: float) -> DataFrame:
    """The due rows of an outbox (status, attempts, available_at, locked_at in seconds) and their next state if publishing fails."""
    due = (F.col("status").isin("pending", "failed") & (F.col("available_at") <= now)) | ((F.col("status") == "publishing") & (F.col("locked_at") <= now - lease_seconds))
    attempts = F.col("attempts") + 1
    delay = F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempts - 1))
    return df.where(due).select(
        *df.columns, attempts.alias("next_attempts"), F.when(attempts >= most_attempts, "dead").otherwise("failed").alias("next_status"), (now + delay).alias("next_available_at")
    )


def overall_status(states: dict[str, str | None], required: list[str]) -> str:
    """One status from the last states of services: any error, then any cancellation, then success if all services there
    are succeeded and all required ones are there; without services idle, else processing, as a missing state is."""
    if not states:
        return "idle"
    for first in ("error", "cancelled"):
        if first in states.values():
            return first
    return "success" if set(states.values()) == {"success"} and set(required) <= set(states) else "processing"


def status_fold(df: DataFrame, key: str, service: str, status: str, arrival: str, required: list[str]) -> DataFrame:
    """Last status of each service by arrival, and the key's overall status by the rule of `overall_status`.

    A row with a null service tells that a key is there.
    """
    last = df.groupBy(key, service).agg(F.max_by(status, arrival).alias("state"))
    known = F.col(service).isNotNull()
    state = F.when(known, F.coalesce("state", F.lit("processing")))
    here = F.count_distinct(F.when(F.col(service).isin(*required), F.col(service))) == len(set(required))
    overall = (
        F.when(F.count(service) == 0, "idle").when(F.bool_or(state == "error"), "error").when(F.bool_or(state == "cancelled"), "cancelled")
        .when(F.bool_and(state == "success") & here, "success").otherwise("processing")
    )
    return last.groupBy(key).agg(overall.alias("overall"), F.count(service).alias("services"))


def projected_stages(df: DataFrame, key: str, stage: str, status: str, progress: str, order: str, stages: list[str]) -> DataFrame:
    """The state of each stage of a key (key, stage, status, progress) from its events in the order of a number.

    A stage has the state of its last event (processing is running, success succeeded, error failed, cancelled itself,
    any other running) and its progress, within 0 and 100. One that has not ended is closed, as succeeded with all
    progress, by an event of a later stage after its own. A stage without an event is there only if one closes it.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage)).cast("int")
    state = F.coalesce(F.create_map(*[F.lit(x) for pair in STAGE_STATES.items() for x in pair])[F.col(status)], F.lit("running"))
    events = df.select(key, place.alias("__p"), F.col(order).alias("__o"), state.alias("__s"), F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(progress, F.lit(0)))).cast("int").alias("__n")).where("__p > 0")
    last = events.groupBy(key, "__p").agg(F.max(F.struct("__o", "__s", "__n")).alias("e")).select(key, "__p", "e.*")
    # A key has one row for each stage here, so the arrays and the window below are that short.
    every = last.groupBy(key).agg(F.collect_list(F.struct("__p", "__o", "__s", "__n")).alias("own"))
    spread = every.select(key, "own", F.explode(F.sequence(F.lit(1), F.lit(len(stages)))).alias("__p"))
    mine = F.get(F.filter("own", lambda e: e["__p"] == F.col("__p")), 0)
    later = F.array_max(F.transform(F.filter("own", lambda e: e["__p"] > F.col("__p")), lambda e: e["__o"]))
    closed = F.coalesce(~mine["__s"].isin(*STAGE_ENDS), F.lit(True)) & later.isNotNull() & (later > F.coalesce(mine["__o"], later - 1))
    out = spread.where(mine.isNotNull() | later.isNotNull()).withColumns({"status": F.when(closed, "succeeded").otherwise(mine["__s"]), "progress": F.when(closed, 100).otherwise(mine["__n"])})
    return out.select(key, F.array(*[F.lit(s) for s in stages])[F.col("__p") - 1].alias("stage"), "status", "progress")


def smoothed_velocity(df: DataFrame, key: str, at: str, value: str, alpha: float = 0.6, reset: float = 2.0) -> DataFrame:
    """Exponentially smoothed rate of change; starts again after a gap of more than `reset` seconds."""
    w = Window.partitionBy(key).orderBy(at)
    dt, dv = F.col(at) - F.lag(at).over(w), F.col(value) - F.lag(value).over(w)
    starts = F.when(dt.isNull() | (dt > reset) | (dt <= 0), 1).otherwise(0)
    rates = df.withColumn("__v", F.when(starts == 0, dv / F.nullif(dt, F.lit(0.0)))).withColumn("__s", starts)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, velocity double"

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = []
            for rate, first in zip(batch["__v"].astype("float64"), batch["__s"], strict=True):
                held = None if first else rate if held is None else held * (1 - alpha) + rate * alpha
                out.append(held)
            yield batch.drop(columns=["__v", "__s"]).assign(velocity=pd.array(out, dtype="Float64"))

    # One number is kept from row to row.
    return rates.repartition(key).sortWithinPartitions(key, at).mapInPandas(smooth, schema)


def planned_stages(selected: DataFrame, needs: DataFrame, given: DataFrame, version: str) -> DataFrame:
    """The first attempt of each selected stage: run, stage, status, inputs, idempotency_key.

    `selected` has run, stage and parameters (canonical JSON), `needs` has stage and upstream, `given` the artifacts that take the
    place of stages: run, stage, artifact. A stage is blocked while it needs another selected stage for which nothing is given,
    else queued. Its inputs are the artifacts given for what it needs, in order; the key is the SHA-256 of all that tells two
    attempts apart. Rows with a null run or stage are left out, repeated ones count once.
    """
    chosen = selected.where("run IS NOT NULL AND stage IS NOT NULL").dropDuplicates(["run", "stage"])
    wanted = chosen.select("run", "stage").join(needs.select("stage", "upstream").distinct(), "stage")
    inputs = given.groupBy("run", F.col("stage").alias("upstream")).agg(F.min("artifact").alias("artifact"))
    also = chosen.select("run", F.col("stage").alias("upstream"), F.lit(True).alias("here"))
    met = wanted.join(inputs, ["run", "upstream"], "left").join(also, ["run", "upstream"], "left")
    waits = F.coalesce(F.bool_or(F.col("artifact").isNull() & F.col("here").isNotNull()), F.lit(False))
    state = met.groupBy("run", "stage").agg(waits.alias("waits"), F.array_sort(F.collect_list("artifact")).alias("inputs"))
    out = chosen.join(state, ["run", "stage"], "left").withColumn("inputs", F.coalesce("inputs", F.array().cast("array<string>")))
    key = F.to_json(F.struct(F.lit(0).alias("attempt"), "inputs", "parameters", F.col("run").cast("string").alias("run"), "stage", F.lit(version).alias("version")), {"ignoreNullFields": "false"})
    return out.select("run", "stage", F.when(F.coalesce("waits", F.lit(False)), "blocked").otherwise("queued").alias("status"), "inputs", F.sha2(key, 256).alias("idempotency_key"))
