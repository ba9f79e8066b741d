"""Structured Streaming over typed events: validation, idempotent inbox, status fold, token buckets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from plumbline.operators.stateful import STAGE_ENDS, STAGE_STATES, overall_status

KINDS = ("status", "control", "dead_letter")
ENVELOPE = "schema_version int, event_id string, kind string, organization_id string, mission string, service string, status string, message string"


def typed(raw: DataFrame, col: str = "value") -> DataFrame:
    """Parse envelopes; `valid` tells whether kind, version and id are as they must be. The raw text stays."""
    parsed = raw.withColumn("e", F.from_json(F.col(col), ENVELOPE))
    ok = (F.col("e.schema_version") == 1) & F.col("e.kind").isin(*KINDS) & (F.length("e.event_id") > 0)
    return parsed.select(F.col(col).alias("raw"), "e.*", F.coalesce(ok, F.lit(False)).alias("valid"))


def inbox(events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Each event id once, however often it arrives; ids are kept without end, as a late repeat must not count."""
    return events.dropDuplicates([event_id])


def _together(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch, in order: a shuffle delivers them in any."""
    parts = list(batches)
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


def status_stream(events: DataFrame, key: str, service: str, status: str, order: str, required: list[str]) -> DataFrame:
    """Running status of each key: the last state of each service by a number that counts arrivals, and the overall one.

    An event that comes after a later one of its service changes nothing; one with a null service only tells that a key
    is there. The rule is that of `stateful.overall_status`, as in the batch form.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {s: (o, v) for s, v, o in zip(*state.get, strict=True)} if state.exists else {}
        rows = _together(batches, [order])
        for s, v, o in zip(rows[service], rows[status], rows[order], strict=True):
            if s is not None and (s not in known or o >= known[s][0]):
                known[s] = (int(o), v or "processing")
        state.update((list(known), [v for _, v in known.values()], [o for o, _ in known.values()]))
        overall = overall_status({s: v for s, (_, v) in known.items()}, required)
        yield pd.DataFrame({"key": [k[0]], "overall": [overall], "services": [len(known)], "n_events": [len(rows)]})

    return events.groupBy(key).applyInPandasWithState(
        fold, "key string, overall string, services int, n_events int", "services array<string>, states array<string>, orders array<long>", "update", GroupStateTimeout.NoTimeout
    )


def rate_limited(events: DataFrame, key: str, at: str, per_second: float, burst: float, forget: bool = False) -> DataFrame:
    """Requests with `allowed` by a token bucket for each key, kept between micro-batches, in the order of their times.

    With `forget` a bucket that nobody asks for as long as it takes to fill is dropped: a new one is as full. A query
    with such timeouts runs until it is stopped, so that `availableNow` does not end it.
    """
    idle = int(1000 * burst / per_second) + 1

    def bucket(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, None)
        times, allowed = _together(batches, [at])[at].astype("float64"), []
        for t in times:
            tokens = min(burst, tokens + max(0.0, t - (t if last is None else last)) * per_second)
            last = t if last is None else max(t, last)
            ok = tokens >= 1
            tokens -= ok
            allowed.append(bool(ok))
        yield pd.DataFrame({"key": [str(k[0])] * len(allowed), "at": times.to_numpy(), "allowed": allowed})
        state.update((float(tokens), float(last if last is not None else 0.0)))
        if forget:
            state.setTimeoutDuration(idle)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return events.groupBy(key).applyInPandasWithState(bucket, "key string, at double, allowed boolean", "tokens double, last double", "append", timeout)


def recent_history(events: DataFrame, key: str, event_id: str, order: str, most: int = 300) -> DataFrame:
    """The last events of each key, for whoever joins late: a row for each key that got some, ids oldest first."""

    def remember(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        rows = _together(batches, [order])
        held = sorted(held + list(zip(rows[event_id].astype(str), rows[order].astype("int64").tolist(), strict=True)), key=lambda x: x[1])[-most:]
        state.update(([x[0] for x in held], [x[1] for x in held]))
        yield pd.DataFrame({"key": [str(k[0])], "history": [[x[0] for x in held]]})

    return events.groupBy(key).applyInPandasWithState(remember, "key string, history array<string>", "ids array<string>, orders array<long>", "update", GroupStateTimeout.NoTimeout)


def staleness(events: DataFrame, key: str, after_ms: int) -> DataFrame:
    """`stale` turns false when a key has an event, and true when it has had none for so long.

    The query runs until it is stopped, as timeouts may always come.
    """

    def watch(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        silent = state.hasTimedOut
        if silent:
            state.remove()
        else:
            state.update((sum(len(b) for b in batches) + (state.get[0] if state.exists else 0),))
            state.setTimeoutDuration(after_ms)
        yield pd.DataFrame({"key": [str(k[0])], "stale": [bool(silent)]})

    return events.groupBy(key).applyInPandasWithState(watch, "key string, stale boolean", "n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def deliver(handle: Callable[[DataFrame], None], dead_letters: str, attempts: int = 3, halvings: int = 16) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function: tries a batch some times, then its halves, and so on to single rows.

    Rows that fail by themselves go to the dead letters with the error; the others are delivered. `handle` may
    get a row again after a failure, so it must bear that. Rows alike in all columns stay together.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            _delivered(batch, epoch, 0)
        finally:
            batch.unpersist()

    def _delivered(part: DataFrame, epoch: int, depth: int) -> None:
        if not part.limit(1).count():
            return
        error = None
        for _ in range(attempts):
            try:
                handle(part)
                return
            except Exception as raised:  # noqa: BLE001  whatever the handler raises sends rows to the dead letters
                error = raised
        if depth < halvings and part.distinct().limit(2).count() == 2:
            side = F.shiftright(F.xxhash64(F.to_json(F.struct(*part.columns))), depth).bitwiseAND(1)
            for bit in (0, 1):
                _delivered(part.where(side == bit), epoch, depth + 1)
            return
        part.withColumn("epoch", F.lit(epoch)).withColumn("error", F.lit(str(error)[:500])).write.mode("append").parquet(dead_letters)

    return run


def once_by_epoch(path: str) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink with a folder for each epoch: an epoch that is run again replaces itself.

    With `inbox` before it, each event is there once, and no batch reads what others wrote.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return run


def once_by_id(path: str, event_id: str = "event_id") -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` sink that appends only ids that the table at `path` lacks, for sources without an inbox.

    It reads the ids of the whole table for each batch; where that grows too long, `once_by_epoch` does not.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([event_id])
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(event_id), event_id, "left_anti")
        new.write.mode("append").parquet(path)

    return run


class _StageProjection(StatefulProcessor):
    """The stages of one key: of each the last event, and the last event of any later stage, which closes it."""

    def __init__(self, key: str, columns: tuple[str, str, str, str], stages: list[str]):
        self.key, self.columns, self.stages = key, columns, stages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("stages", "place int", "own long, status string, progress int, later long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        stage, status, progress, order = self.columns
        known = {k[0]: tuple(v) for k, v in self.known.iterator()}
        changed = set()
        events = pd.concat(list(rows))
        for at, state, done, o in zip(*[events[c] for c in (stage, status, progress, order)], strict=True):
            if at not in self.stages:
                continue
            place, o = self.stages.index(at), int(o)
            own = known.get(place, (None, None, None, None))
            if own[0] is None or o >= own[0]:
                known[place] = (o, STAGE_STATES.get(state, "running"), 0 if pd.isna(done) else max(0, min(100, int(done))), own[3])
                changed.add(place)
            for before in range(place):
                own = known.get(before, (None, None, None, None))
                if own[3] is None or o > own[3]:
                    known[before] = (*own[:3], o)
                    changed.add(before)
        out = []
        for place in sorted(changed):
            self.known.updateValue((place,), known[place])
            own, state, done, later = known[place]
            closed = state not in STAGE_ENDS and later is not None and (own is None or later > own)
            out.append((key[0], self.stages[place], "succeeded" if closed else state, 100 if closed else done))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "stage", "status", "progress"])


def stage_projection_stream(events: DataFrame, key: str, stage: str, status: str, progress: str, order: str, stages: list[str]) -> DataFrame:
    """The stages of each key that a micro-batch has touched, in their state after it: key, stage, status, progress.

    A map state keeps a few numbers for each stage. The result does not depend on the order of arrival and is that of
    `stateful.projected_stages` over all events so far: a late event of a stage that a later one has closed opens
    nothing, and an event older than the stage's last is ignored. Needs the RocksDB state store
    (`spark.sql.streaming.stateStore.providerClass`), as Spark's map states do.
    """
    schema = StructType([StructField(key, events.schema[key].dataType), StructField("stage", StringType()), StructField("status", StringType()), StructField("progress", IntegerType())])
    return events.groupBy(key).transformWithStateInPandas(_StageProjection(key, (stage, status, progress, order), stages), schema, "Update", "None")
