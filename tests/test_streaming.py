import json
import random
import time

from plumbline.operators import stateful
from plumbline.streaming import events as ev


def _drain(df, path, mode, **how):
    query = df.writeStream.outputMode(mode).format("memory").queryName(path).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(path).collect()


def _stream(spark, rows, schema, tmp_path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_typed_events(spark):
    good = {"schema_version": 1, "event_id": "e1", "kind": "status", "mission": "m", "status": "success", "more": 1}
    rows = [(json.dumps(good),), (json.dumps(good | {"kind": "other"}),), ("no json",), (None,)]
    got = [r["valid"] for r in ev.typed(spark.createDataFrame(rows, "value string")).collect()]
    assert got == [True, False, False, False]


def test_inbox_drops_repeats(spark, tmp_path):
    stream = _stream(spark, [("a", 1), ("b", 2), ("a", 3)], "event_id string, v long", tmp_path)
    assert sorted(r["event_id"] for r in _drain(ev.inbox(stream), "inbox", "append")) == ["a", "b"]


def test_status_stream(spark, tmp_path):
    rows = [("m1", "tiler", "success", 4), ("m1", "viewer", "error", 2), ("m2", "tiler", "success", 9), ("m2", "tiler", "error", 3), ("m3", "tiler", "success", 1), ("m3", "viewer", "processing", 2), ("m4", None, None, 1),
            ("m5", "tiler", "success", 1), ("m5", "viewer", "success", 1), ("m6", "viewer", "success", 1), ("m7", "tiler", None, 1), ("m8", "tiler", "success", 5), ("m8", "x", "cancelled", 5)]
    stream = _stream(spark, rows, "mission string, service string, status string, n long", tmp_path)
    got = {(r["key"], r["overall"], r["services"]) for r in _drain(ev.status_stream(stream, "mission", "service", "status", "n", ["tiler"]), "status", "update")}
    assert got == {("m1", "error", 2), ("m2", "success", 1), ("m3", "processing", 2), ("m4", "idle", 0), ("m5", "success", 2), ("m6", "processing", 1), ("m7", "processing", 1), ("m8", "cancelled", 2)}
    batch = stateful.status_fold(spark.createDataFrame(rows, "mission string, service string, status string, n long"), "mission", "service", "status", "n", ["tiler"])
    assert {tuple(r) for r in batch.collect()} == got


def test_rate_limit_stream(spark, tmp_path):
    stream = _stream(spark, [("k", 0.0), ("k", 1.0), ("k", 0.0), ("k", 0.0)], "k string, at double", tmp_path)
    got = [r["allowed"] for r in _drain(ev.rate_limited(stream, "k", "at", 1.0, 2.0), "limited", "append")]
    assert got == [True, True, False, True]


def test_delivery_and_idempotent_sink(spark, tmp_path):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 1)], "event_id string, v long")
    sink = ev.once_by_id(str(tmp_path / "sink"))
    sink(batch, 0)
    sink(batch, 1)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2

    def fail(_):
        raise RuntimeError("broken")

    ev.deliver(fail, str(tmp_path / "dead"))(batch, 7)
    assert spark.read.parquet(str(tmp_path / "dead")).select("epoch").distinct().collect()[0][0] == 7


def test_one_bad_row_does_not_cost_its_batch(spark, tmp_path):
    batch = spark.createDataFrame([(f"e{i}", i) for i in range(40)], "event_id string, v long")
    sink = ev.once_by_epoch(str(tmp_path / "good"))
    delivered = []

    def handle(part):
        ids = [r["event_id"] for r in part.collect()]
        if "e13" in ids:
            raise RuntimeError("e13 is broken")
        delivered.extend(ids)

    ev.deliver(handle, str(tmp_path / "dead"), attempts=2)(batch, 3)
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert [(r["event_id"], r["epoch"], r["error"]) for r in dead] == [("e13", 3, "e13 is broken")]
    assert sorted(delivered) == sorted(f"e{i}" for i in range(40) if i != 13)
    sink(batch, 3)
    sink(batch, 3)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 40


def test_history_and_staleness(spark, tmp_path):
    rows = [("a", f"e{i}", i) for i in range(7, 0, -1)] + [("b", "x", 1)]
    stream = _stream(spark, rows, "k string, id string, n long", tmp_path)
    got = {r["key"]: r["history"] for r in _drain(ev.recent_history(stream, "k", "id", "n", 3), "history", "update")}
    assert got == {"a": ["e5", "e6", "e7"], "b": ["x"]}


def _watched(df, name, want):
    """What a query that does not end has said as soon as it has said what is wanted."""
    query = df.writeStream.outputMode("update" if name == "stale" else "append").format("memory").queryName(name).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            got = sorted(tuple(r) for r in df.sparkSession.table(name).collect())
            if got == want:
                break
            time.sleep(1)
        return got
    finally:
        query.stop()


def test_timeouts(spark, tmp_path):
    stream = _stream(spark, [("a", 1.0), ("b", 1.0), ("b", 2.0)], "k string, at double", tmp_path)
    want = [("a", False), ("a", True), ("b", False), ("b", True)]
    assert _watched(ev.staleness(stream, "k", 500), "stale", want) == want
    allowed = [("a", 1.0, True), ("b", 1.0, True), ("b", 2.0, True)]
    assert _watched(ev.rate_limited(stream, "k", "at", 1.0, 1.0, forget=True), "forgetful", allowed) == allowed


STAGES = ["map", "train", "filter", "raster"]


def _stages_in_turn(rows):
    """Stages by folding events one by one in the order of their numbers."""
    out = {}
    for key, stage, status, progress, _ in sorted((r for r in rows if r[1] in STAGES), key=lambda r: r[4]):
        own = out.setdefault(key, {})
        own[stage] = ({"processing": "running", "success": "succeeded", "error": "failed", "cancelled": "cancelled"}.get(status, "running"), max(0, min(100, progress or 0)))
        for before in STAGES[: STAGES.index(stage)]:
            if own.get(before, ("queued",))[0] not in ("succeeded", "failed", "cancelled"):
                own[before] = ("succeeded", 100)
    return {(k, s, *v) for k, own in out.items() for s, v in own.items()}


def test_stage_projection(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"m{rng.randrange(12)}", rng.choice([*STAGES, "other", None]), rng.choice(["processing", "processing", "success", "error", "cancelled", "odd", None]), rng.choice([None, -5, 20, 70, 400]), n) for n in range(150)]
    # One success closes a stage for good unless it runs again, which only its own later events tell.
    schema = "mission string, stage string, status string, progress int, n long"
    columns = ("mission", "stage", "status", "progress", "n", STAGES)
    want = _stages_in_turn(rows)
    batch = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in stateful.projected_stages(batch, *columns).collect()} == want
    assert stateful.projected_stages(batch.limit(0), *columns).count() == 0
    shuffled = rng.sample(rows, len(rows))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(3):
            spark.createDataFrame(shuffled[50 * i : 50 * i + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        seen = []
        query = ev.stage_projection_stream(stream, *columns).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend((i, tuple(r)) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for _, r in sorted(seen, key=lambda x: x[0]):
        last[r[:2]] = r
    assert len({i for i, _ in seen}) == 3 and set(last.values()) == want
