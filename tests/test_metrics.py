import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators.counter import Counter
from tidemark.operators.event import Event, Log
from tidemark.operators.gauge import Gauge, Stopwatch, Timer
from tidemark.operators.level import Level
from tidemark.plans.snapshot import snapshot
from tidemark.schema import float_, int_, json_, one_of, str_, ts

T0 = 1_788_616_980_000


def at(ms: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)


def writes(spark, rows, shape):
    return spark.createDataFrame([(at(r[0]), *r[1:]) for r in rows], f"ts timestamp_ntz, {shape}")


def cells(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---- counters ----

POOPS = Counter("dog_poops", {"park": str_(), "kind": one_of(["solid", "liquid"])}, resolution="1s", flush="5m", grace="0s")


def poops(spark):
    rows = [(T0 - 2000, "riverside", "solid", 2), (T0 - 1000, "riverside", "solid", 3), (T0 - 1000, "central", "solid", 9), (T0, "riverside", "solid", 1)]
    return POOPS.cells(writes(spark, rows, "park string, kind string, value long"))


def test_counter_sums_and_defaults(spark):
    rows = [(T0 + 1, "a", "solid", 2), (T0 + 999, "a", "solid", -5), (T0 + 1000, "a", "solid", None)]
    got = POOPS.cells(writes(spark, rows, "park string, kind string, value long"))
    assert cells(got, "bucket_ms", "dim_key", "value") == [(T0, "a|solid", -3), (T0 + 1000, "a|solid", 1)]
    assert POOPS.rows(got).schema.names == POOPS.row_schema().names
    assert POOPS.cells(writes(spark, rows[:1], "park string, kind string, value long").drop("value")).first().value == 1


@pytest.mark.parametrize("value", [1.5, 2.0**53, float("nan")])
def test_counter_refuses(spark, value):
    with pytest.raises(Exception, match="delta"):
        POOPS.cells(writes(spark, [(T0, "a", "solid", value)], "park string, kind string, value double")).collect()


def test_counter_total_must_be_exact(spark):
    top = 2**53 - 1
    with pytest.raises(Exception, match="beyond"):
        POOPS.cells(writes(spark, [(T0, "a", "solid", top), (T0, "a", "solid", 1)], "park string, kind string, value long")).collect()
    assert POOPS.cells(writes(spark, [(T0, "a", "solid", top), (T0, "a", "solid", 1), (T0, "a", "solid", -1)], "park string, kind string, value long")).first().value == top


def test_counter_declaration():
    for bad in ({"resolution": "10s", "flush": "25s"}, {"value": "text"}, {"grace": "x"}):
        with pytest.raises(ValueError):
            Counter("m", {}, **bad)
    with pytest.raises(ValueError):
        Counter("m", {"value": str_()})


# ---- snapshots ----


def test_snapshot_rows_and_ids(spark):
    rows = snapshot(POOPS, poops(spark), T0 + 400).collect()
    assert [(r.bucket_ts, r.park, r.value, r.bucket_open, r.bucket_elapsed_ms) for r in rows] == [
        (at(T0 - 2000), "riverside", 2, False, 1000),
        (at(T0 - 1000), "central", 9, False, 1000),
        (at(T0 - 1000), "riverside", 3, False, 1000),
        (at(T0), "riverside", 1, True, 400),
    ]
    shipped = {r.id for r in POOPS.rows(poops(spark)).collect()}
    assert {r.id for r in rows} == shipped


def test_snapshot_collapses(spark):
    c, now = poops(spark), T0 + 400
    roll = snapshot(POOPS, c, now, rollup="sum").collect()
    assert [(r.park, r.value, r.bucket_open, r.bucket_elapsed_ms) for r in roll] == [("central", 9, False, 1000), ("riverside", 6, True, 2400)]
    assert "id" not in roll[0].asDict() and "bucket_ts" not in roll[0].asDict()
    by = snapshot(POOPS, c, now, group_by=["kind"]).collect()
    assert [(r.bucket_ts, r.value) for r in by] == [(at(T0 - 2000), 2), (at(T0 - 1000), 12), (at(T0), 1)]
    assert "id" in snapshot(POOPS, c, now, group_by=["kind", "park"]).columns
    one = snapshot(POOPS, c, now, group_by=[], rollup="sum").collect()
    assert [(r.value, r.bucket_elapsed_ms) for r in one] == [(15, 2400)]
    assert snapshot(POOPS, c.limit(0), now, group_by=[], rollup="sum").count() == 0


def test_snapshot_filters_orders_and_limits(spark):
    c, now = poops(spark), T0 + 400
    assert snapshot(POOPS, c, now, dims={"park": "central"}).count() == 1
    assert snapshot(POOPS, c, now, complete=True).count() == 3
    assert [r.value for r in snapshot(POOPS, c, now, start=T0 - 1000, end=T0).collect()] == [9, 3]
    assert [r.value for r in snapshot(POOPS, c, now, order_by="value", limit=2).collect()] == [9, 3]
    assert [r.value for r in snapshot(POOPS, c, now, order_by="value", direction="asc").collect()] == [1, 2, 3, 9]
    assert snapshot(POOPS, c, now, limit=0).count() == 0
    for bad in ({"dims": {"x": 1}}, {"dims": {"kind": "gas"}}, {"start": -1}, {"start": 5, "end": 1}, {"rollup": "max"}, {"direction": "up"}, {"limit": -1}, {"limit": 1.5}, {"group_by": ["x"]}, {"order_by": "x"}):
        with pytest.raises(ValueError):
            snapshot(POOPS, c, now, **bad)


def test_gauge_merges(spark):
    g = Gauge("latency", {"park": str_()}, resolution="1s")
    rows = [(T0, "a", 10.0, 1), (T0, "a", 2.0, 2), (T0 + 1000, "a", 7.0, 3)]
    c = g.cells(writes(spark, rows, "park string, value double, seq long"))
    assert cells(c, "last", "min", "max", "sum", "count") == [(2.0, 2.0, 10.0, 12.0, 2), (7.0, 7.0, 7.0, 7.0, 1)]
    r = snapshot(g, c, T0 + 5000, rollup="sum").first()
    assert (r.last, r.min, r.max, r.sum, r["count"]) == (7.0, 2.0, 10.0, 19.0, 3)
    both = g.cells(writes(spark, [*rows, (T0 + 1000, "b", 5.0, 4)], "park string, value double, seq long"))
    assert snapshot(g, both, T0 + 5000, rollup="sum", group_by=[]).first().last is None
    assert [r.last for r in snapshot(g, both, T0 + 5000, group_by=[]).collect()] == [2.0, None]
    with pytest.raises(Exception, match="finite"):
        g.cells(writes(spark, [(T0, "a", float("inf"), 1)], "park string, value double, seq long")).collect()
    for bad in ((), ("min", "min"), ("avg",)):
        with pytest.raises(ValueError):
            Gauge("x", {}, aggregates=bad)


def test_timers(spark):
    t = Timer("took", {"route": str_(), "status": one_of(["ok", "error"])}, resolution="10s")
    c = t.cells(writes(spark, [(T0, "/", "ok", 1.23456)], "route string, status string, value double"))
    assert c.first().sum == 1.235 and t.rows(c).columns[-4:] == ["min", "max", "sum", "count"]
    with pytest.raises(Exception, match="duration"):
        t.cells(writes(spark, [(T0, "/", "ok", -1.0)], "route string, status string, value double")).collect()
    seen, clock = [], iter([1.0, 1.5, 2.0, 2.25])
    with Stopwatch(seen.append, {"route": "/"}, clock=lambda: next(clock), outcome="status"):
        pass
    with pytest.raises(KeyError), Stopwatch(seen.append, {"route": "/"}, clock=lambda: next(clock), outcome="status"):
        raise KeyError
    assert seen == [{"route": "/", "status": "ok", "value": 500.0}, {"route": "/", "status": "error", "value": 250.0}]


# ---- levels ----


def level(spark, rows, up_to, **settings):
    v = Level("queue_depth", {"queue": str_()}, resolution="10s", **settings)
    ops = writes(spark, [(T0 + 10_000 * b, "q", m, float(x), i) for i, (b, m, x) in enumerate(rows)], "queue string, mode string, value double, seq long")
    got = v.carried(v.cells(ops), T0 + 10_000 * up_to)
    return [((r.bucket_ms - T0) // 10_000, r.value) for r in got.orderBy("bucket_ms").collect()]


def test_level_carries_and_moves(spark):
    assert level(spark, [(0, "set", 5)], 4) == [(0, 5), (1, 5), (2, 5), (3, 5)]
    assert level(spark, [(0, "add", 2), (0, "add", 3), (2, "add", -1)], 4) == [(0, 5), (1, 5), (2, 4), (3, 4)]
    assert level(spark, [(0, "set", 5), (0, "add", 1), (1, "add", 1), (1, "set", 9), (1, "add", 1)], 2) == [(0, 6), (1, 10)]
    assert level(spark, [(2, "set", 9), (0, "set", 5), (1, "set", 7)], 3) == [(0, 5), (1, 7), (2, 9)]


def test_level_expires_and_revives(spark):
    assert level(spark, [(0, "set", 5)], 9, hold_for="30s") == [(0, 5), (1, 5), (2, 5), (3, 5)]
    assert level(spark, [(0, "set", 5), (6, "add", 2)], 8, hold_for="30s") == [(0, 5), (1, 5), (2, 5), (3, 5), (6, 2), (7, 2)]
    assert level(spark, [(0, "set", 5), (3, "add", 2)], 4, hold_for="30s") == [(0, 5), (1, 5), (2, 5), (3, 7)]
    with pytest.raises(ValueError):
        Level("x", {}, resolution="10s", hold_for="5s")


def test_level_cap(spark):
    got = level(spark, [(0, "set", 5)], 10_049)
    assert len(got) == 10_001 and got[:2] == [(0, 5), (49, 5)] and got[-1] == (10_048, 5)


def test_level_snapshots(spark):
    v = Level("depth", {"queue": str_()}, resolution="10s")
    c = v.cells(writes(spark, [(T0, "a", 5.0, 1), (T0, "b", 1.0, 2), (T0 + 20_000, "a", 7.0, 3)], "queue string, value double, seq long"))
    now = T0 + 34_000
    assert snapshot(v, c, now).count() == 8 and snapshot(v, c, now, complete=True).count() == 6
    assert snapshot(v, c, now, rollup="sum", group_by=[]).first().value == 8
    assert [r.value for r in snapshot(v, c, now, group_by=[]).collect()] == [6, 6, 8, 8]
    assert v.totals(c, now).first().value == 8 and v.current(c, now, {"queue": "a"}).first().value == 7


# ---- events and logs ----


def test_events_default_time_and_derive(spark):
    requests = Counter("requests", {"tenant": str_()}, resolution="1s")
    e = Event(
        "done",
        {"tenant": str_(), "tokens": int_().with_default(1), "when": ts().optional(), "extra": json_().optional()},
        sample=0,
        timestamp_field="when",
        derive={requests: lambda f: [(F.lit(1), {"tenant": f["tenant"]}), (f["tokens"], {"tenant": F.lit("all")})]},
    )
    df = spark.createDataFrame([("x", None, at(T0 + 5), None), ("y", 4, None, '{"a":1}')], "tenant string, tokens long, when timestamp_ntz, extra string")
    assert e.staged(df, T0 + 999).count() == 0
    c = requests.cells(e.derived(df, T0 + 999)[requests])
    assert cells(c, "bucket_ms", "tenant", "value") == [(T0, "all", 5), (T0, "x", 1), (T0, "y", 1)]
    full = Event("done", e.fields, timestamp_field="when").staged(df, T0 + 999).orderBy("ts").collect()
    assert [(r.ts, r.tokens) for r in full] == [(at(T0 + 5), 1), (at(T0 + 999), 4)]
    with pytest.raises(Exception, match="extra"):
        Event("done", e.fields).staged(df.withColumn("extra", F.lit("{no")), T0).collect()


def test_event_sampling(spark):
    df = spark.range(4000).select(F.col("id").alias("n"))
    got = Event("s", {"n": int_()}, sample=0.25, seed=3).staged(df, T0)
    assert 800 < got.count() < 1200 and got.first()._sample_rate == 0.25
    by = Event("s", {"n": int_()}, sample=lambda f: F.when(f["n"] < 10, 1.0).otherwise(0.0)).staged(df, T0)
    assert by.count() == 10
    for bad in ({"sample": 2}, {"durability": "durable", "sample": 0.5}, {"durability": "x"}, {"timestamp_field": "n"}):
        with pytest.raises(ValueError):
            Event("s", {"n": int_()}, **bad)


def test_evolved_records(spark):
    stored = spark.createDataFrame([("1", at(T0), "12", at(T0)), ("2", at(T0), "x", at(T0))], "id string, ts timestamp_ntz, n string, _ingested_at timestamp_ntz")
    e = Event("m", {"n": int_(), "more": float_().with_default(0.5), "gone": str_().optional()}, sample=1)
    rows = e.reread(stored).orderBy("id").collect()
    assert [(r.n, r.more, r.gone, r._sample_rate, r._misfits) for r in rows] == [("12", 0.5, None, 1.0, []), ("x", 0.5, None, 1.0, ["n"])]


def test_logs(spark):
    log = Log("app_log", {"request": str_().optional(), "service": str_()}, min_level="info").child(service="api")
    shape = "level string, message string, request string, error struct<name:string,message:string,stack:string>"
    df = spark.createDataFrame([("debug", "no", None, None), ("info", "hi", "r1", None), ("error", None, None, ("E", "bad", None)), ("warn", "own", None, ("E", "bad", "at x"))], shape)
    got = log.staged(df, T0).select("level", "message", "error_stack", "request", "service").collect()
    assert [tuple(r) for r in got] == [("info", "hi", None, "r1", "api"), ("error", "bad", "E: bad", None, "api"), ("warn", "own", "at x", None, "api")]
    with pytest.raises(ValueError):
        log.child(other=1)
    with pytest.raises(ValueError):
        Log("l", {"message": str_()})


def test_old_series_keys_are_read(spark):
    c = Counter("m", {"a": str_(), "n": int_().optional(), "d": str_().with_default("x")}, resolution="1s")
    stored = spark.createDataFrame([(T0, "one", 1), (T0, "one|5", 1), (T0, "one|no|z", 1)], "bucket_ms long, dim_key string, value long")
    stored = stored.withColumns({"a": F.lit(None).cast("string"), "n": F.lit(None).cast("long"), "d": F.lit(None).cast("string")})
    assert [(r.a, r.n, r.d, r._raw_n) for r in c.decoded(stored).collect()] == [("one", None, "x", None), ("one", 5, "x", None), ("one", None, "z", "no")]
