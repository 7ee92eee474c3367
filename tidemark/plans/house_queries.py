"""Queries that run a store or a house on a fixed clock, and what it shipped, kept or refused; the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import identity
from tidemark.functions.time import bucket_range, bucket_start, format_duration, parse_duration, timestamp
from tidemark.house import House
from tidemark.operators.base import Metric
from tidemark.operators.counter import Counter
from tidemark.operators.event import Event, Log
from tidemark.operators.gauge import Gauge, Stopwatch, Timer
from tidemark.operators.level import Level
from tidemark.plans.queries import _CELLS, _TS, DAY, EVENTS, HOUR, MS, NOW, OPENED, RANGE, _id, _stored, before_now, events, query, unit_events, worth
from tidemark.schema import check_name, check_shape, float_, int_, json_, misfit, one_of, str_
from tidemark.sources.ledger import Ledger
from tidemark.sources.shared import scratch
from tidemark.sources.staging import LocalStage

_ROWS = "make_timestamp(ms * 1000) AS bucket_ts, event_type, value"


class Shipped:
    """A sink that keeps what it gets in a table of its own, batch by batch; it can be told to fail."""

    def __init__(self, spark):
        self.spark, self.path, self.contexts, self.broken = spark, scratch(spark), [], False

    def __call__(self, rows, ctx) -> None:
        if self.broken:
            raise OSError("the sink is down")
        rows.withColumns({"batch": F.lit(len(self.contexts)), "metric": F.lit(ctx.metric)}).write.parquet(f"{self.path}/{ctx.metric}/{len(self.contexts)}")
        self.contexts.append(ctx)

    def rows(self, metric: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{metric}/{i}" for i, c in enumerate(self.contexts) if c.metric == metric])


class Clock:
    def __init__(self, ms: int = NOW):
        self.ms = ms

    def __call__(self) -> int:
        return self.ms


def _counter(sink: Callable | None = None, **options) -> Counter:
    return Counter("events_total", EVENTS.dims, **{"resolution": "1h", "flush": "1h", "grace": "0s", "write": sink, **options})


def _refused(what: Callable) -> bool:
    try:
        what()
    except (ValueError, RuntimeError, KeyError):
        return True
    return False


def _told(spark, rows: list[tuple], shape: str) -> DataFrame:
    return spark.createDataFrame(rows, shape)


# ---- scans ----


@query(f"SELECT {_ROWS} FROM {_CELLS} WHERE event_type = 'view'")
def series_scan(spark, sf_dir):
    store = _stored(spark, EVENTS, unit_events(before_now(spark, sf_dir)))
    return EVENTS.rows(store.read_buckets(EVENTS, dim_key="view")).drop("id")


@query(f"SELECT CAST(sum(value) AS BIGINT) AS total FROM {_CELLS} WHERE ms >= {OPENED - 5 * DAY} AND ms < {OPENED}")
def pushed_sum(spark, sf_dir):
    store = _stored(spark, EVENTS, unit_events(before_now(spark, sf_dir)))
    return _told(spark, [(store.sum_buckets(EVENTS, OPENED - 5 * DAY, OPENED),)], "total long")


@query("SELECT DISTINCT event_type AS dim_key FROM events")
def series_list(spark, sf_dir):
    return _stored(spark, EVENTS, unit_events(events(spark, sf_dir))).scan_series(EVENTS)


def _queued(spark, sf_dir) -> tuple[Event, Ledger]:
    e, store = Event("queued", {"event_id": int_()}), Ledger(spark, scratch(spark))
    store.append(e, e.staged(events(spark, sf_dir).select("event_id", F.col("ts").alias("at"), "seq"), NOW, ids=_id()))
    return e, store


@query(f"SELECT event_id FROM events WHERE epoch_ms(ts) >= {OPENED - 30 * HOUR} AND epoch_ms(ts) < {OPENED - 20 * HOUR} ORDER BY event_id LIMIT 200")
def pending_scan(spark, sf_dir):
    e, store = _queued(spark, sf_dir)
    return store.read_pending(e, OPENED - 30 * HOUR, OPENED - 20 * HOUR, 200).select("event_id")


@query("SELECT 'all' AS state, count(*) AS n FROM events UNION ALL SELECT 'claimed', count(*) FROM events UNION ALL SELECT 'settled', count(*) - 40 FROM events UNION ALL SELECT 'put back', count(*) - 40 FROM events")
def pending_count(spark, sf_dir):
    """Claimed records are pending until they are acknowledged, and again once they are put back."""
    e, store = _queued(spark, sf_dir)
    house = House(spark, store, [e], now=lambda: NOW)
    found = [("all", house.pending(e.name))]
    claim = store.claim_records(e, NOW, 40)
    found.append(("claimed", house.pending(e.name)))
    store.ack(claim, e)
    found.append(("settled", house.pending(e.name)))
    store.release(store.claim_records(e, NOW, 40))
    return _told(spark, [*found, ("put back", house.pending(e.name))], "state string, n long")


@query(f"SELECT arg_max(value, event_id) AS value FROM (SELECT * FROM events WHERE {RANGE} AND event_type = 'view') WHERE {MS} = (SELECT max({MS}) FROM events WHERE {RANGE} AND event_type = 'view')")
def level_one_key(spark, sf_dir):
    v = Level("last_value", {"event_type": str_()}, resolution="1h")
    return _stored(spark, v, worth(before_now(spark, sf_dir))).read_level(v, NOW, "view").select("value")


# ---- claims, flushes, turns ----


@query(f"SELECT 'settled' AS part, {_ROWS} FROM {_CELLS} WHERE ms >= {OPENED - DAY} UNION ALL SELECT 'recovered', {_ROWS} FROM {_CELLS} WHERE ms >= {OPENED - DAY}")
def claim_settles(spark, sf_dir):
    """Acknowledged windows are gone for good; those of a claim that nobody settles are live again after a while."""
    store = _stored(spark, EVENTS, unit_events(before_now(spark, sf_dir)))
    store.ack(store.claim(EVENTS, OPENED - DAY, NOW), EVENTS)
    settled = EVENTS.rows(store.read_buckets(EVENTS)).drop("id").withColumn("part", F.lit("settled"))
    store.claim(EVENTS, OPENED, NOW)
    store.recover(EVENTS, NOW + store.recover_after + 1)
    return settled.unionByName(EVENTS.rows(store.read_buckets(EVENTS)).drop("id").withColumn("part", F.lit("recovered")))


@query("SELECT * FROM (VALUES ('ack', FALSE), ('ack again', TRUE), ('release after ack', TRUE), ('release', FALSE), ('ack after release', TRUE), ('other kind', TRUE), ('over the rows', TRUE), ('over the series', TRUE), ('within', FALSE)) t(what, refused)")
def store_guards(spark, sf_dir):
    """What a store refuses: settling twice, a name with another kind, more rows or series than it may hold."""
    rows = unit_events(before_now(spark, sf_dir)).limit(50)
    store = _stored(spark, EVENTS, rows)
    first = store.claim(EVENTS, OPENED - DAY, NOW) or store.claim(EVENTS, 2**60, NOW)
    found = [("ack", _refused(lambda: store.ack(first, EVENTS))), ("ack again", _refused(lambda: store.ack(first, EVENTS))), ("release after ack", _refused(lambda: store.release(first)))]
    store.append(EVENTS, EVENTS.ops(rows))
    second = store.claim(EVENTS, 2**60, NOW)
    found += [("release", _refused(lambda: store.release(second))), ("ack after release", _refused(lambda: store.ack(second, EVENTS)))]
    gauge = Gauge(EVENTS.name, EVENTS.dims, resolution="1h")
    found.append(("other kind", _refused(lambda: store.append(gauge, gauge.ops(worth(events(spark, sf_dir)))))))
    many = _counter()
    found.append(("over the rows", _refused(lambda: Ledger(spark, scratch(spark), max_rows=49).append(many, many.ops(rows)))))
    found.append(("over the series", _refused(lambda: Ledger(spark, scratch(spark), max_series=2).append(many, many.ops(unit_events(events(spark, sf_dir)))))))
    found.append(("within", _refused(lambda: Ledger(spark, scratch(spark), max_rows=50, max_series=5).append(many, many.ops(rows)))))
    return _told(spark, found, "what string, refused boolean")


@query(
    f"""SELECT 'events_total' AS metric, sum(value)::DOUBLE AS total, count(*) AS rows FROM {_CELLS} WHERE ms < {OPENED}
    UNION ALL SELECT 'event_value', CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), (SELECT count(*) FROM {_CELLS} WHERE ms < {OPENED}) FROM events WHERE {RANGE} AND {MS} < {OPENED}
    UNION ALL SELECT 'queued', count(*), count(*) FROM events WHERE {RANGE}"""
)
def house_flush(spark, sf_dir):
    """One flush of a house ships the closed windows of its metrics, and all records."""
    sink = Shipped(spark)
    gauge = Gauge("event_value", EVENTS.dims, resolution="1h", flush="1h", grace="0s", write=sink)
    queue = Event("queued", {"event_id": int_()}, write=sink)
    house = House(spark, scratch(spark), [_counter(sink), gauge, queue], now=Clock())
    found = before_now(spark, sf_dir)
    house.write("events_total", unit_events(found))
    house.write("event_value", worth(found))
    house.write("queued", found.select("event_id", F.col("ts").alias("at"), "seq"))
    house.flush(parallel=1).raise_if_failed()
    totals = [sink.rows(c.metric).agg(F.first("metric").alias("metric"), F.count("*").alias("rows")).withColumn("total", F.lit(round(float(c.total), 2))) for c in sink.contexts]
    return totals[0].unionByName(totals[1]).unionByName(totals[2])


@query(f"SELECT CASE WHEN ms < {OPENED - HOUR} THEN 0 ELSE 1 END AS batch, {_ROWS} FROM {_CELLS} WHERE ms < {OPENED}")
def final_flush(spark, sf_dir):
    """With an hour's grace a flush leaves the last closed window; the end of the house ships it, the open one stays."""
    sink = Shipped(spark)
    house = House(spark, scratch(spark), [_counter(sink, grace="1h")], now=Clock())
    house.write("events_total", unit_events(before_now(spark, sf_dir)))
    house.flush().raise_if_failed()
    house.stop().raise_if_failed()
    return sink.rows("events_total").select("batch", "bucket_ts", "event_type", "value")


@query(f"SELECT {_ROWS}, CAST(2 AS INT) AS attempt FROM {_CELLS} WHERE ms < {OPENED}")
def failed_sink(spark, sf_dir):
    """A sink that fails gets the same rows once more, as the second attempt."""
    sink = Shipped(spark)
    house = House(spark, scratch(spark), [_counter(sink)], now=Clock())
    house.write("events_total", unit_events(before_now(spark, sf_dir)))
    sink.broken = True
    house.flush()
    sink.broken = False
    house.flush().raise_if_failed()
    return sink.rows("events_total").select("bucket_ts", "event_type", "value", F.lit(sink.contexts[0].attempt).alias("attempt"))


@query("SELECT * FROM (VALUES (0, 'shipped'), (30, 'cadence'), (53, 'cadence'), (54, 'shipped'), (60, 'cadence'), (120, 'shipped')) t(minute, outcome)")
def flush_cadence(spark, sf_dir):
    """A metric that ships hourly does not ship again before nine tenths of an hour have gone by."""
    clock, out = Clock(), []
    house = House(spark, scratch(spark), [Event("queued", {"event_id": int_()}, write=Shipped(spark), flush="1h")], now=clock)
    for minute in (0, 30, 53, 54, 60, 120):
        clock.ms = NOW + minute * 60_000
        house.write("queued", events(spark, sf_dir).limit(1).select("event_id", "seq"))
        out.append((minute, house.flush_one("queued").skipped or "shipped"))
    return _told(spark, out, "minute int, outcome string")


@query("SELECT * FROM (VALUES (0, 'a'), (30, ''), (54, 'b'), (60, ''), (108, 'a')) t(minute, holder)")
def turns(spark, sf_dir):
    """Of two processes one has the turn in each interval; the holder may give it back, others may not."""
    path, out = scratch(spark), []
    stores = {"a": Ledger(spark, path), "b": Ledger(spark, path)}
    for minute, order in ((0, "ab"), (30, "ba"), (54, "ba"), (60, "ab"), (108, "ab")):
        won = {p: t for p in order if (t := stores[p].take_turn("x", NOW + minute * 60_000, 54 * 60_000)) is not None}
        out.append((minute, "".join(won)))
    assert not stores["a"].return_turn("x", "no token") and stores["a"].return_turn("x", won["a"])
    return _told(spark, out, "minute int, holder string")


@query(f"SELECT 'immediate' AS source, {_ROWS} FROM {_CELLS} WHERE ms = {OPENED} UNION ALL SELECT 'flush', {_ROWS} FROM {_CELLS} WHERE ms < {OPENED}")
def immediate_delivery(spark, sf_dir):
    """A write sends the open window at once; the flush sends the closed ones."""
    sink = Shipped(spark)
    house = House(spark, scratch(spark), [_counter(sink)], now=Clock(), delivery="immediate")
    house.write("events_total", unit_events(before_now(spark, sf_dir)))
    house.flush().raise_if_failed()
    out = sink.rows("events_total").select("batch", "bucket_ts", "event_type", "value")
    sources = F.array(*[F.lit(c.source) for c in sink.contexts])
    return out.select(F.get(sources, "batch").alias("source"), "bucket_ts", "event_type", "value")


@query("SELECT * FROM (VALUES (0, 0), (50, 0), (59, 1), (60, 1), (119, 2)) t(minute, runs)")
def collect_once(spark, sf_dir):
    """A collector runs once in each window, shortly before its end."""
    clock, out = Clock(OPENED), []
    g = Gauge("queue_depth", {}, resolution="1h", flush="1h", write=Shipped(spark))
    house, ran = House(spark, scratch(spark), [g], now=clock), []
    house.collect("queue_depth", lambda m: ran.append(1), lead="5m")
    for minute in (0, 50, 59, 60, 119):
        clock.ms = OPENED + minute * 60_000
        house.run_collectors()
        out.append((minute, len(ran)))
    return _told(spark, out, "minute int, runs int")


@query(f"SELECT 'snapshot' AS part, {_ROWS} FROM {_CELLS} WHERE ms >= {OPENED - DAY} UNION ALL SELECT 'current', {_ROWS} FROM {_CELLS} WHERE ms = {OPENED}")
def house_reads(spark, sf_dir):
    house = House(spark, scratch(spark), [_counter()], now=Clock())
    house.write("events_total", unit_events(before_now(spark, sf_dir)))
    rows = house.snapshot(start=OPENED - DAY)["events_total"].select("bucket_ts", "event_type", "value").withColumn("part", F.lit("snapshot"))
    return rows.unionByName(house.current()["events_total"].select("bucket_ts", "event_type", "value").withColumn("part", F.lit("current")))


@query(f"SELECT 'derived' AS part, event_type, count(*) AS n FROM events WHERE {RANGE} GROUP BY ALL UNION ALL SELECT 'stored', event_type, count(*) FROM events WHERE {RANGE} AND user_id % 2 = 0 GROUP BY ALL")
def atomic_write(spark, sf_dir):
    """One write of many records counts all of them, and stages those that sampling keeps."""
    seen = Counter("seen", {"event_type": str_()}, resolution="1h")
    e = Event("kept", {"event_type": str_(), "user_id": int_()}, sample=lambda f: F.when(f["user_id"] % 2 == 0, 1.0).otherwise(0.0), derive={seen: lambda f: [(F.lit(1), {"event_type": f["event_type"]})]})
    house = House(spark, scratch(spark), [e, seen], now=Clock())
    house.write("kept", before_now(spark, sf_dir).select("event_type", "user_id", F.col("ts").alias("at"), "seq"))
    stored = house.store.read_pending(e).groupBy("event_type").agg(F.count("*").alias("n")).withColumn("part", F.lit("stored"))
    counted = house.store.read_buckets(seen).groupBy("event_type").agg(F.sum("value").alias("n")).withColumn("part", F.lit("derived"))
    return counted.unionByName(stored)


@query("SELECT event_id, CAST(((row_number() OVER (ORDER BY event_id)) - 1) // 30 AS INT) AS batch FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 100)")
def local_staging(spark, sf_dir):
    """Records of one process go in batches of thirty, the last ten once they have waited long enough."""
    sink, clock = Shipped(spark), Clock()
    stage = LocalStage(spark, Event("queued", {"event_id": int_()}, write=sink), max_size=30, max_age="10s", now=clock)
    stage.record_many([{"event_id": r.event_id} for r in events(spark, sf_dir).orderBy("event_id").limit(100).collect()])
    clock.ms += 10_000
    stage.poll()
    return sink.rows("queued").select("event_id", "batch")


# ---- keys, fields, shapes ----


@query("SELECT DISTINCT CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type || '|\\' END AS label, CAST(user_id % 7 AS BIGINT) AS shard FROM events")
def dim_key_decode(spark, sf_dir):
    """Dims read back from stored keys, absent ones and escapes among them."""
    c = Counter("labelled", {"label": str_().optional(), "shard": int_()}, resolution="1d")
    label = F.when(F.col("user_id") % 4 == 0, None).otherwise(F.concat("event_type", F.lit("|\\")))
    cells = c.cells(events(spark, sf_dir).select("ts", label.alias("label"), (F.col("user_id") % 7).alias("shard")))
    return c.decoded(cells.select("dim_key").distinct()).select("label", "shard")


@query("SELECT DISTINCT event_type || '!' AS raw, CAST(NULL AS BIGINT) AS event_type FROM events")
def evolved_keys(spark, sf_dir):
    """Keys written under an earlier declaration: what cannot be read now is absent, and its text is told."""
    old = Counter("seen", {"event_type": str_()}, resolution="1d")
    new = Counter("seen", {"event_type": int_().optional()}, resolution="1d")
    cells = old.cells(events(spark, sf_dir).select("ts", F.concat("event_type", F.lit("!")).alias("event_type")))
    return new.decoded(cells.select("dim_key").distinct()).select(F.col("_raw_event_type").alias("raw"), "event_type")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CAST(event_id AS VARCHAR) END AS n, CASE WHEN event_id % 3 = 0 THEN 'n' ELSE '' END AS misfits FROM events")
def evolved_records(spark, sf_dir):
    """Records written when a field was a text, read now that it is a number: those that do not fit ship as they are, and are named."""
    old, new = Event("seen", {"event_id": int_(), "n": str_()}), Event("seen", {"event_id": int_(), "n": int_()})
    n = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    rows = new.reread(old.staged(events(spark, sf_dir).select("event_id", n.alias("n"), "seq"), NOW, ids=_id()))
    return rows.select("event_id", F.col("n").cast("string").alias("n"), F.array_join("_misfits", ",").alias("misfits"))


@query("SELECT DISTINCT date_trunc('day', ts) AS bucket_ts, event_type FROM events")
def natural_keys(spark, sf_dir):
    """What names a shipped row besides its id."""
    c = Counter("daily", EVENTS.dims, resolution="1d")
    return c.rows(c.cells(unit_events(events(spark, sf_dir)))).select(*identity.natural_key(list(c.dims)))


@query(f"SELECT sha256('events_total/' || ms || '/' || event_type) AS id, value FROM {_CELLS}")
def own_hasher(spark, sf_dir):
    """Row ids by an expression of the user's."""
    identity.set_hasher(lambda parts: F.sha2(F.concat_ws("/", *parts), 256))
    try:
        return EVENTS.rows(EVENTS.cells(unit_events(before_now(spark, sf_dir)))).select("id", "value")
    finally:
        identity.set_hasher(None)


@query("SELECT event_type, '0.0' AS least, '0.0' AS most FROM events GROUP BY event_type")
def signless_zero(spark, sf_dir):
    """A reading of -0 is one of 0."""
    g = Gauge("zeros", EVENTS.dims, resolution="1d")
    cells = g.cells(worth(events(spark, sf_dir)).withColumn("value", -F.abs(F.col("value")) * 0.0))
    return cells.groupBy("event_type").agg(F.min("min").cast("string").alias("least"), F.max("max").cast("string").alias("most"))


@query(f"SELECT make_timestamp(b * 1000) AS bucket_ts, CAST(b - (b % {15 * 60_000}) = b AS BOOLEAN) AS on_grid FROM (SELECT unnest(generate_series({OPENED - 2 * HOUR - HOUR}, {NOW}, {15 * 60_000})) AS b) WHERE b < {NOW}")
def window_starts(spark, sf_dir):
    """Starts of the windows that a range touches, the one its start falls into first."""
    found = bucket_range(OPENED - 3 * HOUR + 12_345, NOW, parse_duration(" 15m "))
    rows = [(b, bucket_start(b, 15 * 60_000) == b) for b in found]
    return _told(spark, rows, "b long, on_grid boolean").select(timestamp(F.col("b")).alias("bucket_ts"), "on_grid")


@query("SELECT * FROM (VALUES ('250ms', 250, '250ms'), (' 90s ', 90000, '90s'), ('5m', 300000, '5m'), ('24h', 86400000, '1d'), ('2d', 172800000, '2d'), ('1.5h', NULL, NULL), ('5', NULL, NULL), ('-1s', NULL, NULL)) t(text, ms, shown)")
def durations(spark, sf_dir):
    out = []
    for text in ("250ms", " 90s ", "5m", "24h", "2d", "1.5h", "5", "-1s"):
        ms = None if _refused(lambda text=text: parse_duration(text)) else parse_duration(text)
        out.append((text, ms, None if ms is None else format_duration(ms)))
    return _told(spark, out, "text string, ms int, shown string")


@query(f"SELECT {_TS} AS ts, 'error' AS level, 'it broke: ' || event_id AS message, CASE WHEN event_id % 2 = 0 THEN 'at line ' || event_id ELSE 'Broken: it broke: ' || event_id END AS error_stack, 'api' AS service FROM events WHERE event_type = 'error'")
def log_errors(spark, sf_dir):
    """An error gives a line its message and stack; a child log binds fields."""
    log = Log("lines", {"service": str_()}).child(service="api")
    e = events(spark, sf_dir).where("event_type = 'error'")
    message = F.concat(F.lit("it broke: "), F.col("event_id").cast("string"))
    stack = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("at line "), F.col("event_id").cast("string")))
    rows = e.select(F.col("ts").alias("at"), F.lit("error").alias("level"), F.struct(F.lit("Broken").alias("name"), message.alias("message"), stack.alias("stack")).alias("error"), "seq")
    return log.staged(rows, NOW, ids=_id()).select("ts", "level", "message", "error_stack", "service")


@query(
    """SELECT * FROM (VALUES ('counter', 'id', 'string'), ('counter', 'bucket_ts', 'timestamp_ntz'), ('counter', 'event_type', 'string'), ('counter', 'value', 'bigint'),
    ('timer', 'id', 'string'), ('timer', 'bucket_ts', 'timestamp_ntz'), ('timer', 'min', 'double'), ('timer', 'max', 'double'), ('timer', 'sum', 'double'), ('timer', 'count', 'bigint'),
    ('event', 'id', 'string'), ('event', 'ts', 'timestamp_ntz'), ('event', 'n', 'bigint'), ('event', 'note', 'string'), ('event', '_ingested_at', 'timestamp_ntz'), ('event', '_sample_rate', 'double')) t(metric, field, type)"""
)
def row_shapes(spark, sf_dir):
    """Columns of what a sink gets, without shipping anything."""
    metrics: list[Metric] = [_counter(), Timer("took", {}, resolution="1h"), Event("seen", {"n": int_(), "note": json_().optional()}, sample=0.5)]
    return _told(spark, [(m.kind, f.name, f.dataType.simpleString()) for m in metrics for f in m.row_schema()], "metric string, field string, type string")


@query("SELECT event_id, event_type NOT IN ('view', 'click') OR value > 50 OR event_id % 7 = 0 AS rejected FROM events")
def rejected_rows(spark, sf_dir):
    """Writes that break their declaration, told apart before they are staged."""
    shape = {"kind": one_of(["view", "click"]), "small": float_(), "id": int_()}
    e = events(spark, sf_dir)
    columns = {"kind": e["event_type"], "small": F.when(e["value"] > 50, float("inf")).otherwise(e["value"]), "id": F.when(e["event_id"] % 7 == 0, None).otherwise(e["event_id"])}
    return e.select("event_id", misfit(shape, columns).alias("rejected"))


@query(
    """SELECT * FROM (VALUES ('a name with a space', TRUE), ('a name with a colon', TRUE), ('a plain name', FALSE), ('a json dimension', TRUE), ('a reserved field', TRUE), ('fields that differ by case', TRUE),
    ('a flush that no resolution divides', TRUE), ('a snapshot that starts after its end', TRUE), ('an unknown dimension', TRUE), ('a limit below zero', TRUE), ('an unknown order', TRUE), ('a metric bound twice', TRUE),
    ('an unknown metric, strictly', TRUE), ('an unknown metric', FALSE), ('a durable event that is sampled', TRUE), ('a hold below the resolution', TRUE)) t(what, refused)"""
)
def declaration_guards(spark, sf_dir):
    house = House(spark, scratch(spark), [_counter()], now=Clock())
    snap = lambda **o: lambda: house.snapshot(**o)["events_total"]
    tries = {
        "a name with a space": lambda: check_name("a b"), "a name with a colon": lambda: check_name("a:b"), "a plain name": lambda: check_name("a.b-c"),
        "a json dimension": lambda: check_shape({"x": json_()}), "a reserved field": lambda: check_shape({"Bucket_Open": str_()}), "fields that differ by case": lambda: check_shape({"x": str_(), "X": str_()}),
        "a flush that no resolution divides": lambda: Counter("x", {}, resolution="7s", flush="1m"), "a snapshot that starts after its end": snap(start=2, end=1), "an unknown dimension": snap(dims={"no": "x"}),
        "a limit below zero": snap(limit=-1), "an unknown order": snap(order_by="no"), "a metric bound twice": lambda: house.register(_counter()), "an unknown metric, strictly": lambda: house.flush(only=["no"], strict=True),
        "an unknown metric": lambda: house.flush(only=["no"]), "a durable event that is sampled": lambda: Event("x", {}, durability="durable", sample=0.5), "a hold below the resolution": lambda: Level("x", {}, resolution="1h", hold_for="1s"),
    }
    return _told(spark, [(what, _refused(f)) for what, f in tries.items()], "what string, refused boolean")


@query(f"SELECT make_timestamp(ms * 1000) AS bucket_ts, 'q' AS queue, CAST(5 AS DOUBLE) AS value FROM (SELECT {OPENED - DAY} AS ms UNION ALL SELECT unnest(generate_series({OPENED - 10 * HOUR}, {OPENED - HOUR}, {HOUR}))) ORDER BY ms")
def carry_cap(spark, sf_dir):
    """A level is carried over ten windows back from the newest at most; the window that was written stays."""
    v = Level("depth", {"queue": str_()}, resolution="1h", carry_cap=10)
    at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=OPENED - DAY)
    cells = v.cells(spark.createDataFrame([(at, "q", 5.0, 1)], "ts timestamp_ntz, queue string, value double, seq long"))
    return v.rows(v.carried(cells, OPENED)).drop("id")


@query("SELECT * FROM (VALUES ('ok', 1500.0::DOUBLE), ('error', 250.0::DOUBLE)) t(outcome, value)")
def stopwatch(spark, sf_dir):
    """Blocks of code that are timed, with how they ended."""
    ticks, out = iter([10.0, 11.5, 20.0, 20.25]), []
    emit = lambda row: out.append((row["outcome"], row["value"]))
    for fails in (False, True):
        try:
            with Stopwatch(emit, clock=lambda: next(ticks), outcome="outcome"):
                if fails:
                    raise OSError
        except OSError:
            pass
    return _told(spark, out, "outcome string, value double")
