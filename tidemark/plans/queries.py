"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.identity import dim_key, row_id
from tidemark.functions.time import landing_col, timestamp
from tidemark.house import House
from tidemark.operators.counter import Counter
from tidemark.operators.event import Event, Log
from tidemark.operators.gauge import Gauge, Timer
from tidemark.operators.level import Level
from tidemark.plans.snapshot import open_cells, snapshot
from tidemark.schema import float_, int_, json_, one_of, str_
from tidemark.sources.ledger import Ledger
from tidemark.sources.shared import scratch
from tidemark.sources.sinks import latest

HOUR, DAY = 3_600_000, 86_400_000
#: 2024-01-20 12:34:56.789 UTC, amid a window.
NOW = int(dt.datetime(2024, 1, 20, 12, 34, 56, 789_000, tzinfo=dt.UTC).timestamp() * 1000)
OPENED = NOW - NOW % HOUR

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))


def before_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("ts") <= F.lit(dt.datetime(2024, 1, 20, 12, 34, 56, 789_000)).cast("timestamp_ntz"))


def exact(c: str) -> F.Column:
    """Money and values have two decimals: sums of them are exact in decimals."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


EVENT_TYPES = one_of(["click", "error", "purchase", "signup", "view"])
EVENTS = Counter("events_total", {"event_type": EVENT_TYPES}, resolution="1h", flush="1h")
WORTH = Gauge("event_value", {"event_type": EVENT_TYPES}, resolution="1h", flush="1h")


def unit_events(df: DataFrame) -> DataFrame:
    return df.select("ts", "event_type", "seq")


# SQL that several queries share: the hour of an event, in milliseconds, and a row's id.
MS = "epoch_ms(date_trunc('hour', ts))"
RANGE = "ts <= TIMESTAMP '2024-01-20 12:34:56.789'"


def sql_id(metric: str, ms: str, key: str) -> str:
    ms = f"CAST({ms} AS VARCHAR)"
    return f"md5('{len(metric)}:{metric}' || length({ms}) || ':' || {ms} || length({key}) || ':' || {key})"


# ---- counters ----

_HOURLY = f"SELECT {MS} AS ms, date_trunc('hour', ts) AS bucket_ts, event_type, count(*) AS n FROM events GROUP BY ALL"


@query(f"SELECT {sql_id('events_total', 'ms', 'event_type')} AS id, bucket_ts, event_type, CAST(n AS BIGINT) AS value FROM ({_HOURLY})")
def counter_hourly(spark, sf_dir):
    return EVENTS.rows(EVENTS.cells(unit_events(events(spark, sf_dir))))


@query("SELECT date_trunc('day', o_orderdate) AS bucket_ts, o_orderpriority, o_orderstatus, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL")
def counter_sum_value(spark, sf_dir):
    c = Counter("order_cents", {"o_orderpriority": str_(), "o_orderstatus": one_of(["F", "O", "P"])}, resolution="1d", flush="1d")
    writes = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("ts"), "o_orderpriority", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
    return c.rows(c.cells(writes)).select("bucket_ts", "o_orderpriority", "o_orderstatus", F.col("value").alias("cents"))


@query(f"SELECT {sql_id('by_user', 'ms', 'k')} AS id, k AS dim_key FROM (SELECT DISTINCT {MS} AS ms, CAST(user_id AS VARCHAR) || '|' || event_type AS k FROM events)")
def counter_row_ids(spark, sf_dir):
    c = Counter("by_user", {"user_id": int_(), "event_type": str_()}, resolution="1h")
    cells = c.cells(events(spark, sf_dir).select("ts", "user_id", "event_type"))
    return cells.select(row_id(c.name, F.col("bucket_ms"), F.col("dim_key")).alias("id"), "dim_key")


@query(
    r"""SELECT event_id, coalesce(replace(replace(a, '\', '\\'), '|', '\|'), '\0') || '|' || coalesce(replace(replace(b, '\', '\\'), '|', '\|'), '\0') AS dim_key
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN event_type || '|x' ELSE event_type || '\' END AS a, CASE WHEN event_id % 5 = 0 THEN '' ELSE props END AS b FROM events)"""
)
def counter_dim_key(spark, sf_dir):
    i = F.col("event_id")
    a = F.when(i % 3 == 0, None).when(i % 3 == 1, F.concat("event_type", F.lit("|x"))).otherwise(F.concat("event_type", F.lit("\\")))
    b = F.when(i % 5 == 0, "").otherwise(F.col("props"))
    return events(spark, sf_dir).select("event_id", dim_key([a, b]).alias("dim_key"))


@query("SELECT date_trunc('day', ts) AS bucket_ts, CAST(user_id % 10 AS BIGINT) AS shard, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END) AS BIGINT) AS value FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL")
def counter_negative_delta(spark, sf_dir):
    c = Counter("net_signups", {"shard": int_()}, resolution="1d")
    e = events(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    return c.rows(c.cells(e.select("ts", (F.col("user_id") % 10).alias("shard"), F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("value")))).drop("id")


@query(f"SELECT CAST(count(*) AS BIGINT) AS value FROM events WHERE {RANGE} AND ts >= date_trunc('hour', TIMESTAMP '2024-01-20 12:34:56')")
def counter_current(spark, sf_dir):
    return EVENTS.current(EVENTS.cells(unit_events(before_now(spark, sf_dir)), OPENED), NOW)


# ---- gauges and timers ----

_FOLD = "arg_max(value, event_id) AS last, min(value) AS min, max(value) AS max, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum, count(*) AS count"


def worth(df: DataFrame) -> DataFrame:
    return df.select("ts", "event_type", "value", "seq")


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumn("sum", F.round("sum", 2)) if "sum" in df.columns else df


@query(f"SELECT {sql_id('event_value', 'epoch_ms(bucket_ts)', 'event_type')} AS id, * FROM (SELECT date_trunc('hour', ts) AS bucket_ts, event_type, {_FOLD} FROM events GROUP BY ALL)")
def gauge_hourly(spark, sf_dir):
    return rounded(WORTH.rows(WORTH.cells(worth(events(spark, sf_dir)))))


@query("SELECT date_trunc('hour', ts) AS bucket_ts, event_type, max(value) AS max, count(*) AS count FROM events GROUP BY ALL")
def gauge_subset(spark, sf_dir):
    g = Gauge("event_value", {"event_type": str_()}, resolution="1h", aggregates=("max", "count"))
    return g.rows(g.cells(worth(events(spark, sf_dir)))).drop("id")


@query(f"SELECT min(value) AS min, max(value) AS max, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum, count(*) AS count FROM events WHERE {RANGE} AND ts >= TIMESTAMP '2024-01-20 12:00:00' HAVING count(*) > 0")
def gauge_totals(spark, sf_dir):
    return rounded(WORTH.totals(WORTH.cells(worth(before_now(spark, sf_dir)), OPENED), NOW))


@query(f"SELECT {_FOLD} FROM events WHERE {RANGE} AND ts >= TIMESTAMP '2024-01-20 12:00:00' AND event_type = 'view' HAVING count(*) > 0")
def gauge_current(spark, sf_dir):
    return rounded(WORTH.current(WORTH.cells(worth(before_now(spark, sf_dir)), OPENED), NOW, {"event_type": "view"}))


@query("SELECT date_trunc('hour', ts) AS bucket_ts, event_type, min(value) AS min, max(value) AS max, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum, count(*) AS count FROM events GROUP BY ALL")
def timer_hourly(spark, sf_dir):
    t = Timer("took", {"event_type": str_()}, resolution="1h")
    return rounded(t.rows(t.cells(worth(events(spark, sf_dir)))).drop("id"))


# ---- levels ----

_STEPS = "SELECT date_trunc('hour', ts) AS b, {key} AS k, {value} AS v FROM events WHERE {where} AND {range} GROUP BY ALL"


def _carry_sql(key: str, value: str, where: str, name: str, hold: str | None = None, end: str = "TIMESTAMP '2024-01-20 12:00:00'", running: bool = False) -> str:
    steps = _STEPS.format(key=key, value=value, where=where, range=RANGE)
    if running:
        steps = f"SELECT b, k, sum(v) OVER (PARTITION BY k ORDER BY b) AS v FROM ({steps})"
    return f"""WITH steps AS ({steps}), grid AS (
        SELECT k, unnest(generate_series(min(b), {end} - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS b FROM steps GROUP BY k
    ), filled AS (
        SELECT g.k, g.b, s.b AS own, last_value(s.v IGNORE NULLS) OVER w AS v, last_value(s.b IGNORE NULLS) OVER w AS written
        FROM grid g LEFT JOIN steps s ON g.k = s.k AND g.b = s.b WINDOW w AS (PARTITION BY g.k ORDER BY g.b)
    ) SELECT b AS bucket_ts, k AS {name}, CAST(v AS DOUBLE) AS value FROM filled{"" if hold is None else f" WHERE written + INTERVAL {hold} >= b"}"""


@query(_carry_sql("event_type", "arg_max(value, event_id)", "true", "event_type"))
def level_set_carry(spark, sf_dir):
    v = Level("last_value", {"event_type": str_()}, resolution="1h")
    return v.rows(v.carried(v.cells(worth(before_now(spark, sf_dir))), OPENED)).drop("id")


@query(_carry_sql("CAST(user_id % 10 AS BIGINT)", "sum(CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END)", "event_type IN ('signup', 'error')", "shard", running=True))
def level_inc_dec(spark, sf_dir):
    v = Level("balance", {"shard": int_()}, resolution="1h")
    e = before_now(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    e = e.select("ts", (F.col("user_id") % 10).alias("shard"), F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("value"), F.lit("add").alias("mode"), "seq")
    return v.rows(v.carried(v.cells(e), OPENED)).drop("id")


@query(_carry_sql("CAST(user_id % 50 AS BIGINT)", "arg_max(value, event_id)", "true", "series", hold="2 HOUR"))
def level_hold_for(spark, sf_dir):
    v = Level("held", {"series": int_()}, resolution="1h", hold_for="2h")
    e = before_now(spark, sf_dir).select("ts", (F.col("user_id") % 50).alias("series"), "value", "seq")
    return v.rows(v.carried(v.cells(e), OPENED)).drop("id")


@query("SELECT CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS value FROM (SELECT event_type, arg_max(value, event_id) AS v FROM events WHERE " + RANGE + " AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY event_type)")
def level_rollup(spark, sf_dir):
    v = Level("last_value", {"event_type": str_()}, resolution="1h")
    found = snapshot(v, v.cells(worth(before_now(spark, sf_dir))), NOW, rollup="sum", group_by=[], complete=True)
    return found.select(F.round("value", 2).alias("value"))


@query("SELECT k AS shard, CAST(sum(v) AS DOUBLE) AS value FROM (SELECT CAST(user_id % 10 AS BIGINT) AS k, CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END AS v FROM events WHERE event_type IN ('signup', 'error') AND " + RANGE + ") GROUP BY k")
def level_current(spark, sf_dir):
    v = Level("balance", {"shard": int_()}, resolution="1h")
    e = before_now(spark, sf_dir).where(F.col("event_type").isin("signup", "error"))
    e = e.select("ts", (F.col("user_id") % 10).alias("shard"), F.when(F.col("event_type") == "signup", 1).otherwise(-1).alias("value"), F.lit("add").alias("mode"), "seq")
    return v.held(v.cells(e), NOW).select("shard", "value")


@query(f"SELECT date_trunc('day', bucket_ts) AS day, max(value) AS deepest, round(avg(value), 6) AS typical FROM ({_carry_sql('event_type', 'arg_max(value, event_id)', 'true', 'event_type')}) GROUP BY ALL")
def level_deepest_per_day(spark, sf_dir):
    return (
        level_set_carry(spark, sf_dir)
        .groupBy(F.date_trunc("day", "bucket_ts").cast("timestamp_ntz").alias("day"))
        .agg(F.max("value").alias("deepest"), F.round(F.avg("value"), 6).alias("typical"))
    )


# ---- snapshots ----

_CELLS = f"(SELECT date_trunc('hour', ts) AS b, {MS} AS ms, event_type, CAST(count(*) AS BIGINT) AS value FROM events WHERE {RANGE} GROUP BY ALL)"
_LIVE = f"{NOW} - ms < {HOUR} AS bucket_open, CAST(least(greatest({NOW} - ms, 0), {HOUR}) AS BIGINT) AS bucket_elapsed_ms"
_ROW = f"{sql_id('events_total', 'ms', 'event_type')} AS id, b AS bucket_ts, event_type, value, {_LIVE}"


def _snap(spark, sf_dir, **options) -> DataFrame:
    return snapshot(EVENTS, EVENTS.cells(unit_events(before_now(spark, sf_dir))), NOW, **options)


@query(f"SELECT {_ROW} FROM {_CELLS} WHERE event_type = 'error'")
def snap_dims_filter(spark, sf_dir):
    return _snap(spark, sf_dir, dims={"event_type": "error"})


@query(f"SELECT {_ROW} FROM {_CELLS} WHERE b >= TIMESTAMP '2024-01-10' AND b < TIMESTAMP '2024-01-11'")
def snap_range(spark, sf_dir):
    start = int(dt.datetime(2024, 1, 10, tzinfo=dt.UTC).timestamp() * 1000)
    cells = EVENTS.cells(unit_events(before_now(spark, sf_dir)), start, start + DAY)
    return snapshot(EVENTS, cells, NOW, start=start, end=start + DAY)


@query(f"SELECT {_ROW} FROM {_CELLS} WHERE ms < {OPENED}")
def snap_complete(spark, sf_dir):
    return _snap(spark, sf_dir, complete=True)


@query(f"SELECT b AS bucket_ts, event_type, value FROM {_CELLS} WHERE ms = {OPENED}")
def snap_open(spark, sf_dir):
    return EVENTS.rows(open_cells(EVENTS, EVENTS.cells(unit_events(before_now(spark, sf_dir)), OPENED), NOW)).drop("id")


_MERGED = f"bool_or({NOW} - ms < {HOUR}) AS bucket_open"


@query(f"SELECT event_type, CAST(sum(value) AS BIGINT) AS value, {_MERGED}, CAST(sum(least({NOW} - ms, {HOUR})) AS BIGINT) AS bucket_elapsed_ms FROM {_CELLS} GROUP BY event_type")
def snap_rollup(spark, sf_dir):
    return _snap(spark, sf_dir, rollup="sum")


_TWO = f"(SELECT date_trunc('hour', ts) AS b, {MS} AS ms, event_type, user_id % 5 AS u, count(*) AS value FROM events WHERE {RANGE} GROUP BY ALL)"
TWO = Counter("two", {"event_type": str_(), "u": int_()}, resolution="1h")


def _two(spark, sf_dir) -> DataFrame:
    return TWO.cells(before_now(spark, sf_dir).select("ts", "event_type", (F.col("user_id") % 5).alias("u")))


@query(f"SELECT b AS bucket_ts, CAST(u AS BIGINT) AS u, CAST(sum(value) AS BIGINT) AS value, {_MERGED}, CAST(max(least({NOW} - ms, {HOUR})) AS BIGINT) AS bucket_elapsed_ms FROM {_TWO} GROUP BY b, u")
def snap_group_by(spark, sf_dir):
    return snapshot(TWO, _two(spark, sf_dir), NOW, group_by=["u"])


@query(f"SELECT u, CAST(sum(value) AS BIGINT) AS value, bool_or(o) AS bucket_open, CAST(sum(e) AS BIGINT) AS bucket_elapsed_ms FROM (SELECT CAST(u AS BIGINT) AS u, sum(value) AS value, bool_or({NOW} - ms < {HOUR}) AS o, max(least({NOW} - ms, {HOUR})) AS e FROM {_TWO} GROUP BY u, ms) GROUP BY u")
def snap_group_rollup(spark, sf_dir):
    return snapshot(TWO, _two(spark, sf_dir), NOW, group_by=["u"], rollup="sum")


@query(f"SELECT CAST(sum(value) AS BIGINT) AS value, bool_or(o) AS bucket_open, CAST(sum(e) AS BIGINT) AS bucket_elapsed_ms FROM (SELECT sum(value) AS value, bool_or({NOW} - ms < {HOUR}) AS o, max(least({NOW} - ms, {HOUR})) AS e FROM {_TWO} GROUP BY ms) HAVING count(*) > 0")
def snap_group_empty(spark, sf_dir):
    return snapshot(TWO, _two(spark, sf_dir), NOW, group_by=[], rollup="sum")


@query(f"SELECT {_ROW} FROM {_CELLS} ORDER BY value DESC, b, event_type LIMIT 25")
def snap_top_k(spark, sf_dir):
    return _snap(spark, sf_dir, order_by="value", limit=25)


@query(
    f"""WITH f AS (SELECT date_trunc('hour', ts) AS b, event_type, user_id % 5 AS u, {_FOLD} FROM events WHERE {RANGE} GROUP BY ALL),
    w AS (SELECT event_type, b, count(*) AS n, min(last) AS l FROM f GROUP BY ALL)
    SELECT event_type, (SELECT CASE WHEN w.n = 1 THEN w.l END FROM w WHERE w.event_type = f.event_type ORDER BY b DESC LIMIT 1) AS last, min(min) AS min, max(max) AS max, round(sum(sum), 2) AS sum, CAST(sum(count) AS BIGINT) AS count
    FROM f GROUP BY event_type"""
)
def snap_gauge_last(spark, sf_dir):
    g = Gauge("spread", {"event_type": str_(), "u": int_()}, resolution="1h")
    cells = g.cells(before_now(spark, sf_dir).select("ts", "event_type", (F.col("user_id") % 5).alias("u"), "value", "seq"))
    return rounded(snapshot(g, cells, NOW, group_by=["event_type"], rollup="sum").drop("bucket_open", "bucket_elapsed_ms"))


@query(f"SELECT b AS bucket_ts, event_type, {_LIVE} FROM {_CELLS} WHERE ms >= {OPENED - 5 * HOUR}")
def snap_liveness(spark, sf_dir):
    return _snap(spark, sf_dir, start=OPENED - 5 * HOUR).select("bucket_ts", "event_type", "bucket_open", "bucket_elapsed_ms")


@query(f"SELECT value, bucket_elapsed_ms, round(value / (bucket_elapsed_ms / {HOUR}.0), 6) AS projected FROM (SELECT value, {_LIVE} FROM {_CELLS} WHERE ms = {OPENED})")
def project_open(spark, sf_dir):
    rows = _snap(spark, sf_dir, start=OPENED)
    return rows.select("value", "bucket_elapsed_ms", F.round(F.col("value") / (F.col("bucket_elapsed_ms") / float(HOUR)), 6).alias("projected"))


# ---- events and logs ----

FIELDS = {"user_id": int_(), "event_type": EVENT_TYPES, "value": float_(), "props": json_()}
RAW = Event("raw_events", FIELDS)
_TS = "date_trunc('millisecond', ts)"


def _record(df: DataFrame) -> DataFrame:
    return df.select(F.col("ts").alias("at"), "user_id", "event_type", "value", "props", "seq")


def _id() -> F.Column:
    return F.md5(F.col("seq").cast("string"))


@query(f"SELECT md5(CAST(event_id AS VARCHAR)) AS id, {_TS} AS ts, user_id, event_type, value, props, TIMESTAMP '2024-01-20 12:34:56.789' AS _ingested_at FROM events")
def event_materialize(spark, sf_dir):
    return RAW.staged(_record(events(spark, sf_dir)), NOW, ids=_id()).drop("seq")


@query("SELECT event_id, coalesce(CASE WHEN event_type = 'purchase' THEN value END, 0.5) AS price, CASE WHEN event_type = 'signup' THEN user_id END AS referrer FROM events")
def event_defaults(spark, sf_dir):
    e = Event("priced", {"event_id": int_(), "price": float_().with_default(0.5), "referrer": int_().optional()})
    rows = events(spark, sf_dir).select("event_id", F.col("ts").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("price"), F.when(F.col("event_type") == "signup", F.col("user_id")).alias("referrer"), "seq")
    return e.staged(rows, NOW, ids=_id()).select("event_id", "price", "referrer")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN to_json(props) ELSE props END AS text, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def event_json_text(spark, sf_dir):
    """A json field keeps JSON as it is and ships what is none as a JSON text (every third is broken here on purpose)."""
    e = Event("noted", {"event_id": int_(), "props": json_()})
    rows = events(spark, sf_dir).withColumn("props", F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("props")).substr(F.lit(2), F.length(F.to_json(F.array("props"))) - 2)).otherwise(F.col("props")))
    stored = e.staged(rows.select("event_id", F.col("ts").alias("at"), "props", "seq"), NOW, ids=_id())
    found = e.reread(stored)
    return found.select("event_id", F.col("props").alias("text"), F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"))


@query(f"SELECT {_TS} AS ts, user_id, event_type, value, props FROM events ORDER BY event_id LIMIT 15")
def event_peek(spark, sf_dir):
    return RAW.peek(RAW.staged(_record(events(spark, sf_dir)), NOW, ids=_id()), 15).drop("id", "_ingested_at")


@query(f"SELECT {_TS} AS ts, user_id, event_type FROM events WHERE epoch_ms(ts) >= {OPENED - 30 * HOUR} AND epoch_ms(ts) < {OPENED - 20 * HOUR}")
def event_range(spark, sf_dir):
    staged = RAW.staged(_record(events(spark, sf_dir)), NOW, ids=_id())
    return RAW.snapshot(staged, start=OPENED - 30 * HOUR, end=OPENED - 20 * HOUR).select("ts", "user_id", "event_type")


_RATE = "CASE WHEN event_type = 'error' THEN 1.0 WHEN event_type = 'view' THEN 0.0 WHEN CAST(json_extract(props, '$.k') AS INT) < 50 THEN 0.5 ELSE 0.25 END"
_KEPT = f"SELECT *, CAST({_RATE} AS DOUBLE) AS rate FROM events"
_DRAW = "(event_id * 7919 % 1000) / 1000.0"


def _sampled(df: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rate = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "view", 0.0).when(k < 50, 0.5).otherwise(0.25)
    e = Event("sampled", FIELDS, sample=lambda _: rate)
    return e.staged(_record(df), NOW, ids=_id(), draw=(F.col("seq") * 7919 % 1000) / 1000.0)


@query(f"SELECT md5(CAST(event_id AS VARCHAR)) AS id, event_type, rate AS _sample_rate FROM ({_KEPT}) WHERE rate >= 1 OR {_DRAW} < rate")
def event_sample_by_rule(spark, sf_dir):
    return _sampled(events(spark, sf_dir)).select("id", "event_type", "_sample_rate")


@query(f"SELECT event_type, CAST(sum(1 / rate) AS DOUBLE) AS estimate, count(*) AS kept FROM ({_KEPT}) WHERE rate >= 1 OR {_DRAW} < rate GROUP BY event_type")
def ht_estimate(spark, sf_dir):
    return _sampled(events(spark, sf_dir)).groupBy("event_type").agg(F.sum(1 / F.col("_sample_rate")).alias("estimate"), F.count("*").alias("kept"))


@query("SELECT date_trunc('hour', ts) AS bucket_ts, user_id % 10 AS tenant, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL")
def derive_counts(spark, sf_dir):
    """Counted from every record, though the event keeps none."""
    c = Counter("requests", {"tenant": int_()}, resolution="1h")
    e = Event("request_completed", FIELDS, sample=0, derive={c: lambda f: [(F.lit(1), {"tenant": f["user_id"] % 10})]})
    return c.rows(c.cells(e.derived(_record(events(spark, sf_dir)), NOW)[c])).drop("id")


@query("SELECT date_trunc('day', ts) AS bucket_ts, what, CAST(sum(n) AS BIGINT) AS value FROM (SELECT ts, 'events' AS what, 1 AS n FROM events UNION ALL SELECT ts, 'cents', CAST(round(value * 100) AS BIGINT) FROM events WHERE event_type = 'purchase') GROUP BY ALL")
def derive_fanout(spark, sf_dir):
    c = Counter("fanout", {"what": str_()}, resolution="1d")
    cents = lambda f: F.when(f["event_type"] == "purchase", F.round(f["value"] * 100).cast("long"))
    e = Event("fan", FIELDS, derive={c: lambda f: [(F.lit(1), {"what": F.lit("events")}), (cents(f), {"what": F.lit("cents")})]})
    return c.rows(c.cells(e.derived(_record(events(spark, sf_dir)), NOW)[c])).drop("id")


@query(f"SELECT {_TS} AS ts, event_type, value AS duration_ms FROM events")
def timer_record_event(spark, sf_dir):
    t = Timer("took", {"event_type": str_()}, resolution="1h")
    e = Event("timings", {"event_type": str_(), "duration_ms": float_()})
    rows = t.recorded(events(spark, sf_dir).select(F.col("ts").alias("at"), "event_type", "value", "seq"), e)
    return e.staged(rows, NOW, ids=_id()).select("ts", "event_type", "duration_ms")


LOGS = "SELECT event_id, ts, user_id, event_type AS message, CASE event_type WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info' WHEN 'signup' THEN 'warn' ELSE 'error' END AS level, CASE WHEN user_id % 2 = 0 THEN 'api' ELSE 'web' END AS service FROM events"


def _logs(spark, sf_dir, **settings) -> DataFrame:
    level = F.when(F.col("event_type") == "view", "debug").when(F.col("event_type") == "click", "info").when(F.col("event_type") == "signup", "warn").otherwise("error")
    rows = events(spark, sf_dir).select(F.col("ts").alias("at"), level.alias("level"), F.col("event_type").alias("message"), "user_id", F.when(F.col("user_id") % 2 == 0, "api").otherwise("web").alias("service"), "seq")
    log = Log("app_log", {"user_id": int_(), "service": str_()}, **settings)
    return log.staged(rows, NOW, ids=_id())


@query(f"SELECT {_TS} AS ts, level, message, service FROM ({LOGS}) WHERE level IN ('warn', 'error')")
def log_min_level(spark, sf_dir):
    return _logs(spark, sf_dir, min_level="warn").select("ts", "level", "message", "service")


@query(f"SELECT date_trunc('hour', ts) AS hour, service, count(*) FILTER (level = 'error') AS errors, count(*) AS lines, round(count(*) FILTER (level = 'error') / count(*), 6) AS rate FROM ({LOGS}) GROUP BY ALL")
def log_error_rate(spark, sf_dir):
    rows = _logs(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "service")
    return rows.agg(F.count_if(F.col("level") == "error").alias("errors"), F.count("*").alias("lines")).withColumn("rate", F.round(F.col("errors") / F.col("lines"), 6))


@query(f"SELECT {_TS} AS ts, level, message FROM ({LOGS}) WHERE user_id = 7 ORDER BY event_id")
def log_request_lines(spark, sf_dir):
    return _logs(spark, sf_dir).where("user_id = 7").orderBy("seq").select("ts", "level", "message")


# ---- late data, claims ----

FLOOR = OPENED - 10 * DAY + 1234
_LATE = f"(SELECT event_id, event_type, {MS} AS ms, greatest({MS}, CAST(ceil({FLOOR} / {HOUR}.0) AS BIGINT) * {HOUR}) AS landed FROM events)"


@query(f"SELECT make_timestamp(landed * 1000) AS bucket_ts, event_type, CAST(count(*) AS BIGINT) AS value, CAST(sum(CASE WHEN landed > ms THEN 1 ELSE 0 END) AS BIGINT) AS late FROM {_LATE} GROUP BY ALL")
def late_landing(spark, sf_dir):
    ops = EVENTS.ops(unit_events(events(spark, sf_dir)))
    at = landing_col(F.col("bucket_ms"), FLOOR, HOUR)
    return ops.select(timestamp(at).alias("bucket_ts"), "event_type", (at > F.col("bucket_ms")).cast("long").alias("l")).groupBy("bucket_ts", "event_type").agg(F.count("*").alias("value"), F.sum("l").alias("late"))


def _stored(spark, metric, *writes: DataFrame) -> Ledger:
    store = Ledger(spark, scratch(spark))
    for w in writes:
        store.append(metric, metric.ops(w))
    return store


@query(f"SELECT CASE WHEN ms < {OPENED} THEN 'claimed' ELSE 'live' END AS part, CAST(sum(value) AS BIGINT) AS total, count(*) AS cells FROM {_CELLS} GROUP BY ALL")
def claim_closed(spark, sf_dir):
    """A claim takes the closed windows out of the store's live ones."""
    store = _stored(spark, EVENTS, unit_events(before_now(spark, sf_dir)))
    claim = store.claim(EVENTS, OPENED, NOW)
    parts = store.claimed_cells(claim, EVENTS).withColumn("part", F.lit("claimed")).unionByName(store.read_buckets(EVENTS).withColumn("part", F.lit("live")))
    return parts.groupBy("part").agg(F.sum("value").alias("total"), F.count("*").alias("cells"))


@query(f"SELECT CAST(min(ms) AS BIGINT) AS bucket_from, CAST(max(ms) + {HOUR} AS BIGINT) AS bucket_to, CAST(sum(value) AS BIGINT) AS total, count(*) AS rows FROM {_CELLS} WHERE ms < {OPENED}")
def claim_context(spark, sf_dir):
    """What a flush tells the sink."""
    seen = []
    c = Counter("events_total", {"event_type": EVENT_TYPES}, resolution="1h", flush="1h", grace="0s", write=lambda rows, ctx: seen.append((ctx.bucket_from, ctx.bucket_to, ctx.total, rows.count())))
    house = House(spark, scratch(spark), [c], now=lambda: NOW)
    house.write(c.name, unit_events(before_now(spark, sf_dir)))
    house.flush().raise_if_failed()
    return spark.createDataFrame(seen, "bucket_from long, bucket_to long, total long, rows long")


_HALF = OPENED - 10 * DAY
# even ids come first; a claim then closes the windows below the last of them that is over, and is released
_CLOSED = f"(SELECT max({MS}) + {HOUR} FROM events WHERE event_id % 2 = 0 AND {MS} < {_HALF})"
_HALVES = f"(SELECT *, CASE WHEN event_id % 2 = 0 THEN {MS} ELSE greatest({MS}, coalesce({_CLOSED}, 0)) END AS ms FROM events)"


@query(
    f"""SELECT make_timestamp(ms * 1000) AS bucket_ts, event_type, arg_max(value, event_id + CASE WHEN event_id % 2 = 1 THEN 1000000000000 ELSE 0 END) AS last, min(value) AS min, max(value) AS max,
    CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum, count(*) AS count FROM {_HALVES} GROUP BY ALL"""
)
def release_merge(spark, sf_dir):
    """A released claim's rows (even ids) are live again and merge with what came since (odd ids), which moved past its windows."""
    e = worth(events(spark, sf_dir))
    store = _stored(spark, WORTH, e.where("seq % 2 = 0"))
    claim = store.claim(WORTH, _HALF, NOW)
    store.append(WORTH, WORTH.ops(e.where("seq % 2 = 1")))
    if claim is not None:
        store.release(claim)
    return rounded(WORTH.rows(store.read_buckets(WORTH)).drop("id"))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id % 4, event_id) - 1) // 100 AS BIGINT) AS claim FROM (SELECT event_id FROM events ORDER BY event_id % 4, event_id LIMIT 1050)")
def claim_fifo(spark, sf_dir):
    """Records of four batches, each over many partitions, ship in their order of arrival, 100 by 100."""
    e = Event("queued", {"event_id": int_()})
    first = events(spark, sf_dir).select("event_id", F.col("ts").alias("at"), "seq")
    store = Ledger(spark, scratch(spark))
    for part in range(4):
        store.append(e, e.staged(first.where(F.col("event_id") % 4 == part).repartition(16), NOW, ids=_id()))
    out = None
    for n in range(11):
        claim = store.claim_records(e, NOW, 100 if n < 10 else 50)
        if claim is None:
            break
        rows = store.claimed_records(claim, e).select("event_id", F.lit(n).cast("long").alias("claim"))
        out = rows if out is None else out.unionByName(rows)
        store.ack(claim, e)
    return out


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY event_id % 2, event_id) AS BIGINT) AS place FROM events")
def append_order(spark, sf_dir):
    """Pending records come batch by batch, and within each as they arrived, whatever their partitions."""
    e = Event("queued", {"event_id": int_()})
    store = Ledger(spark, scratch(spark))
    for part in range(2):
        rows = events(spark, sf_dir).where(F.col("event_id") % 2 == part).select("event_id", F.col("ts").alias("at"), "seq")
        store.append(e, e.staged(rows.repartition(16), NOW, ids=_id()))
    pending = store.read_pending(e).select("event_id").rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1))
    return spark.createDataFrame(pending, "event_id long, place long")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL")
def resend_once(spark, sf_dir):
    """A batch that broke off before it was committed, then one sent twice under its key, count once."""
    store, rows = Ledger(spark, scratch(spark)), EVENTS.ops(unit_events(events(spark, sf_dir)))
    number, _ = store._number(EVENTS, "stream-0")  # the first try dies after half of its rows
    rows.limit(100).write.parquet(f"{store.path}/rows/{EVENTS.name}/batch={number}")
    for _ in range(2):
        store.append(EVENTS, rows, key="stream-0")
    return store.read_buckets(EVENTS).groupBy("event_type").agg(F.sum("value").alias("value"))


# half of the events come after the windows up to _HALF have shipped; what is late then lands in the first open window
_LATE_HALF = f"(SELECT event_id, event_type, value, event_id % 2 AS late, {MS} AS own, CASE WHEN event_id % 2 = 1 THEN greatest({MS}, {_HALF}) ELSE {MS} END AS ms FROM events WHERE {RANGE})"


def _in_two(spark, sf_dir, level: Level, rows: DataFrame) -> DataFrame:
    """Cells of a level whose even ids ship up to ``_HALF`` before the odd ids come."""
    store = _stored(spark, level, rows.where("seq % 2 = 0"))
    store.ack(store.claim(level, _HALF, NOW), level)
    store.append(level, level.ops(rows.where("seq % 2 = 1")))
    return level.rows(store.read_buckets(level)).drop("id")


@query(
    f"""WITH d AS (SELECT *, late = 1 AND ms > own AS moved FROM {_LATE_HALF}), own AS (SELECT event_type, ms, min(late * 1000000000000 + event_id) AS first FROM d WHERE NOT moved GROUP BY ALL),
    kept AS (SELECT d.* FROM d LEFT JOIN own USING (event_type, ms) WHERE NOT (moved AND first IS NOT NULL AND first < late * 1000000000000 + event_id))
    SELECT make_timestamp(ms * 1000) AS bucket_ts, event_type, arg_max(value, late * 1000000000000 + event_id) AS value FROM kept WHERE ms >= {_HALF} GROUP BY ALL"""
)
def level_late_set(spark, sf_dir):
    """A late set moves to the first open window, and gives way to a reading that the window has of its own."""
    return _in_two(spark, sf_dir, Level("last_value", {"event_type": str_()}, resolution="1h"), worth(before_now(spark, sf_dir)))


@query(
    f"""WITH d AS (SELECT event_type, ms, sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END) AS v FROM {_LATE_HALF} GROUP BY ALL),
    r AS (SELECT event_type, ms, sum(v) OVER (PARTITION BY event_type ORDER BY ms) AS value FROM d)
    SELECT make_timestamp(ms * 1000) AS bucket_ts, event_type, CAST(value AS DOUBLE) AS value FROM r WHERE ms >= {_HALF}"""
)
def level_late_add(spark, sf_dir):
    """A late move counts from the first open window on, on top of what shipped before."""
    rows = before_now(spark, sf_dir).select("ts", "event_type", F.when(F.col("event_id") % 3 == 0, -1.0).otherwise(1.0).alias("value"), F.lit("add").alias("mode"), "seq")
    return _in_two(spark, sf_dir, Level("moves", {"event_type": str_()}, resolution="1h"), rows)


_PARTS = "(SELECT *, CAST((event_id - (SELECT min(event_id) FROM events)) * 4 // (SELECT count(*) FROM events) AS INT) AS part FROM events)"
_SENT_IN = f"(SELECT *, CASE WHEN event_id % 50 = 0 THEN part + 1 ELSE part END AS batch, {MS} AS ms FROM {_PARTS})"


@query(
    f"""WITH d AS (SELECT * FROM {_SENT_IN}), ends AS (SELECT part, max(ms) AS up_to FROM d WHERE batch = part GROUP BY part),
    floors AS (SELECT e.part + 1 AS batch, (SELECT max(ms) FROM d WHERE d.batch <= e.part AND d.ms < e.up_to) + {HOUR} AS f FROM ends e),
    placed AS (SELECT event_type, greatest(ms, coalesce(f, 0)) AS landed, ms FROM d LEFT JOIN floors ON floors.batch = d.batch)
    SELECT make_timestamp(landed * 1000) AS bucket_ts, event_type, CAST(count(*) AS BIGINT) AS value, CAST(sum(CASE WHEN landed > ms THEN 1 ELSE 0 END) AS BIGINT) AS late FROM placed GROUP BY ALL"""
)
def late_batch_split(spark, sf_dir):
    """Four batches; every 50th event comes a batch late, when its window has been claimed, and moves forward."""
    e = events(spark, sf_dir)
    least, n = e.agg(F.min("event_id"), F.count("*")).first()
    part = F.floor((F.col("event_id") - least) * 4 / n)
    e = e.withColumn("batch", F.when(F.col("event_id") % 50 == 0, part + 1).otherwise(part))
    store = Ledger(spark, scratch(spark))
    for b in range(5):
        own = e.where(F.col("batch") == b)
        store.append(EVENTS, EVENTS.ops(unit_events(own)))
        newest = EVENTS.ops(unit_events(own.where(part == b))).agg(F.max("bucket_ms")).first()[0]
        if newest is not None:
            store.claim(EVENTS, newest, NOW)
    out = store._rows(EVENTS)
    return out.groupBy(timestamp(F.col("bucket_ms")).alias("bucket_ts"), "event_type").agg(F.count("*").alias("value"), F.sum(F.col("moved").cast("long")).alias("late"))


# ---- what users ask of shipped tables ----


@query("SELECT date_trunc('minute', ts) AS minute, event_type, CAST(count(*) AS BIGINT) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-19 12:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY ALL")
def rate_per_minute(spark, sf_dir):
    c = Counter("events_total", {"event_type": str_()}, resolution="10s")
    start = OPENED - DAY
    rows = c.rows(c.cells(unit_events(events(spark, sf_dir)), start, start + DAY))
    return rows.groupBy(F.date_trunc("minute", "bucket_ts").cast("timestamp_ntz").alias("minute"), "event_type").agg(F.sum("value").alias("value"))


@query("SELECT date_trunc('hour', ts) AS hour, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY ALL")
def error_rate(spark, sf_dir):
    bad = F.sum(F.when(F.col("event_type") == "error", F.col("value")).otherwise(0))
    return counter_hourly(spark, sf_dir).groupBy(F.col("bucket_ts").alias("hour")).agg(F.round(F.try_divide(bad, F.sum("value")), 6).alias("error_rate"))


@query("SELECT date_trunc('day', l_shipdate) AS day, l_linestatus, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN c ELSE 0 END) AS BIGINT) AS charged, CAST(sum(CASE WHEN l_returnflag = 'R' THEN c ELSE 0 END) AS BIGINT) AS refunded, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -c ELSE c END) AS BIGINT) AS net FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem) GROUP BY ALL")
def revenue_net(spark, sf_dir):
    c = Counter("revenue_cents", {"l_linestatus": str_(), "l_returnflag": str_()}, resolution="1d")
    writes = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("ts"), "l_linestatus", "l_returnflag", F.round(F.col("l_extendedprice") * 100).cast("long").alias("value"))
    back, v = F.col("l_returnflag") == "R", F.col("value")
    rows = c.rows(c.cells(writes)).groupBy(F.col("bucket_ts").alias("day"), "l_linestatus")
    return rows.agg(F.sum(F.when(~back, v).otherwise(0)).alias("charged"), F.sum(F.when(back, v).otherwise(0)).alias("refunded"), F.sum(F.when(back, -v).otherwise(v)).alias("net"))


@query("SELECT date_trunc('day', ts) AS day, event_type, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL")
def hour_rollup(spark, sf_dir):
    return counter_hourly(spark, sf_dir).groupBy(F.date_trunc("day", "bucket_ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.sum("value").alias("value"))


@query("SELECT date_trunc('day', ts) AS day, event_type, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS avg, min(value) AS min, max(value) AS max FROM events GROUP BY ALL")
def avg_min_max(spark, sf_dir):
    rows = gauge_hourly(spark, sf_dir).groupBy(F.date_trunc("day", "bucket_ts").cast("timestamp_ntz").alias("day"), "event_type")
    return rows.agg(F.round(exact("sum") / F.sum("count"), 6).alias("avg"), F.min("min").alias("min"), F.max("max").alias("max"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(*[F.round(F.percentile("value", q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


_SENT = "SELECT event_id AS id, value, false AS final, 1 AS seq FROM events UNION ALL SELECT event_id, value * 2, true, 2 FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, value * 3, false, 3 FROM events WHERE event_id % 6 = 0"


@query(f"SELECT id, value, final, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY final DESC, seq DESC) AS n FROM ({_SENT})) WHERE n = 1")
def dedupe_final(spark, sf_dir):
    e = events(spark, sf_dir).select(F.col("event_id").alias("id"), "value")
    sent = e.withColumns({"final": F.lit(False), "seq": F.lit(1)})
    sent = sent.unionByName(e.where("id % 3 = 0").select("id", (F.col("value") * 2).alias("value"), F.lit(True).alias("final"), F.lit(2).alias("seq")))
    sent = sent.unionByName(e.where("id % 6 = 0").select("id", (F.col("value") * 3).alias("value"), F.lit(False).alias("final"), F.lit(3).alias("seq")))
    return latest(sent)


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS failures FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY failures DESC, user_id LIMIT 10")
def top_failures(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'error'")
    return e.groupBy("user_id").agg(F.count("*").alias("failures")).orderBy(F.desc("failures"), "user_id").limit(10)


@query("SELECT date_trunc('day', ts) AS day, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def uniq_users(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count_distinct("user_id").alias("users"))


@query("SELECT count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'purchase') AS purchases, round(count(*) FILTER (event_type = 'purchase') / count(*) FILTER (event_type = 'view'), 6) AS conversion FROM events")
def funnel(spark, sf_dir):
    n = {f"{t}s": F.count_if(F.col("event_type") == t) for t in ("view", "signup", "purchase")}
    return events(spark, sf_dir).agg(*[c.alias(k) for k, c in n.items()]).withColumn("conversion", F.round(F.try_divide("purchases", "views"), 6))


@query("SELECT CAST(isodow(ts) AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, CAST(count(*) AS BIGINT) AS value FROM events GROUP BY ALL ORDER BY value DESC, weekday, hour LIMIT 20")
def busiest_hour(spark, sf_dir):
    rows = counter_hourly(spark, sf_dir).groupBy((F.weekday("bucket_ts") + 1).alias("weekday"), F.hour("bucket_ts").alias("hour"))
    return rows.agg(F.sum("value").alias("value")).orderBy(F.desc("value"), "weekday", "hour").limit(20)


@query("SELECT date_trunc('day', ts) AS day, max(value) AS peak FROM events GROUP BY ALL ORDER BY peak DESC, day LIMIT 10")
def peak_per_day(spark, sf_dir):
    rows = gauge_hourly(spark, sf_dir).groupBy(F.date_trunc("day", "bucket_ts").cast("timestamp_ntz").alias("day"))
    return rows.agg(F.max("max").alias("peak")).orderBy(F.desc("peak"), "day").limit(10)


@query("SELECT date_trunc('day', ts) AS day, round(max(value) FILTER (event_type = 'purchase') / max(value), 6) AS share FROM events GROUP BY ALL")
def max_if_share(spark, sf_dir):
    rows = gauge_hourly(spark, sf_dir).groupBy(F.date_trunc("day", "bucket_ts").cast("timestamp_ntz").alias("day"))
    return rows.agg(F.round(F.try_divide(F.max(F.when(F.col("event_type") == "purchase", F.col("max"))), F.max("max")), 6).alias("share"))


@query("SELECT date_trunc('day', ts) AS day, CAST(sum(CASE event_type WHEN 'signup' THEN 25 WHEN 'purchase' THEN 40 ELSE 0 END) AS BIGINT) AS revenue FROM events GROUP BY ALL")
def weighted_sum(spark, sf_dir):
    weight = F.when(F.col("event_type") == "signup", 25).when(F.col("event_type") == "purchase", 40).otherwise(0)
    return hour_rollup(spark, sf_dir).groupBy("day").agg(F.sum(F.col("value") * weight).alias("revenue"))


@query("SELECT event_type, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6) AS average, count(*) AS n FROM events GROUP BY event_type")
def average_by_dim(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(exact("value") / F.count("*"), 6).alias("average"), F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS hour, CAST(count(*) AS BIGINT) AS raw, CAST(count(*) AS BIGINT) AS bucketed FROM events GROUP BY ALL")
def raw_equals_buckets(spark, sf_dir):
    """Counting raw rows by the hour gives what the counter's windows hold."""
    raw = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("raw"))
    return raw.join(counter_hourly(spark, sf_dir).groupBy(F.col("bucket_ts").alias("hour")).agg(F.sum("value").alias("bucketed")), "hour")


@query("SELECT date_trunc('day', ts) AS day, user_id % 20 AS path, CAST(count(*) AS BIGINT) AS views FROM events WHERE event_type = 'view' GROUP BY ALL")
def daily_views(spark, sf_dir):
    e = events(spark, sf_dir).where("event_type = 'view'")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), (F.col("user_id") % 20).alias("path")).agg(F.count("*").alias("views"))


@query(
    """SELECT g.b AS hour, t.event_type, CAST(coalesce(n, 0) AS BIGINT) AS value
    FROM (SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS b FROM events) g CROSS JOIN (SELECT DISTINCT event_type FROM events) t
    LEFT JOIN (SELECT date_trunc('hour', ts) AS b, event_type, count(*) AS n FROM events GROUP BY ALL) c ON c.b = g.b AND c.event_type = t.event_type"""
)
def zero_fill(spark, sf_dir):
    """Every series over the whole table's range; its two ends are all that reaches the driver."""
    cells = EVENTS.cells(unit_events(events(spark, sf_dir)))
    first, last = cells.agg(F.min("bucket_ms"), F.max("bucket_ms")).first()
    hours = F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"), F.lit(HOUR).cast("long"))
    spine = cells.select("event_type").distinct().select("event_type", F.explode(hours).alias("bucket_ms"))
    found = spine.join(cells.select("event_type", "bucket_ms", "value"), ["event_type", "bucket_ms"], "left")
    return found.select(timestamp(F.col("bucket_ms")).alias("hour"), "event_type", F.coalesce("value", F.lit(0)).alias("value"))


# ---- not to be told in SQL ----


@query()
def sample_random(spark, sf_dir):
    return Event("sampled", FIELDS, sample=0.25, seed=7).staged(_record(events(spark, sf_dir)), NOW, ids=_id()).select("id", "ts", "_sample_rate")


@query()
def event_uuid_ids(spark, sf_dir):
    return RAW.staged(_record(events(spark, sf_dir)), NOW).select("id", "ts")


