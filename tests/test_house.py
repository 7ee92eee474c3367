import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.house import House, first_tick_delay
from tidemark.operators.counter import Counter
from tidemark.operators.event import Event
from tidemark.operators.gauge import Gauge
from tidemark.operators.level import Level
from tidemark.schema import int_, str_
from tidemark.sources.ledger import Ledger
from tidemark.sources.sinks import files, latest
from tidemark.streaming.pipeline import ingest, level_stream, upsert_sink, windowed

T0 = 1_788_616_980_000


def at(ms):
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)


class Sink:
    def __init__(self):
        self.batches, self.broken = [], False

    def __call__(self, rows, ctx):
        if self.broken:
            raise OSError("sink is down")
        self.batches.append(([r.asDict() for r in rows.collect()], ctx))


@pytest.fixture
def clock():
    class Clock:
        ms = T0 + 5500

        def __call__(self):
            return self.ms

    return Clock()


@pytest.fixture
def sink():
    return Sink()


def counter(sink):
    return Counter("hits", {"page": str_()}, resolution="1s", flush="5s", grace="0s", write=sink)


def hits(spark, *rows):
    return spark.createDataFrame([(at(T0 + ms), p, v) for ms, p, v in rows], "ts timestamp_ntz, page string, value long")


def test_flush_ships_closed_windows_once(spark, tmp_path, clock, sink):
    house = House(spark, str(tmp_path), [counter(sink)], now=clock)
    house.write("hits", hits(spark, (100, "a", 1), (200, "a", 2), (1100, "b", 5), (5400, "a", 9)))
    report = house.flush().raise_if_failed()
    assert report.metrics["hits"].shipped == 2
    rows, ctx = sink.batches[0]
    assert sorted((r["page"], r["value"]) for r in rows) == [("a", 3), ("b", 5)]
    assert (ctx.bucket_from, ctx.bucket_to, ctx.total, ctx.attempt, ctx.source) == (T0, T0 + 2000, 8, 1, "flush")
    assert house.flush().metrics["hits"].skipped == "cadence"
    clock.ms += 6000
    assert house.flush().metrics["hits"].shipped == 1 and sink.batches[1][0][0]["value"] == 9
    assert house.pending("hits") == 0


def test_failed_sink_gets_the_merged_rows_again(spark, tmp_path, clock, sink):
    seen = []
    house = House(spark, str(tmp_path), [counter(sink)], now=clock, on_error=lambda n, e: seen.append((n, str(e))))
    house.write("hits", hits(spark, (100, "a", 1)))
    sink.broken = True
    report = house.flush()
    assert report.failed == ["hits"] and seen == [("hits", "sink is down")]
    with pytest.raises(RuntimeError):
        report.raise_if_failed()
    sink.broken = False
    house.write("hits", hits(spark, (150, "a", 4)))  # late: what was claimed has gone back, the floor stays
    assert house.flush().metrics["hits"].error is None
    rows, ctx = sink.batches[0]
    assert sum(r["value"] for r in rows) == 5 and ctx.attempt == 2


def test_late_writes_move_forward(spark, tmp_path, clock, sink):
    house = House(spark, str(tmp_path), [counter(sink)], now=clock)
    house.write("hits", hits(spark, (100, "a", 1), (3100, "a", 1)))
    house.flush()
    house.write("hits", hits(spark, (200, "a", 7)))
    rows = house.snapshot()["hits"].collect()
    assert [(r.bucket_ts, r.value) for r in rows] == [(at(T0 + 4000), 7)]


def test_claims_settle_once(spark, tmp_path, clock, sink):
    c = counter(sink)
    store = Ledger(spark, str(tmp_path))
    store.append(c, c.ops(hits(spark, (100, "a", 1), (5400, "a", 2))))
    claim = store.claim(c, T0 + 5000, clock())
    assert store.read_buckets(c).count() == 1 and store.count_pending(c) == 2
    assert store.claim(c, T0 + 5000, clock()) is None
    store.release(claim)
    assert store.read_buckets(c).count() == 2
    with pytest.raises(RuntimeError):
        store.release(claim)
    claim = store.claim(c, T0 + 5000, clock())
    store.ack(claim, c)
    with pytest.raises(RuntimeError):
        store.ack(claim, c)
    assert store.sum_buckets(c, 0, T0 + 10_000) == 2 and store.count_pending(c) == 1
    second = store.claim(c, T0 + 6000, clock())
    assert store.recover(c, clock() + 1000) == [] and [x.id for x in store.recover(c, clock() + 400_000)] == [second.id]
    with pytest.raises(RuntimeError):
        store.ack(second, c)
    store.ack(store.claim(c, T0 + 6000, clock()), c)
    assert len(store.claims(c, "acked")) == 1 and store.vacuum(c) == 1 and store.read_buckets(c) is None


def test_kinds_and_turns(spark, tmp_path, clock, sink):
    store = Ledger(spark, str(tmp_path))
    c = counter(sink)
    store.append(c, c.ops(hits(spark, (100, "a", 1))), key="q-1")
    store.append(c, c.ops(hits(spark, (100, "a", 1))), key="q-1")
    assert store.read_buckets(c).first().value == 1
    g = Gauge("hits", {"page": str_()}, resolution="1s")
    with pytest.raises(ValueError):
        store.append(g, g.ops(hits(spark, (100, "a", 1))))
    token = store.take_turn("hits", 1000, 500)
    assert token and store.take_turn("hits", 1400, 500) is None and not store.return_turn("hits", "other")
    assert store.return_turn("hits", token) and store.take_turn("hits", 1400, 500)


def test_rows_of_many_partitions_keep_their_order(spark, tmp_path, clock):
    e = Event("seen", {"n": int_()})
    store = Ledger(spark, str(tmp_path))
    store.append(e, e.staged(spark.range(0, 1600, 1, 16).selectExpr("id AS n"), clock()))
    assert store.read_pending(e).select("seq").distinct().count() == 1600
    claim = store.claim_records(e, clock(), limit=10)
    assert [r.n for r in store.claimed_records(claim, e).collect()] == list(range(10))
    store.ack(claim, e)
    assert [r.n for r in store.read_pending(e, limit=3).collect()] == [10, 11, 12] and store.count_pending(e) == 1590


def test_a_batch_that_lands_after_a_claim_is_not_lost(spark, tmp_path, clock, sink):
    """Batch 1 is begun, batch 2 shipped, then batch 1 lands."""
    c, store = counter(sink), Ledger(spark, str(tmp_path))

    class Slow(Ledger):
        def floor(self, metric):
            found = super().floor(metric)
            if not hasattr(self, "done"):  # another process appends and ships between the reading of the floor and the commit
                self.done = True
                store.append(c, c.ops(hits(spark, (100, "a", 1), (1100, "b", 2))))
                claim = store.claim(c, T0 + 5000, clock())
                assert {(r.page, r.value) for r in store.claimed_cells(claim, c).collect()} == {("a", 1), ("b", 2)}
                store.ack(claim, c)
            return found

    Slow(spark, str(tmp_path)).append(c, c.ops(hits(spark, (200, "a", 5), (6000, "a", 7))))
    floor = store.floor(c)
    assert floor == T0 + 1001 and store.count_pending(c) == 2
    # its windows have shipped, so its rows moved to the first that has not
    assert [(r.bucket_ms - T0, r.value) for r in store.read_buckets(c).collect()] == [(2000, 5), (6000, 7)]
    claim = store.claim(c, T0 + 5000, clock())
    assert [(r.bucket_ms - T0, r.value) for r in store.claimed_cells(claim, c).collect()] == [(2000, 5)]
    store.release(claim)
    assert [(r.bucket_ms - T0, r.value) for r in store.read_buckets(c).collect()] == [(2000, 5), (6000, 7)]
    claim = store.claim(c, T0 + 5000, clock())
    store.ack(claim, c)
    assert [(r.bucket_ms - T0, r.value) for r in store.read_buckets(c).collect()] == [(6000, 7)] and len(store.claims(c, "acked")) == 1


def test_two_claimers_take_a_row_once(spark, tmp_path, clock, sink):
    from concurrent.futures import ThreadPoolExecutor

    c = counter(sink)
    Ledger(spark, str(tmp_path)).append(c, c.ops(hits(spark, (100, "a", 1), (1100, "b", 2))))
    stores = [Ledger(spark, str(tmp_path)) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(lambda s: s.claim(c, T0 + 5000, clock()), stores))
        won = [f for f in found if f is not None]
        assert len(won) == 1 and stores[0].claimed_cells(won[0], c).count() == 2
        tokens = list(pool.map(lambda s: s.take_turn("x", 1000, 500), stores))
        assert sum(t is not None for t in tokens) == 1
        settled = list(pool.map(lambda s: s._settle(won[0], "acked"), stores))
    assert sum(settled) == 1 and stores[0].floor(c) == T0 + 1001
    assert stores[0].take_turn("x", 1400, 500) is None and stores[0].take_turn("x", 1500, 500)


def test_a_broken_append_is_written_over(spark, tmp_path, clock, sink):
    c, store = counter(sink), Ledger(spark, str(tmp_path))
    number, there = store._number(c, "q-7")
    c.ops(hits(spark, (100, "a", 9))).write.parquet(f"{tmp_path}/rows/hits/batch={number}")  # data, but no commit
    assert not there and store.read_buckets(c) is None and store.count_pending(c) == 0
    for _ in range(2):
        assert store.append(c, c.ops(hits(spark, (100, "a", 1))), key="q-7") == number
    assert [r.value for r in store.read_buckets(c).collect()] == [1]


def test_levels_read_from_the_last_claim(spark, tmp_path, clock, sink):
    v = Level("depth", {"queue": str_()}, resolution="1s", flush="2s", hold_for="10s")
    store = Ledger(spark, str(tmp_path))
    shape = "ts timestamp_ntz, queue string, value double, mode string"
    for n in range(5):
        rows = [(at(T0 + 2000 * n + 100), "q", 2.0 if n else 5.0, "add" if n else "set")] + ([(at(T0 + 100), "gone", 1.0, "set")] if n == 0 else [])
        store.append(v, v.ops(spark.createDataFrame(rows, shape)))
        claim = store.claim(v, T0 + 2000 * n + 1000, clock())
        assert store.claim(v, T0 + 2000 * n + 1000, clock()) is None  # one at a time
        store.ack(claim, v)
        store.vacuum(v)
    assert store.files.names("rows/depth") == [] or len(store.files.names("rows/depth")) <= 1
    assert len(store.files.names("base/depth")) == 1
    store.append(v, v.ops(spark.createDataFrame([(at(T0 + 12_100), "q", 1.0, "add")], shape)))
    assert {(r.queue, r.value) for r in store.read_levels(v, T0 + 12_100).collect()} == {("q", 14.0)}
    claim = store.claim(v, T0 + 13_000, clock())
    assert {(r.bucket_ms - T0, r.queue, r.value) for r in store.claimed_cells(claim, v).collect()} == {(9000, "q", 13.0), (10_000, "q", 13.0), (11_000, "q", 13.0), (12_000, "q", 14.0), (9000, "gone", 1.0), (10_000, "gone", 1.0)}
    store.release(claim)
    assert {(r.bucket_ms - T0, r.value) for r in store.read_buckets(v).collect()} == {(12_000, 14.0)}
    store.ack(store.claim(v, T0 + 13_000, clock()), v)
    assert {r.queue for r in spark.read.parquet(f"{tmp_path}/base/depth/*").collect()} == {"q"}  # the hold of the other has run out


class Held:
    """A store of another make: lists in memory behind the protocol alone."""

    durable, shared = False, False

    def __init__(self, spark):
        self.spark, self.rows, self.taken = spark, {}, {}

    def append(self, metric, rows, key=None):
        self.rows.setdefault(metric.name, []).append(rows.cache())
        return len(self.rows[metric.name])

    def _all(self, metric):
        found = self.rows.get(metric.name)
        return None if not found else __import__("functools").reduce(lambda a, b: a.unionByName(b), found)

    def read_buckets(self, metric, start=None, end=None, dim_key=None):
        return None if self._all(metric) is None else metric.fold(self._all(metric))

    def read_pending(self, metric, start=None, end=None, limit=None):
        return self._all(metric)

    def count_pending(self, metric):
        return 0 if self._all(metric) is None else self._all(metric).count()

    level_cells = read_buckets

    def floor(self, metric):
        return 0

    def shipped_to(self, metric):
        return None

    def claim(self, metric, up_to, now, ahead_from=None, attempt=1):
        self.taken[metric.name] = self.rows.pop(metric.name, None)
        return metric.name if self.taken[metric.name] else None

    def claim_records(self, metric, now, limit=None, attempt=1):
        return self.claim(metric, None, now)

    def claimed_cells(self, claim, metric):
        return metric.fold(self.claimed_records(claim, metric))

    def claimed_records(self, claim, metric):
        return __import__("functools").reduce(lambda a, b: a.unionByName(b), self.taken[claim])

    def ack(self, claim, metric):
        del self.taken[claim]

    def release(self, claim):
        self.rows[claim] = self.taken.pop(claim)

    def recover(self, metric, now):
        return []

    def take_turn(self, name, now, interval):
        return name

    def return_turn(self, name, token):
        return True


def test_a_house_on_a_store_of_another_make(spark, clock, sink):
    warned = []
    e = Event("seen", {"n": int_()}, write=sink, flush="5s")
    v = Level("depth", {"queue": str_()}, resolution="1s", flush="2s", grace="0s", write=sink)
    house = House(spark, Held(spark), [counter(sink), e, v], now=clock, on_warn=warned.append)
    assert warned
    house.write("hits", hits(spark, (100, "a", 1), (200, "a", 2)))
    house.write("seen", spark.createDataFrame([(7, 1)], "n long, seq long"))
    house.write("depth", spark.createDataFrame([(at(T0 + 2100), "q", 5.0)], "ts timestamp_ntz, queue string, value double"))
    assert house.snapshot()["hits"].first().value == 3 and house.pending("seen") == 1 and house.peek("seen").first().n == 7 and house.current()["hits"].count() == 0
    sink.broken = True
    assert set(house.flush(final=True).failed) == {"hits", "seen", "depth"} and house.pending("hits") == 2
    sink.broken = False
    house.flush(final=True).raise_if_failed()
    assert {ctx.metric for _, ctx in sink.batches} == {"hits", "seen", "depth"}


def test_records_wait_in_memory_by_size_and_age(spark, clock, sink):
    from tidemark.sources.staging import LocalStage

    e = Event("seen", {"n": int_()}, write=sink, flush="5s")
    stage = LocalStage(spark, e, max_size=3, max_age="10s", max_staged=8, now=clock)
    stage.record_many([{"n": i} for i in range(5)])
    assert [[r["n"] for r in rows] for rows, _ in sink.batches] == [[0, 1, 2]] and len(stage) == 2 and stage.poll() == 0
    clock.ms += 10_000
    assert stage.poll() == 2 and sink.batches[1][1].source == "batch"
    sink.broken = True
    stage.record_many([{"n": i} for i in range(3)])
    sink.broken = False
    stage.record({"n": 3})  # too early after the failure
    assert len(stage) == 4 and len(sink.batches) == 2
    with pytest.raises(ValueError):
        stage.record_many([{"n": 0}] * 5)
    clock.ms += 10_000
    stage.record({"n": 4})
    assert [[r["n"] for r in rows] for rows, _ in sink.batches[2:]] == [[0, 1, 2]] and sink.batches[2][1].attempt == 2
    assert stage.drain() == 2 and len(stage) == 0
    with pytest.raises(ValueError):
        stage.record({"m": 1})
    with pytest.raises(ValueError):
        LocalStage(spark, Event("kept", {"n": int_()}, durability="durable"))


def test_texts_are_ordered_as_people_expect(spark, tmp_path, clock, sink):
    house = House(spark, str(tmp_path), [counter(sink)], now=clock)
    house.write("hits", hits(spark, *[(5100, p, 1) for p in ("b", "B", "é", "a", "z", "E")]))
    assert [r.page for r in house.snapshot(order_by="page", direction="asc")["hits"].collect()] == ["a", "b", "B", "E", "é", "z"]


def test_values_that_no_longer_fit_are_reported(spark, tmp_path, clock, sink):
    warned = []
    old = Event("seen", {"n": str_()}, flush="5s")
    Ledger(spark, str(tmp_path)).append(old, old.staged(spark.createDataFrame([("x",), ("5",)], "n string"), clock()))
    house = House(spark, str(tmp_path), [Event("seen", {"n": int_()}, write=sink, flush="5s")], now=clock, on_warn=warned.append)
    house.flush().raise_if_failed()
    assert warned == ["seen: values that do not fit: n in 1 records"] and {str(r["n"]) for r in sink.batches[0][0]} == {"x", "5"}


def test_events_ship_in_order_and_in_parts(spark, tmp_path, clock, sink):
    e = Event("seen", {"n": int_()}, write=sink, flush="5s")
    house = House(spark, str(tmp_path), [e], now=clock, claim_limit=3)
    house.write("seen", spark.createDataFrame([(i, i) for i in range(5)], "n long, seq long").coalesce(1))
    assert house.pending("seen") == 5 and [r.n for r in house.peek("seen", 2).collect()] == [0, 1]
    assert [r.n for r in house.snapshot(order_by="n", limit=2)["seen"].collect()] == [4, 3]
    report = house.flush().metrics["seen"]
    assert (report.shipped, report.claims) == (5, 2)
    assert [[r["n"] for r in rows] for rows, _ in sink.batches] == [[0, 1, 2], [3, 4]]


def test_levels_ship_what_they_hold(spark, tmp_path, clock, sink):
    v = Level("depth", {"queue": str_()}, resolution="1s", flush="2s", grace="0s", write=sink)
    house = House(spark, str(tmp_path), [v], now=clock)
    house.write("depth", spark.createDataFrame([(at(T0 + 2100), "q", 5.0)], "ts timestamp_ntz, queue string, value double"))
    house.flush().raise_if_failed()
    assert [(r["bucket_ts"], r["value"]) for r in sorted(sink.batches[0][0], key=lambda r: r["bucket_ts"])] == [(at(T0 + 1000 * i), 5.0) for i in (2, 3, 4)]
    clock.ms += 2000
    house.flush().raise_if_failed()
    assert sorted(r["bucket_ts"] for r in sink.batches[1][0]) == [at(T0 + 5000), at(T0 + 6000)]
    house.write("depth", spark.createDataFrame([(at(T0 + 7200), "q", 2.0, "add")], "ts timestamp_ntz, queue string, value double, mode string"))
    assert [r.value for r in house.snapshot()["depth"].collect()] == [7.0]
    assert house.current()["depth"].first().value == 7.0


def test_a_moved_set_gives_way_to_its_windows_own(spark, tmp_path, clock, sink):
    v = Level("depth", {"queue": str_()}, resolution="1s", flush="2s", grace="0s", write=sink)
    rows = [(0, "a", "set", 5.0, 1, False), (0, "a", "set", 9.0, 2, True), (0, "a", "add", 1.0, 3, False)]  # own set, then moved
    rows += [(0, "b", "add", 2.0, 1, False), (0, "b", "set", 9.0, 2, True)]  # own add, then moved set
    rows += [(0, "c", "set", 9.0, 1, True), (0, "c", "add", 2.0, 2, False), (0, "d", "set", 9.0, 1, True), (0, "d", "set", 4.0, 2, False)]  # moved first
    ops = spark.createDataFrame([(b, q, q, m, x, n, late) for b, q, m, x, n, late in rows], "bucket_ms long, dim_key string, queue string, mode string, v double, seq long, moved boolean")
    assert {r.queue: r.value for r in v.fold(ops).collect()} == {"a": 6.0, "b": 2.0, "c": 11.0, "d": 4.0}
    house = House(spark, str(tmp_path), [v], now=clock)
    shape = "ts timestamp_ntz, queue string, value double"
    house.write("depth", spark.createDataFrame([(at(T0 + 2100), "q", 5.0)], shape))
    house.flush().raise_if_failed()
    clock.ms += 100
    house.write("depth", spark.createDataFrame([(at(clock.ms), "q", 3.0)], shape))
    house.write("depth", spark.createDataFrame([(at(T0 + 2200), "q", 8.0)], shape))  # late: lands in the open window
    assert house.current()["depth"].first().value == 3.0


def test_registry_and_house_settings(spark, tmp_path, clock, sink):
    c = counter(sink)
    house = House(spark, str(tmp_path), [c], now=clock, flush="10s", grace="1s", delivery="auto")
    assert house.delivery == "staged" and house.get("hits") is c and house.flush_ms(c) == 5000
    open_ = Counter("open", {}, resolution="1s")
    house.register(open_)
    assert house.flush_ms(open_) == 10_000 and house.grace_ms(open_) == 1000
    with pytest.raises(ValueError):
        house.register(Counter("new", {}), Counter("open", {}))
    with pytest.raises(KeyError):
        house.get("new")
    assert house.flush(only=["nope"]).unmatched == ["nope"]
    with pytest.raises(ValueError):
        house.flush(only=["nope"], strict=True)
    with pytest.raises(ValueError):
        House(spark, str(tmp_path), delivery="never")
    assert 0 <= first_tick_delay("hits", 5000) < 5000 and first_tick_delay("a", 2**32) == 0xE40C292C


def test_immediate_rows_are_superseded(spark, tmp_path, clock, sink):
    house = House(spark, str(tmp_path), [counter(sink)], now=clock, delivery="immediate")
    house.write("hits", hits(spark, (5100, "a", 1)))
    house.write("hits", hits(spark, (5200, "a", 2)))
    assert [(b[0][0]["value"], b[1].source) for b in sink.batches] == [(1, "immediate"), (3, "immediate")]
    clock.ms += 1000
    house.flush()
    assert len({b[0][0]["id"] for b in sink.batches}) == 1 and sink.batches[-1][1].source == "flush"


def test_collectors_and_stop(spark, tmp_path, clock, sink):
    g = Gauge("temp", {}, resolution="1s", flush="5s", write=sink)
    house = House(spark, str(tmp_path), [g], now=clock)
    house.collect("temp", lambda m: spark.createDataFrame([(at(clock()), 20.5)], "ts timestamp_ntz, value double"))
    assert house.run_collectors() == []
    clock.ms = T0 + 5950
    assert house.run_collectors() == ["temp"] and house.run_collectors() == []
    clock.ms = T0 + 6100
    house.stop().raise_if_failed()
    assert sink.batches[0][0][0]["max"] == 20.5
    with pytest.raises(ValueError):
        house.collect("temp", lambda m: None, lead="2s")


def test_final_copies_win(spark):
    df = spark.createDataFrame([("a", 1, True, 1), ("a", 2, False, 2), ("b", 3, False, 1), ("b", 4, False, 2)], "id string, v int, final boolean, seq int")
    assert sorted((r.id, r.v) for r in latest(df).collect()) == [("a", 1), ("b", 4)]


def test_sinks_write_files(spark, tmp_path, clock):
    c = Counter("hits", {"page": str_()}, resolution="1s", flush="5s", grace="0s", write=files(f"{tmp_path}/out", "json"))
    house = House(spark, f"{tmp_path}/store", [c], now=clock)
    house.write("hits", hits(spark, (100, "a", 1)))
    house.flush().raise_if_failed()
    assert spark.read.json(f"{tmp_path}/out/hits").first()["value"] == 1


def test_streams_land_in_the_ledger(spark, tmp_path, clock, sink):
    house = House(spark, f"{tmp_path}/store", [counter(sink)], now=clock)
    source = f"{tmp_path}/in"
    stream = lambda: spark.readStream.schema("ts timestamp_ntz, page string, value long").parquet(source)
    hits(spark, (100, "a", 1), (5400, "a", 2)).write.parquet(source)
    ingest(house, "hits", stream(), f"{tmp_path}/cp").awaitTermination()
    assert [r["value"] for rows, _ in sink.batches for r in rows] == [1]
    clock.ms += 6000
    hits(spark, (200, "a", 4)).write.mode("append").parquet(source)  # late: lands in the first open window
    ingest(house, "hits", stream(), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["value"] for rows, _ in sink.batches[1:] for r in rows) in ([2, 4], [6])
    assert house.pending("hits") == 0


def test_update_mode_windows(spark, tmp_path):
    c = Counter("hits", {"page": str_()}, resolution="1s")
    hits(spark, (100, "a", 1), (200, "a", 2), (1100, "b", 3)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp_ntz, page string, value long").parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    q = windowed(c, stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.id, r.value) for r in spark.table("w").collect()}
    assert got == {(r.id, r.value) for r in c.rows(c.cells(spark.read.parquet(f"{tmp_path}/in"))).collect()}


def test_level_state_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    v = Level("depth", {"queue": str_()}, resolution="1s")
    shape = "ts timestamp_ntz, queue string, mode string, value double, seq long"
    df = spark.createDataFrame([(at(T0 + 100), "q", "set", 5.0, 1), (at(T0 + 2100), "q", "set", 9.0, 2), (at(T0 + 1100), "q", "add", 2.0, 3)], shape)
    df.write.parquet(f"{tmp_path}/in")
    q = level_stream(v, spark.readStream.schema(shape).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").format("memory").queryName("lv").trigger(availableNow=True).start()
    q.awaitTermination()
    # a late add moves what comes after it, a later set too
    assert {(r.bucket_ms - T0, r.value) for r in spark.table("lv").collect()} == {(0, 5.0), (1000, 7.0), (2000, 11.0)}
    assert callable(upsert_sink(str(tmp_path)))
