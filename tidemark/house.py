"""The registry that binds metrics to a store, a clock and defaults, and ships what is finished."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import bucket_start, closed_up_to, landing, parse_duration, parse_interval
from tidemark.operators.base import DEFAULT_FLUSH, DEFAULT_GRACE, EVENT_FLUSH, Bucketed, Metric, WriteContext
from tidemark.operators.event import Event
from tidemark.operators.level import Level
from tidemark.plans.snapshot import open_cells, snapshot
from tidemark.sources.ledger import Claim, Ledger, Store

#: Claims that one flush ships at most.
CLAIMS = 100


@dataclass
class FlushReport:
    metric: str
    shipped: int = 0
    claims: int = 0
    recovered: int = 0
    skipped: str | None = None  # cadence or turn
    error: BaseException | None = None


@dataclass
class HouseReport:
    metrics: dict[str, FlushReport] = field(default_factory=dict)
    unmatched: list[str] = field(default_factory=list)

    @property
    def failed(self) -> list[str]:
        return [n for n, r in self.metrics.items() if r.error is not None]

    def raise_if_failed(self) -> HouseReport:
        for r in self.metrics.values():
            if r.error is not None:
                raise RuntimeError(f"flush failed: {', '.join(self.failed)}") from r.error
        return self


def first_tick_delay(name: str, flush: int) -> int:
    """Where in its interval a metric first ticks: 32-bit FNV-1a of its name."""
    h = 2166136261
    for unit in name.encode("utf-16-le")[::2]:
        h = (h ^ unit) * 16777619 % 2**32
    return h % flush


def collect_lead(resolution: int) -> float:
    """How long before a window's end it is collected."""
    return min(1000, resolution / 10)


class House:
    def __init__(
        self,
        spark: SparkSession,
        store: Store | str,
        metrics: Iterable[Metric] = (),
        *,
        now: Callable[[], int] | None = None,
        delivery: str = "staged",
        flush: str | int | None = None,
        grace: str | int | None = None,
        claim_limit: int | None = None,
        on_error: Callable[[str, BaseException], None] | None = None,
        on_warn: Callable[[str], None] | None = None,
    ):
        if delivery not in ("staged", "immediate", "auto"):
            raise ValueError(f"delivery {delivery!r}: staged, immediate or auto")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.store = spark, Ledger(spark, store) if isinstance(store, str) else store
        self.now = now or (lambda: int(time.time() * 1000))
        self.delivery = delivery if delivery != "auto" else "staged" if self.store.durable else "immediate"
        self.defaults = (None if flush is None else parse_interval(flush, "flush"), None if grace is None else parse_duration(grace, "grace"))
        self.claim_limit, self.on_error, self.on_warn = claim_limit, on_error, on_warn or (lambda _: None)
        self._metrics: dict[str, Metric] = {}
        self._attempts: dict[str, int] = {}
        self._flushed: dict[str, int] = {}
        self._collectors: dict[str, tuple[Callable, float]] = {}
        self._collected: dict[str, int] = {}
        self._lock = threading.RLock()
        self._busy: dict[str, threading.Lock] = {}
        self._timers: list[threading.Thread] = []
        self._stop = threading.Event()
        if not self.store.durable:
            self.on_warn("what is not flushed is lost when this process ends")
        if self.delivery == "immediate":
            self.on_warn("rows of an open window are sent again as it fills: the sink must keep one for each id, and a flush row before others")
        self.register(*metrics)

    # ---- registry ----

    def register(self, *metrics: Metric) -> None:
        """Bind all or none; a name can be bound once."""
        names = [m.name for m in metrics]
        if taken := {n for n in names if names.count(n) > 1 or n in self._metrics}:
            raise ValueError(f"registered already: {sorted(taken)}")
        for m in metrics:
            if isinstance(m, Event) and m.durability == "durable" and not self.store.durable:
                self.on_warn(f"{m.name}: asks to be durable, which this store is not")
        self._metrics |= {m.name: m for m in metrics}
        self._busy |= {n: threading.Lock() for n in names}

    def get(self, name: str) -> Metric:
        return self._metrics[name]

    @property
    def metrics(self) -> list[Metric]:
        return list(self._metrics.values())

    def flush_ms(self, metric: Metric) -> int:
        """The metric's own setting, else the house's, else the kind's."""
        own = parse_interval(metric.flush) if metric.flush is not None else self.defaults[0]
        return own or (EVENT_FLUSH if isinstance(metric, Event) else DEFAULT_FLUSH)

    def grace_ms(self, metric: Bucketed) -> int:
        own = parse_duration(metric.grace) if metric.grace is not None else self.defaults[1]
        return DEFAULT_GRACE if own is None else own

    def _chosen(self, only: Iterable[str] | None, strict: bool) -> tuple[list[Metric], list[str]]:
        names = list(self._metrics if only is None else only)
        unmatched = [n for n in names if n not in self._metrics]
        if strict and unmatched:
            raise ValueError(f"no such metrics: {unmatched}")
        return [self._metrics[n] for n in names if n in self._metrics], unmatched

    # ---- writes ----

    def write(self, name: str, df: DataFrame, key: str | None = None) -> int:
        """Append writes of one metric, all or none; derived counters get theirs first, from every record."""
        metric = self._metrics[name]
        if isinstance(metric, Event):
            for counter, rows in metric.derived(df, self.now()).items():
                self.store.append(counter, counter.ops(rows), key and f"{name}-{key}")
            batch = self.store.append(metric, metric.staged(df, self.now()), key)
        else:
            batch = self.store.append(metric, metric.ops(df), key)
        if self.delivery == "immediate":
            self._send_open(metric)
        return batch

    def _send_open(self, metric: Metric) -> None:
        """Ship the open window's whole fold, or all pending records; a later flush row has the same id and wins."""
        if isinstance(metric, Event):
            self.flush_one(metric, force=True, source="immediate")
            return
        at = bucket_start(self.now(), metric.res)
        rows = self.cells(metric, at).where(F.col("bucket_ms") >= at)
        b = metric.bounds(rows)
        if b["rows"] and metric.write is not None:
            metric.write(metric.rows(rows), WriteContext(metric.name, metric.kind, b["bucket_from"], b["bucket_to"], b["total"], 1, "immediate"))

    # ---- reads ----

    def cells(self, metric: Bucketed, start: int | None = None, end: int | None = None) -> DataFrame:
        """Live cells; of all but a level, whose values come from earlier windows, only those that begin in ``[start, end)``."""
        if isinstance(metric, Level):
            found = self.store.level_cells(metric)
            return self._no_cells(metric) if found is None else found
        found = self.store.read_buckets(metric, start, end)
        return self._no_cells(metric) if found is None else found

    def _no_cells(self, metric: Bucketed) -> DataFrame:
        shape = {d: metric.dims[d].spark_type.simpleString() for d in metric.dims}
        values = {c: metric._value_type(c).simpleString() for c in metric.value_columns}
        columns = {"bucket_ms": "bigint", "dim_key": "string", **shape, **values}
        return self.spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in columns.items()))

    def snapshot(self, only: Iterable[str] | None = None, strict: bool = False, **options: Any) -> dict[str, DataFrame]:
        """Live rows of each metric; options as of the snapshot plan."""
        out = {}
        for m in self._chosen(only, strict)[0]:
            if isinstance(m, Event):
                pending = self.store.read_pending(m)
                if pending is not None:
                    out[m.name] = m.snapshot(pending.drop("batch", "arrival"), **{k: v for k, v in options.items() if k in ("start", "end", "order_by", "direction", "limit")})
            else:
                own = options if not isinstance(m, Level) or self.store.shipped_to(m) is None else {**options, "start": max(options.get("start") or 0, self.store.shipped_to(m))}
                out[m.name] = snapshot(m, self.cells(m, own.get("start"), own.get("end")), self.now(), **own)
        return out

    def current(self, only: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """The open window of every bucketed metric."""
        out = {}
        for m in self._chosen(only, False)[0]:
            if isinstance(m, Bucketed):
                now, floor = self.now(), self.store.floor(m)
                at = landing(bucket_start(now, m.res), floor, m.res)
                out[m.name] = m.rows(open_cells(m, self.cells(m, at, at + m.res), now, floor=floor))
        return out

    def pending(self, name: str) -> int:
        return self.store.count_pending(self._metrics[name])

    def peek(self, name: str, n: int = 10) -> DataFrame | None:
        rows = self.store.read_pending(self._metrics[name])
        return None if rows is None else self._metrics[name].peek(rows.drop("batch", "arrival"), n)

    # ---- shipping ----

    def _ship(self, metric: Metric, claim: Claim, source: str) -> int:
        """Rows to the sink, then settle; a sink that raises puts them back for the next attempt."""
        held: DataFrame | None = None
        try:
            if isinstance(metric, Event):
                stored = self.store.claimed_records(claim, metric)
                rows, b = metric.reread(stored), metric.bounds(stored)
                self._report_misfits(metric, rows)
                rows = rows.drop("_misfits")
            else:
                held = cells = self.store.claimed_cells(claim, metric).persist()  # read for the bounds, then for the sink
                rows, b = metric.rows(cells), metric.bounds(cells)
                if b["rows"]:
                    self._report_unreadable(metric, cells)
            if b["rows"] and metric.write is not None:
                metric.write(rows, WriteContext(metric.name, metric.kind, b["bucket_from"], b["bucket_to"], b["total"], self._attempts.get(metric.name, 1), source))
        except BaseException:
            self._attempts[metric.name] = self._attempts.get(metric.name, 1) + 1
            self.store.release(claim)
            raise
        finally:
            if held is not None:
                held.unpersist()
        self.store.ack(claim, metric)
        self._attempts.pop(metric.name, None)
        return b["rows"]

    def _report_misfits(self, metric: Event, rows: DataFrame) -> None:
        """Tell how many records of a batch, and which fields, no longer fit the declaration; they ship as they are."""
        found = rows.where(F.size("_misfits") > 0).select(F.explode("_misfits").alias("f")).groupBy("f").agg(F.count("*").alias("n")).orderBy("f").collect()
        if found:
            self.on_warn(f"{metric.name}: values that do not fit: {', '.join(f'{r.f} in {r.n} records' for r in found)}")

    def _report_unreadable(self, metric: Bucketed, cells: DataFrame) -> None:
        """Tell which dims of stored keys cannot be read under the declaration as it is now."""
        raw = [f"_raw_{d}" for d in metric.dims]
        if not raw:
            return
        found = metric.decoded(cells.select("dim_key").distinct()).agg(*[F.count(F.col(c)).alias(c) for c in raw]).first()
        if bad := [f"{d} in {found[f'_raw_{d}']} series" for d in metric.dims if found[f"_raw_{d}"]]:
            self.on_warn(f"{metric.name}: keys that cannot be read: {', '.join(bad)}")

    def flush_one(self, metric: Metric | str, *, final: bool = False, force: bool = False, source: str = "flush") -> FlushReport:
        """Recover, claim and ship one metric, unless it shipped within its interval or another process has its turn."""
        metric = self._metrics[metric] if isinstance(metric, str) else metric
        report, now, every = FlushReport(metric.name), self.now(), self.flush_ms(metric)
        with self._busy[metric.name]:
            floor = every - every // 10
            if not (final or force) and now - self._flushed.get(metric.name, -(2**62)) < floor:
                report.skipped = "cadence"
                return report
            token = self.store.take_turn(metric.name, now, 0 if final or force else floor)
            if token is None:
                report.skipped = "turn"
                return report
            try:
                report.recovered = len(self.store.recover(metric, now))
                for _ in range(CLAIMS):
                    if isinstance(metric, Event):
                        claim = self.store.claim_records(metric, now, self.claim_limit)
                    else:
                        up_to = closed_up_to(metric.res, now, 0 if final else self.grace_ms(metric))
                        ahead = up_to if final and not self.store.durable else None
                        if isinstance(metric, Level) and (self.store.shipped_to(metric) or 0) >= up_to:
                            break
                        claim = self.store.claim(metric, up_to, now, ahead)
                    if claim is None:
                        break
                    report.shipped += self._ship(metric, claim, source)
                    report.claims += 1
                    if isinstance(metric, Bucketed):
                        break
            except Exception as e:  # noqa: BLE001  reported, and the rows are back
                report.error = e
                if self.on_error is not None:
                    self.on_error(metric.name, e)
            if report.claims and report.error is None:
                self._flushed[metric.name] = now
            else:
                self.store.return_turn(metric.name, token)  # an empty flush does not use up the interval
        return report

    def flush(self, only: Iterable[str] | None = None, *, strict: bool = False, final: bool = False, parallel: int = 4) -> HouseReport:
        chosen, unmatched = self._chosen(only, strict)
        with ThreadPoolExecutor(max(1, min(parallel, len(chosen) or 1))) as pool:
            found = list(pool.map(lambda m: self.flush_one(m, final=final), chosen))
        return HouseReport({r.metric: r for r in found}, unmatched)

    # ---- collectors, ticks and the end ----

    def collect(self, name: str, callback: Callable[[Metric], DataFrame | None], lead: str | int | None = None) -> None:
        """Ask for writes once in each window, ``lead`` before it ends."""
        metric = self._metrics[name]
        ms = collect_lead(metric.res) if lead is None else parse_interval(lead, "lead")
        if not 0 < ms < metric.res:
            raise ValueError("lead must be above 0 and shorter than the resolution")
        self._collectors[name] = (callback, ms)

    def run_collectors(self) -> list[str]:
        """Run those that are due; each runs once for a window, in one process of the fleet."""
        ran = []
        for name, (callback, lead) in self._collectors.items():
            metric, now = self._metrics[name], self.now()
            window = bucket_start(now, metric.res)
            if now < window + metric.res - lead or self._collected.get(name) == window:
                continue
            self._collected[name] = window
            if self.store.take_turn(f"{name}~collect~{window}", now, metric.res) is None:
                continue
            found = callback(metric)
            if found is not None:
                self.write(name, found)
            ran.append(name)
        return ran

    def start(self) -> None:
        """Flush every metric on its own interval until :meth:`stop`; ticks of one metric never overlap."""

        def ticks(metric: Metric) -> None:
            every = self.flush_ms(metric) / 1000
            wait = first_tick_delay(metric.name, self.flush_ms(metric)) / 1000
            while not self._stop.wait(wait):
                self.flush_one(metric)
                wait = every

        for m in self.metrics:
            t = threading.Thread(target=ticks, args=(m,), daemon=True)
            t.start()
            self._timers.append(t)

    def drain(self) -> HouseReport:
        """Ship all that can be shipped now, whatever the interval."""
        return HouseReport({m.name: self.flush_one(m, force=True) for m in self.metrics})

    def stop(self) -> HouseReport:
        """End the ticks, let running flushes finish, run due collectors, then flush with no grace."""
        self._stop.set()
        for t in self._timers:
            t.join()
        self.run_collectors()
        return self.flush(final=True)


