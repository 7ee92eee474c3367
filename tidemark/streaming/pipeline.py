"""Metrics over Structured Streaming.

Late data is never dropped by a watermark: every micro-batch is appended to the ledger, where late writes move to the
first open window, and flushing is what closes windows.  A batch that runs again after a failure is appended once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.time import bucket_start_col, millis
from tidemark.house import House
from tidemark.operators.base import Bucketed
from tidemark.operators.counter import Counter
from tidemark.operators.gauge import Gauge
from tidemark.operators.level import Level


def ingest(house: House, name: str, stream: DataFrame, checkpoint: str, *, flush: bool = True, trigger: dict[str, Any] | None = None) -> StreamingQuery:
    """Append every micro-batch of writes to ``name``, and flush after it where its interval allows."""
    metric = house.get(name)

    def batch(df: DataFrame, number: int) -> None:
        house.write(name, df, key=f"{checkpoint.strip('/').replace('/', '_')[-80:]}-{number}")
        if flush:
            house.flush_one(metric)

    return stream.writeStream.queryName(f"tidemark-{name}").option("checkpointLocation", checkpoint).foreachBatch(batch).trigger(**(trigger or {"availableNow": True})).start()


def windowed(metric: Bucketed, stream: DataFrame, delay: str | None = None) -> DataFrame:
    """Cells of a counter, gauge or timer by Spark's own windows, for sinks that take updates.

    In update mode each row is the whole fold so far under the same id, so a sink that upserts by id needs no more; in
    append mode a window comes once, when the watermark has passed it, and later writes to it are lost.
    """
    if isinstance(metric, Level):
        raise ValueError("a level needs ordered state: use level_stream")
    ops = stream.withWatermark("ts", delay or "2 seconds")
    dims = [metric.dims[d].filled(F.col(d).cast(metric.dims[d].spark_type)).alias(d) for d in metric.dims]
    value = next(iter(metric._value(ops).items()))
    rows = ops.select("ts", *([ops["seq"]] if "seq" in ops.columns else [F.lit(0).cast("long").alias("seq")]), *dims, value[1].alias(value[0]))
    grouped = rows.groupBy(F.window("ts", f"{metric.res} milliseconds").alias("_w"), *metric.dims)
    if isinstance(metric, Counter):
        cells = grouped.agg(metric._sum("delta").alias("value"))
    elif isinstance(metric, Gauge):
        cells = grouped.agg(F.max_by("v", "seq").alias("last"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.count("*").alias("count"))
    else:
        raise ValueError(f"{metric.kind} has no fold")
    return metric.rows(cells.withColumn("bucket_ms", millis(F.col("_w.start"))).withColumn("dim_key", metric.key()))


class LevelState(StatefulProcessor):
    """One series: its windows written, the newest ``keep`` of the grid back, and what it held before them.

    Writes apply in the order they arrive.  A late ``set`` fills its own window and those after it up to the next
    written one; a late ``add`` moves its window and all after it.  A write older than what is kept lands in the first window
    that is; a ``set`` that moved is dropped if that window has a reading of its own.
    """

    def __init__(self, resolution: int, hold: int | None, keep: int = 10_000):
        self.resolution, self.hold, self.keep = resolution, hold, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "bucket long", "value double, own boolean")
        self.base = handle.getValueState("base", "value double, written long, floor long")

    def apply(self, cells: dict[int, tuple[float, bool]], base: tuple[float | None, int, int], bucket: int, mode: str, value: float) -> list[int]:
        """Apply one write; the windows that it touched."""
        held, written, floor = base
        moved = bucket < floor
        at = -(-floor // self.resolution) * self.resolution if moved else bucket
        if moved and mode == "set" and cells.get(at, (0, False))[1]:
            return []
        last = max((b for b in cells if b < at), default=None)
        before, last = (held, written) if last is None else (cells[last][0], last)
        if before is None or self.hold is not None and last + self.hold < at:
            before = 0.0
        if mode == "set":
            cells[at] = (value, not moved or cells.get(at, (0, False))[1])
            return [at]
        else:
            was = cells.get(at)
            cells[at] = ((was[0] if was else before) + value, (was[1] if was else False) or not moved)
            after = [b for b in cells if b > at]
            for b in after:
                cells[b] = (cells[b][0] + value, cells[b][1])
            return [at, *after]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cells = {k[0]: (v[0], v[1]) for k, v in self.cells.iterator()}
        base = self.base.get() if self.base.exists() else (None, 0, 0)
        changed = set()
        for part in rows:
            for r in part.sort_values("seq", kind="stable").itertuples():
                changed.update(self.apply(cells, (base[0], base[1], base[2]), int(r.bucket_ms), r.mode, float(r.value)))
        for b in changed:
            self.cells.updateValue((b,), cells[b])
        old = sorted(b for b in cells if b < max(cells) - self.keep * self.resolution) if cells else []
        if old:
            self.base.update((cells[old[-1]][0], old[-1], max(cells) - self.keep * self.resolution))
            for b in old:
                if self.cells.containsKey((b,)):
                    self.cells.removeKey((b,))
        if changed:
            at = sorted(changed)
            yield pd.DataFrame({"dim_key": [key[0]] * len(at), "bucket_ms": at, "value": [cells[b][0] for b in at]})

    def close(self) -> None:
        pass


def level_stream(metric: Level, stream: DataFrame) -> DataFrame:
    """``dim_key, bucket_ms, value`` of every window that a micro-batch changed; needs the RocksDB state store and update mode."""
    mode = F.col("mode") if "mode" in stream.columns else F.lit("set")
    ops = stream.select(
        metric.key().alias("dim_key"), bucket_start_col(millis(F.col("ts")), metric.res).alias("bucket_ms"), mode.alias("mode"), F.col("value").cast("double").alias("value"), F.col("seq").cast("long").alias("seq")
    )
    return ops.groupBy("dim_key").transformWithStateInPandas(LevelState(metric.res, metric.hold), "dim_key string, bucket_ms long, value double", "Update", "None")


def upsert_sink(path: str) -> Callable[[DataFrame, Any], None]:
    """A sink that appends rows with what decides between copies of an id: flush rows win, then the later."""

    def write(rows: DataFrame, ctx: Any) -> None:
        rows.withColumns({"_final": F.lit(ctx.source == "flush"), "_attempt": F.lit(ctx.attempt), "_at": F.current_timestamp()}).write.mode("append").parquet(path)

    return write
