"""Gauges and timers: last, least, largest, sum and count of observations."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.base import Bucketed

AGGREGATES = ("last", "min", "max", "sum", "count")


@dataclass(frozen=True, eq=False)
class Gauge(Bucketed):
    """``value`` is the observation; ``seq`` orders those of a window for ``last``."""

    value_columns: tuple[str, ...] = AGGREGATES
    aggregates: tuple[str, ...] = field(default=AGGREGATES, kw_only=True)

    kind = "gauge"

    def __post_init__(self) -> None:
        if not self.aggregates or len(set(self.aggregates)) != len(self.aggregates) or set(self.aggregates) - set(AGGREGATES):
            raise ValueError(f"aggregates must be some of {AGGREGATES}, each once")
        super().__post_init__()

    def _value(self, df: DataFrame) -> Mapping[str, Column]:
        v = df["value"].cast("double")
        return {"v": F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{self.name}: value is not finite"))).otherwise(v + F.lit(0.0))}

    def fold(self, ops: DataFrame) -> DataFrame:
        return ops.groupBy("bucket_ms", *self.series).agg(
            F.max_by("v", "seq").alias("last"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum("v").alias("sum"), F.count("*").alias("count")
        )

    def _shown(self) -> Mapping[str, Column]:
        return {a: F.col(a) for a in self.aggregates}

    def row_schema(self) -> T.StructType:
        return T.StructType([f for f in super().row_schema() if f.name not in AGGREGATES or f.name in self.aggregates])

    def _value_type(self, column: str) -> T.DataType:
        return T.LongType() if column == "count" else T.DoubleType()

    def total(self) -> Column:
        return F.sum("sum")

    def merged(self, rows: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
        """``last`` survives only where the newest window holds one series.

        ``more`` sees one row for each window, with its ``_members`` cells and the ``_first`` of their keys.
        """
        by_window = rows.groupBy(*dict.fromkeys([*keys, "bucket_ms"])).agg(
            F.count_distinct("dim_key").alias("_series"),
            F.first("last").alias("last"),
            F.count("*").alias("_members"),
            F.min("dim_key").alias("_first"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.sum("sum").alias("sum"),
            F.sum("count").alias("count"),
        )
        newest = F.max_by(F.when(F.col("_series") == 1, F.col("last")), "bucket_ms")
        return by_window.groupBy(*keys).agg(newest.alias("last"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), *more)

    def current(self, cells: DataFrame, now: int, dims: Mapping) -> DataFrame:
        """The open window's fold of one series; no row if it has none."""
        from tidemark.plans.snapshot import open_cells

        return open_cells(self, cells, now, dims).select(*self._shown())

    def totals(self, cells: DataFrame, now: int) -> DataFrame:
        """The open window over all series; ``last`` has no meaning there.  No row if nothing was observed."""
        from tidemark.plans.snapshot import open_cells

        return open_cells(self, cells, now).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count")).where("count > 0")


@dataclass(frozen=True, eq=False)
class Timer(Gauge):
    """A gauge of durations in milliseconds, rounded to microseconds; from ``value``, or ``start_ts`` and ``end_ts``."""

    aggregates: tuple[str, ...] = field(default=("min", "max", "sum", "count"), kw_only=True)

    kind = "timer"

    def _value(self, df: DataFrame) -> Mapping[str, Column]:
        raw = df["value"].cast("double") if "value" in df.columns else (F.unix_micros(df["end_ts"].cast("timestamp")) - F.unix_micros(df["start_ts"].cast("timestamp"))) / 1000
        bad = raw.isNull() | F.isnan(raw) | (raw < 0) | (raw == float("inf"))
        return {"v": F.when(bad, F.raise_error(F.lit(f"{self.name}: no duration"))).otherwise(F.round(raw * 1000) / 1000)}

    def recorded(self, df: DataFrame, event) -> DataFrame:
        """The same timings as rows of an event: its fields are this timer's dims and ``duration_ms``."""
        need = {**self.dims, "duration_ms": None}
        if set(event.fields) != set(need) or any(event.fields[d].kind != t.kind for d, t in self.dims.items()):
            raise ValueError(f"{event.name}: needs exactly the fields {sorted(need)} to record {self.name}")
        return df.withColumn("duration_ms", self._value(df)["v"])


class Stopwatch:
    """Measures a block of code and hands one row ``(start, milliseconds, dims)`` to ``emit``, with its outcome."""

    def __init__(self, emit, dims: Mapping | None = None, clock=None, outcome: str | None = None):
        import time

        self.emit, self.dims, self.outcome = emit, dict(dims or {}), outcome
        self.clock = clock or time.perf_counter
        self.done = False

    def __enter__(self) -> Stopwatch:
        self.began = self.clock()
        return self

    def end(self, **dims) -> float | None:
        """Ends once; later calls do nothing."""
        if self.done:
            return None
        self.done = True
        took = round((self.clock() - self.began) * 1e6) / 1000
        self.emit({**self.dims, **dims, "value": took})
        return took

    def __exit__(self, kind, *_) -> None:
        self.end(**({self.outcome: "ok" if kind is None else "error"} if self.outcome else {}))
