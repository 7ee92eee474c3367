"""Live reads: range, dims filter, collapse, liveness, order and limit over cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import row_id
from tidemark.functions.time import bucket_start, timestamp
from tidemark.operators.base import Bucketed
from tidemark.operators.gauge import Gauge
from tidemark.operators.level import Level


#: How texts are ordered where a caller orders by them.
LOCALE = "UNICODE"


def matching(metric: Bucketed, rows: DataFrame, dims: Mapping[str, Any] | None) -> DataFrame:
    """Rows whose dims equal those given; None asks for absence."""
    if unknown := set(dims or {}) - set(metric.dims):
        raise ValueError(f"{metric.name}: unknown dims {sorted(unknown)}")
    for d, v in (dims or {}).items():
        if v is not None and (why := metric.dims[d].problem(v)) is not None:
            raise ValueError(f"{metric.name}: {d}: {why}")
        rows = rows.where(F.col(d).eqNullSafe(F.lit(v).cast(metric.dims[d].spark_type)))
    return rows


def open_cells(metric: Bucketed, cells: DataFrame, now: int, dims: Mapping | None = None, floor: int = 0) -> DataFrame:
    """Cells of the window that a write at ``now`` would land in."""
    from tidemark.functions.time import landing

    at = landing(bucket_start(now, metric.res), floor, metric.res)
    return matching(metric, cells.where(F.col("bucket_ms") == at), dims)


def resolve_range(metric: Bucketed, now: int, start: int | None, end: int | None, complete: bool) -> tuple[int | None, int | None]:
    for name, bound in (("start", start), ("end", end)):
        if bound is not None and (isinstance(bound, bool) or not isinstance(bound, int) or bound < 0):
            raise ValueError(f"{metric.name}: {name} must be epoch milliseconds")
    if start is not None and end is not None and start > end:
        raise ValueError(f"{metric.name}: start is after end")
    if complete:
        opened = bucket_start(now, metric.res)
        end = opened if end is None else min(end, opened)
    return start, end


def _liveness(metric: Bucketed, now: int) -> tuple[Column, Column]:
    age = F.lit(now) - F.col("bucket_ms")
    return age < metric.res, F.least(F.greatest(age, F.lit(0)), F.lit(metric.res))


def snapshot(
    metric: Bucketed,
    cells: DataFrame,
    now: int,
    *,
    dims: Mapping[str, Any] | None = None,
    start: int | None = None,
    end: int | None = None,
    complete: bool = False,
    rollup: str = "none",
    group_by: Sequence[str] | None = None,
    order_by: str | None = None,
    direction: str = "desc",
    limit: int | None = None,
    collation: str | None = LOCALE,
) -> DataFrame:
    """Rows as the sink would get them, with ``bucket_open`` and ``bucket_elapsed_ms``.

    ``rollup='sum'`` merges windows, ``group_by`` keeps only some dims; both at once merge both.  Without ``order_by``
    rows come by window, then series; texts sort as people expect them, or by another ``collation`` (None: by bytes).  An id stays where a row is one series in one window.
    """
    if rollup not in ("none", "sum"):
        raise ValueError("rollup is 'none' or 'sum'")
    if direction not in ("asc", "desc"):
        raise ValueError("direction is 'asc' or 'desc'")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise ValueError("limit must be a whole number from 0")
    if group_by is not None and (set(group_by) - set(metric.dims) or len(set(group_by)) != len(group_by)):
        raise ValueError(f"{metric.name}: group_by takes its dims, each once")
    start, end = resolve_range(metric, now, start, end, complete)
    if isinstance(metric, Level):
        opened = bucket_start(now, metric.res)
        cells = metric.carried(cells, opened if complete else opened + metric.res)
    rows = cells
    if start is not None:
        rows = rows.where(F.col("bucket_ms") >= start)
    if end is not None:
        rows = rows.where(F.col("bucket_ms") < end)
    rows = matching(metric, rows, dims)
    is_open, elapsed = _liveness(metric, now)
    shown = list(metric._shown())
    by_window = rollup == "none"
    if by_window and group_by is None:
        out = rows.select(
            row_id(metric.name, F.col("bucket_ms"), F.col("dim_key")).alias("id"),
            timestamp(F.col("bucket_ms")).alias("bucket_ts"),
            *metric.dims,
            *shown,
            is_open.alias("bucket_open"),
            elapsed.alias("bucket_elapsed_ms"),
            F.col("dim_key").alias("_key"),
        )
        first = ["bucket_ts", "_key"]
    else:
        kept = list(metric.dims) if group_by is None else list(group_by)
        keys = [*(["bucket_ms"] if by_window else []), *kept]
        if not keys:  # one row for all; none if there is nothing
            rows = rows.withColumn("_all", F.lit(1))
            keys = ["_all"]
        out = _merged(metric, rows, keys, is_open, elapsed)
        whole = by_window and set(kept) == set(metric.dims)
        columns: list[Column | str] = []
        if whole:
            columns.append(F.when(F.col("_members") == 1, row_id(metric.name, F.col("bucket_ms"), F.col("_first"))).alias("id"))
        if by_window:
            columns.append(timestamp(F.col("bucket_ms")).alias("bucket_ts"))
        out = out.select(*columns, *kept, *shown, "bucket_open", "bucket_elapsed_ms", F.col("_first").alias("_key"))
        first = [*(["bucket_ts"] if by_window else []), "_key"]
    tie = [F.col(c).asc_nulls_last() for c in first]
    if order_by is not None:
        if order_by not in out.columns or order_by == "_key":
            raise ValueError(f"{metric.name}: no row has {order_by!r}")
        at = F.col(order_by)
        if collation is not None and dict(out.dtypes)[order_by] == "string":
            at = F.collate(at, collation)
        tie.insert(0, at.desc_nulls_last() if direction == "desc" else at.asc_nulls_last())
    out = out.orderBy(*tie)
    return (out if limit is None else out.limit(limit)).drop("_key")


def _merged(metric: Bucketed, rows: DataFrame, keys: list[str], is_open: Column, elapsed: Column) -> DataFrame:
    """Merged values with liveness: open if any window is, elapsed summed over distinct windows."""
    live = [F.bool_or(is_open).alias("bucket_open"), F.sum(elapsed).alias("bucket_elapsed_ms"), F.sum("_members").alias("_members"), F.min("_first").alias("_first")]
    if isinstance(metric, Gauge):
        return metric.merged(rows, keys, live).select(*keys, *metric._shown(), "bucket_open", "bucket_elapsed_ms", "_members", "_first")
    if not isinstance(metric, Level):
        # every window that is over has elapsed whole, and at most one is not: distinct windows need no grouping of their own
        over = F.count_distinct(F.when(elapsed == metric.res, F.col("bucket_ms"))) * metric.res
        part = F.coalesce(F.max(F.when(elapsed < metric.res, elapsed)), F.lit(0))
        return metric.merged(rows, keys, [live[0], (over + part).alias("bucket_elapsed_ms"), F.count("*").alias("_members"), F.min("dim_key").alias("_first")])
    windows = rows.groupBy(*dict.fromkeys([*keys, "bucket_ms"])).agg(F.count("*").alias("_members"), F.min("dim_key").alias("_first"))
    right = windows.groupBy(*keys).agg(*live).select(*[F.col(k).alias(f"_r_{k}") for k in keys], "bucket_open", "bucket_elapsed_ms", "_members", "_first")
    values = metric.merged(rows, keys, [])
    same = None
    for k in keys:
        c = values[k].eqNullSafe(right[f"_r_{k}"])
        same = c if same is None else same & c
    return values.join(right, same).drop(*[f"_r_{k}" for k in keys])
