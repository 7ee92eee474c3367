"""Sinks: functions of a batch's rows and its context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.base import Sink, WriteContext


def files(path: str, kind: str = "parquet") -> Sink:
    """Append as Parquet, JSON lines or any format Spark writes, in a folder for each metric."""

    def write(rows: DataFrame, ctx: WriteContext) -> None:
        rows.write.mode("append").format(kind).save(f"{path}/{ctx.metric}")

    return write


def jdbc(url: str, table: str, **options: str) -> Sink:
    def write(rows: DataFrame, ctx: WriteContext) -> None:
        rows.write.mode("append").jdbc(url, table, properties=options)

    return write


def latest(rows: DataFrame, keys: Sequence[str] = ("id",), final: str | None = "final", order: str = "seq") -> DataFrame:
    """One row for each id of a table that at-least-once delivery has filled: final rows win, then the newest.

    A map-side combined maximum, so a hot id never gathers in one task.
    """
    rank = F.struct(*([F.col(final).cast("int").alias("_f")] if final else []), F.col(order).alias("_o"))
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
