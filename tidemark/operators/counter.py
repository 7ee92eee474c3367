"""Counters: the sum of deltas per window and series."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.time import SAFE_INTEGER
from tidemark.operators.base import Bucketed


def exact_sum(value: Column, where: str) -> Column:
    """Sum of whole numbers; fails where it leaves what a double holds exactly.

    High and low bits are summed apart as longs: exact far beyond the limit, and cheaper than sums of decimals.
    """
    value = value.cast("long")
    high, low = F.sum(F.shiftright(value, 20)), F.sum(value.bitwiseAND(F.lit((1 << 20) - 1).cast("long")))
    total = high.cast("decimal(38,0)") * (1 << 20) + low
    return F.when(F.abs(total) > SAFE_INTEGER, F.raise_error(F.lit(f"{where}: total beyond 2**53 - 1"))).otherwise(total.cast("long"))


@dataclass(frozen=True, eq=False)
class Counter(Bucketed):
    """``value`` is the delta, 1 if the column is missing or null; it may be negative."""

    value: str = field(default="int", kw_only=True)  # int or float

    kind = "counter"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.value not in ("int", "float"):
            raise ValueError("a counter's value is int or float")

    def _value(self, df: DataFrame) -> Mapping[str, Column]:
        kind = "long" if self.value == "int" else "double"
        if "value" not in df.columns:
            return {"delta": F.lit(1).cast(kind)}
        raw = F.coalesce(df["value"], F.lit(1))
        bad = (raw != F.floor(raw)) | (F.abs(raw) > SAFE_INTEGER) if self.value == "int" else F.isnan(raw) | (F.abs(raw) == float("inf"))
        return {"delta": F.when(bad, F.raise_error(F.lit(f"{self.name}: delta is no {self.value}"))).otherwise(raw).cast(kind)}

    def _sum(self, c: str) -> Column:
        return exact_sum(F.col(c), self.name) if self.value == "int" else F.sum(c)

    def fold(self, ops: DataFrame) -> DataFrame:
        return ops.groupBy("bucket_ms", *self.series).agg(self._sum("delta").alias("value"))

    def _value_type(self, column: str) -> T.DataType:
        return T.LongType() if self.value == "int" else T.DoubleType()

    def merged(self, rows: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
        return rows.groupBy(*keys).agg(self._sum("value").alias("value"), *more)

    def current(self, cells: DataFrame, now: int, dims: Mapping | None = None) -> DataFrame:
        """The open window's value: of one series, or over all."""
        from tidemark.plans.snapshot import open_cells

        return open_cells(self, cells, now, dims).agg(F.coalesce(self._sum("value"), F.lit(0)).alias("value"))
