"""Levels: a value that is held until it is set or moved again.

Ops of a window first become one step of their series, by map-side combined aggregates: the last ``set``, if any, and
the sum of what was added after it.  Only these steps, one for each window written, are ordered within a series.  Gaps
are filled by a window looking at the next step, so no spine is joined and nothing is kept beyond the result.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.functions.time import SAFE_INTEGER, parse_interval
from tidemark.operators.base import Bucketed

#: Windows that may be filled, counted back from the newest.
CARRY_CAP = 10_000


@dataclass(frozen=True, eq=False)
class Level(Bucketed):
    """``value`` sets the level where ``mode`` is ``set`` (the default) and moves it where it is ``add``; ``seq`` orders writes."""

    value: str = field(default="float", kw_only=True)  # float or int
    hold_for: str | int | None = field(default=None, kw_only=True)
    carry_cap: int = field(default=CARRY_CAP, kw_only=True)

    kind = "level"

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.value not in ("int", "float"):
            raise ValueError("a level's value is int or float")
        if self.hold_for is not None and parse_interval(self.hold_for, "hold_for") < self.res:
            raise ValueError("hold_for must be at least the resolution")

    @property
    def hold(self) -> int | None:
        return None if self.hold_for is None else parse_interval(self.hold_for)

    def _value(self, df: DataFrame) -> Mapping[str, Column]:
        v = df["value"].cast("double")
        bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
        if self.value == "int":
            bad = bad | (v != F.floor(v)) | (F.abs(v) > SAFE_INTEGER)
        mode = df["mode"] if "mode" in df.columns else F.lit("set")
        mode = F.when(mode.isin("set", "add"), mode).otherwise(F.raise_error(F.lit(f"{self.name}: mode is set or add")))
        return {"v": F.when(bad, F.raise_error(F.lit(f"{self.name}: value is no {self.value}"))).otherwise(v), "mode": mode}

    def fold(self, ops: DataFrame) -> DataFrame:
        """One cell for each window written; windows between are not filled."""
        place, at = ["bucket_ms", *self.series], ["bucket_ms", "dim_key"]
        # with one mode for all writes the other branch is empty, and Catalyst drops it with the join
        sets = ops.where("mode = 'set'")
        if "moved" in ops.columns:  # a late set that was moved forward gives way to what its window had of its own time
            first = ops.where("not coalesce(moved, false)").groupBy(*at).agg(F.min("seq").alias("_own"))
            sets = sets.join(first, at, "left").where("not coalesce(moved and _own < seq, false)")
        sets = sets.groupBy(*place).agg(F.max(F.struct("seq", "v")).alias("_last"))
        known = sets.select(*at, F.col("_last.seq").alias("_seq"))
        adds = ops.where("mode = 'add'").join(known, at, "left").where("_seq is null or seq > _seq").groupBy(*place).agg(F.sum("v").alias("_moved"))
        adds = adds.select(*[F.col(c).alias(f"_a_{c}") for c in place], "_moved")
        steps = sets.join(adds, (sets["bucket_ms"] == adds["_a_bucket_ms"]) & (sets["dim_key"] == adds["_a_dim_key"]), "full")
        there = F.col("_a_bucket_ms").isNotNull()
        steps = steps.select(*[F.when(there, F.col(f"_a_{c}")).otherwise(F.col(c)).alias(c) for c in place], F.col("_last.v").alias("_set"), F.coalesce("_moved", F.lit(0.0)).alias("_moved"))
        own = W.partitionBy("dim_key").orderBy("bucket_ms")
        before = F.lag("bucket_ms").over(own)
        fresh = F.col("_set").isNotNull() | before.isNull()
        if self.hold is not None:
            fresh = fresh | (before + self.hold < F.col("bucket_ms"))
        steps = steps.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(own))
        value = F.sum(F.coalesce("_set", F.lit(0.0)) + F.col("_moved")).over(W.partitionBy("dim_key", "_run").orderBy("bucket_ms"))
        return steps.withColumn("value", value.cast(self._value_type("value"))).select(*place, "value")

    def within(self, df: DataFrame, start: int | None, end: int | None) -> DataFrame:
        """What a level holds comes from earlier windows too."""
        return super().within(df, None, end)

    def carried(self, cells: DataFrame, up_to: int) -> DataFrame:
        """Cells of all windows below ``up_to`` that the level holds in, written or not."""
        own = W.partitionBy("dim_key").orderBy("bucket_ms")
        step, res = F.col("bucket_ms"), self.res
        end = F.least(F.coalesce(F.lead("bucket_ms").over(own), F.lit(up_to)), F.lit(up_to))
        if self.hold is not None:
            end = F.least(end, step + self.hold + 1)
        first = F.greatest(step + res, F.lit(up_to - self.carry_cap * res))
        first = first + F.pmod(-first, F.lit(res))
        gap = F.when(first < end, F.sequence(first, end - 1, F.lit(res).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        spread = cells.where(step < up_to).withColumn("_windows", F.concat(F.array("bucket_ms"), gap))
        return spread.withColumn("_at", F.explode("_windows")).withColumn("carried", F.col("_at") != step).withColumn("bucket_ms", F.col("_at")).drop("_at", "_windows")

    def held(self, cells: DataFrame, now: int) -> DataFrame:
        """What each series holds at ``now``: ``dim_key, <dims>, value, written_ms``."""
        last = cells.groupBy(*self.series).agg(F.max_by("value", "bucket_ms").alias("value"), F.max("bucket_ms").alias("written_ms"))
        return last if self.hold is None else last.where(F.col("written_ms") + self.hold >= now - now % self.res)

    def current(self, cells: DataFrame, now: int, dims: Mapping) -> DataFrame:
        from tidemark.plans.snapshot import matching

        return matching(self, self.held(cells, now), dims).select("value")

    def totals(self, cells: DataFrame, now: int) -> DataFrame:
        return self.held(cells, now).agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value"))

    def _value_type(self, column: str) -> T.DataType:
        return T.LongType() if self.value == "int" else T.DoubleType()

    def bounds(self, cells: DataFrame) -> dict:
        """The total is that of each series' newest window."""
        found = super().bounds(cells)
        newest = cells.groupBy("dim_key").agg(F.max_by("value", "bucket_ms").alias("v"))
        return found | {"total": newest.agg(F.sum("v")).first()[0]}

    def merged(self, rows: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
        """The newest value of each series, then the sum over series."""
        each = rows.groupBy(*dict.fromkeys([*keys, "dim_key"])).agg(F.max_by("value", "bucket_ms").alias("value"))
        return each.groupBy(*keys).agg(F.sum("value").alias("value"), *more)
