"""What all metrics share: name, fields, clock settings and the sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identity import dim_key, dim_parts, row_id
from tidemark.functions.time import bucket_start_col, check_divides, millis, parse_duration, parse_interval, timestamp
from tidemark.schema import Shape, check_name, check_shape, checked

DEFAULT_GRACE, DEFAULT_FLUSH, EVENT_FLUSH = 2000, 60_000, 30_000


@dataclass(frozen=True)
class WriteContext:
    """What a sink learns about a batch."""

    metric: str
    kind: str
    bucket_from: int | None
    bucket_to: int | None
    total: float | int | None
    attempt: int = 1
    source: str = "flush"  # flush, batch or immediate


Sink = Callable[[DataFrame, WriteContext], None]


@dataclass(frozen=True, eq=False)
class Metric:
    """An inert declaration that builds DataFrames."""

    name: str
    write: Sink | None = field(default=None, kw_only=True)
    flush: str | int | None = field(default=None, kw_only=True)

    kind = "metric"
    storage = "bucketed"

    def __post_init__(self) -> None:
        check_name(self.name)
        if self.flush is not None:
            parse_interval(self.flush, "flush")


@dataclass(frozen=True, eq=False)
class Bucketed(Metric):
    """A metric folded per window and series.

    Writes come as a DataFrame with ``ts`` (timestamp), the dimensions, a value and, where order counts, ``seq``.
    ``ops`` checks and normalises them to the ledger's rows; ``fold`` turns ops into cells, one for each window and
    series; ``rows`` shapes cells for the sink.
    """

    dims: Shape = field(default_factory=dict)
    resolution: str | int = field(default="10s", kw_only=True)
    grace: str | int | None = field(default=None, kw_only=True)

    value_columns: tuple[str, ...] = ("value",)

    def __post_init__(self) -> None:
        super().__post_init__()
        parse_interval(self.resolution, "resolution")
        check_shape(self.dims, ("id", "bucket_ts", *self.value_columns))
        if self.flush is not None:
            check_divides(self.res, parse_interval(self.flush))
        if self.grace is not None:
            parse_duration(self.grace, "grace")

    @property
    def res(self) -> int:
        return parse_interval(self.resolution)

    # ---- writes ----

    def _value(self, df: DataFrame) -> Mapping[str, Column]:
        raise NotImplementedError

    def ops(self, df: DataFrame) -> DataFrame:
        """``bucket_ms, dim_key, <dims>, <op columns>, seq`` from writes; a bad write fails the job."""
        dims = checked(self.dims, {d: df[d] for d in self.dims if d in df.columns}, self.name)
        seq = df["seq"].cast("long") if "seq" in df.columns else F.lit(0).cast("long")
        out = df.select(millis(df["ts"]).alias("_ms"), seq.alias("seq"), *[c.alias(d) for d, c in dims.items()], *[c.alias(n) for n, c in self._value(df).items()])
        return out.select(bucket_start_col(F.col("_ms"), self.res).alias("bucket_ms"), self.key().alias("dim_key"), *self.dims, *self._value(df), "seq")

    def key(self) -> Column:
        return dim_key([t.text(F.col(d)) for d, t in self.dims.items()])

    # ---- cells ----

    @property
    def series(self) -> list[str]:
        """Grouping columns of a series: dims alone are its identity, its key follows from them."""
        return ["dim_key", *self.dims]

    def fold(self, ops: DataFrame) -> DataFrame:
        raise NotImplementedError

    def cells(self, df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
        """Cells of the windows that begin in ``[start, end)``: only writes of their time are read, if the source can tell."""
        return self.fold(self.ops(self.within(df, start, end)))

    def within(self, df: DataFrame, start: int | None, end: int | None) -> DataFrame:
        """Writes of the windows that begin in ``[start, end)``, by a plain comparison of ``ts`` that a scan can use."""
        kind = df.schema["ts"].dataType
        for bound, sign in ((start, 1), (end, -1)):
            if bound is not None:
                at = F.timestamp_millis(F.lit(bound + -bound % self.res)).cast(kind)
                df = df.where(df["ts"] >= at if sign > 0 else df["ts"] < at)
        return df

    def _shown(self) -> Mapping[str, Column]:
        """Value columns of a sink row."""
        return {c: F.col(c) for c in self.value_columns}

    def rows(self, cells: DataFrame) -> DataFrame:
        """``id, bucket_ts, <dims>, <values>``."""
        return cells.select(
            row_id(self.name, F.col("bucket_ms"), F.col("dim_key")).alias("id"), timestamp(F.col("bucket_ms")).alias("bucket_ts"), *self.dims, *[c.alias(n) for n, c in self._shown().items()]
        )

    def decoded(self, cells: DataFrame) -> DataFrame:
        """Dims read back from stored keys under the present declaration.

        Dims a key lacks are absent; a value that cannot be read stays absent, its text is in ``_raw_<dim>``.
        """
        parts = dim_parts(F.col("dim_key"))
        out = cells.drop(*self.dims).withColumn("_parts", parts)
        for i, (d, t) in enumerate(self.dims.items()):
            raw = F.get("_parts", F.lit(i))
            out = out.withColumn(d, t.filled(t.read(raw))).withColumn(f"_raw_{d}", F.when(raw.isNotNull() & t.read(raw).isNull(), raw))
        return out.drop("_parts")

    # ---- what sinks learn ----

    def row_schema(self) -> T.StructType:
        fields = [T.StructField("id", T.StringType(), False), T.StructField("bucket_ts", T.TimestampNTZType(), False)]
        fields += [T.StructField(d, t.spark_type, not t.on_row) for d, t in self.dims.items()]
        return T.StructType(fields + [T.StructField(c, self._value_type(c), False) for c in self.value_columns])

    def _value_type(self, column: str) -> T.DataType:
        return T.DoubleType()

    def total(self) -> Column:
        """Batch total over cells."""
        return F.sum(self.value_columns[0])

    def bounds(self, cells: DataFrame) -> dict[str, Any]:
        row = cells.agg(F.min("bucket_ms").alias("a"), F.max("bucket_ms").alias("b"), self.total().alias("t"), F.count("*").alias("n")).first()
        return {"bucket_from": row["a"], "bucket_to": None if row["b"] is None else row["b"] + self.res, "total": row["t"], "rows": row["n"]}

    # ---- merging, for snapshots ----

    def merged(self, rows: DataFrame, keys: list[str], more: list[Column]) -> DataFrame:
        """Rows of several series or windows as one for each group; ``rows`` holds cells."""
        raise NotImplementedError


