"""Events and logs: records that are kept whole, sampled if asked, with counters derived from all of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identity import uuid7
from tidemark.functions.time import millis, timestamp
from tidemark.operators.base import Metric, WriteContext
from tidemark.operators.counter import Counter
from tidemark.schema import Shape, check_shape, checked, misfit, one_of, str_

Rate = float | Callable[[Mapping[str, Column]], Column]
#: Increments of one record: value and dims of each.
Derive = Callable[[Mapping[str, Column]], Sequence[tuple[Column, Mapping[str, Column]]]]


@dataclass(frozen=True, eq=False)
class Event(Metric):
    """Records with ``fields``; the first ``ts`` field, or the column ``at`` of a write, is their time."""

    fields: Shape = field(default_factory=dict)
    sample: Rate | None = field(default=None, kw_only=True, compare=False)
    derive: Mapping[Counter, Derive] = field(default_factory=dict, kw_only=True, compare=False)
    timestamp_field: str | None = field(default=None, kw_only=True)
    durability: str = field(default="relaxed", kw_only=True)
    seed: int = field(default=0, kw_only=True)

    kind = "event"
    storage = "staged"

    def __post_init__(self) -> None:
        super().__post_init__()
        check_shape(self.fields, ("id", "ts", "_ingested_at", "_sample_rate"), dims=False)
        if isinstance(self.sample, (int, float)) and not 0 <= self.sample <= 1:
            raise ValueError("a sample rate is from 0 to 1")
        if self.durability not in ("relaxed", "durable") or self.durability == "durable" and self.sample is not None:
            raise ValueError("durability is relaxed or durable, and a durable event is not sampled")
        if self.timestamp_field is not None and getattr(self.fields.get(self.timestamp_field), "kind", None) != "ts":
            raise ValueError("timestamp_field names a ts field")

    def _columns(self, df: DataFrame) -> dict[str, Column]:
        return checked(self.fields, {f: df[f] for f in self.fields if f in df.columns}, self.name)

    def _time(self, df: DataFrame, columns: Mapping[str, Column], now: Column) -> Column:
        found = [df["at"]] if "at" in df.columns else []
        if self.timestamp_field:
            found.append(columns[self.timestamp_field])
        return timestamp(F.coalesce(*[millis(c) for c in found], now))

    def prepared(self, df: DataFrame, now: int | Column) -> DataFrame:
        """Checked records with ``ts`` and ``_rate``, none sampled away yet."""
        now = F.lit(now) if isinstance(now, int) else now
        columns = self._columns(df)
        order = [F.col("seq")] if "seq" in df.columns else []
        out = df.select(self._time(df, columns, now).alias("ts"), *[c.alias(f) for f, c in columns.items()], timestamp(now).alias("_ingested_at"), *order)
        if self.sample is None:
            return out.withColumn("_rate", F.lit(1.0))
        rate = F.lit(float(self.sample)) if isinstance(self.sample, (int, float)) else self.sample({f: F.col(f) for f in self.fields}).cast("double")
        # a column of its own first: a costly rule is then not run for each use
        out, rate = out.withColumn("_asked", rate), F.col("_asked")
        return out.withColumn("_rate", F.when((rate < 0) | (rate > 1) | rate.isNull() | F.isnan(rate), F.raise_error(F.lit(f"{self.name}: no sample rate"))).otherwise(rate)).drop("_asked")

    def staged(self, df: DataFrame, now: int | Column, ids: Column | None = None, draw: Column | None = None) -> DataFrame:
        """Rows that survive sampling: ``id, ts, <fields>, _ingested_at[, _sample_rate][, seq]``."""
        out = self.prepared(df, now)
        if self.sample is not None:
            out = out.where((F.col("_rate") >= 1) | ((draw if draw is not None else F.rand(self.seed)) < F.col("_rate")))
        order = ["seq"] if "seq" in out.columns else []
        rate = [F.col("_rate").alias("_sample_rate")] if self.sample is not None else []
        return out.select((ids if ids is not None else uuid7(millis(F.col("ts")))).alias("id"), "ts", *self.fields, "_ingested_at", *rate, *order)

    def derived(self, df: DataFrame, now: int | Column) -> dict[Counter, DataFrame]:
        """Writes of each derived counter, from every record, sampled or not; a null increment is left out."""
        out = {}
        for counter, rule in self.derive.items():
            rows = self.prepared(df, now)
            steps = rule({f: F.col(f) for f in (*self.fields, "ts")})
            kind = "long" if counter.value == "int" else "double"
            spread = [F.struct(v.cast(kind).alias("value"), *[(dims[d] if d in dims else F.lit(None)).cast(t.spark_type).alias(d) for d, t in counter.dims.items()]) for v, dims in steps]
            rows = rows.select("ts", F.explode(F.array(*spread)).alias("_x")).where("_x.value is not null")
            out[counter] = rows.select("ts", "_x.*")
        return out

    def rejected(self, df: DataFrame) -> Column:
        """Whether a write breaks the declaration, for a dead-letter split before staging."""
        return misfit(self.fields, {f: df[f] for f in self.fields if f in df.columns})

    def reread(self, stored: DataFrame) -> DataFrame:
        """Stored rows under the present declaration.

        Missing defaults are filled, absent optionals stay absent, values that no longer fit ship as they are and are
        named in ``_misfits``; a rate that is missing is 1.
        """
        columns, bad = [], []
        for f, t in self.fields.items():
            raw = stored[f] if f in stored.columns else F.lit(None)
            typed = raw.try_cast(t.spark_type)
            wrong = (raw.isNotNull() & typed.isNull()) | t.invalid(typed)
            columns.append(F.coalesce(t.filled(typed).cast("string"), raw.cast("string")).alias(f) if f in stored.columns and stored.schema[f].dataType != t.spark_type else t.filled(typed).alias(f))
            bad.append(F.when(wrong, F.lit(f)))
        rate = [F.coalesce(stored["_sample_rate"] if "_sample_rate" in stored.columns else F.lit(None).cast("double"), F.lit(1.0)).alias("_sample_rate")] if self.sample is not None else []
        return stored.select("id", "ts", *columns, "_ingested_at", *rate, F.array_compact(F.array(*bad)).alias("_misfits"))

    def snapshot(self, staged: DataFrame, *, start: int | None = None, end: int | None = None, order_by: str | None = None, direction: str = "desc", limit: int | None = None) -> DataFrame:
        """Pending rows in append order, or as asked; records have no window, so never an open one."""
        if direction not in ("asc", "desc") or limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 0):
            raise ValueError("direction is 'asc' or 'desc', limit a whole number from 0")
        if order_by is not None and order_by not in staged.columns:
            raise ValueError(f"{self.name}: no row has {order_by!r}")
        rows = staged
        if start is not None:
            rows = rows.where(millis(F.col("ts")) >= start)
        if end is not None:
            rows = rows.where(millis(F.col("ts")) < end)
        tie = [F.col("seq")]
        if order_by is not None:
            from tidemark.plans.snapshot import LOCALE

            at = F.collate(order_by, LOCALE) if dict(rows.dtypes)[order_by] == "string" else F.col(order_by)
            tie.insert(0, at.desc_nulls_last() if direction == "desc" else at.asc_nulls_last())
        rows = rows.orderBy(*tie)
        rows = rows if limit is None else rows.limit(limit)
        return rows.drop("seq").withColumns({"bucket_open": F.lit(False), "bucket_elapsed_ms": F.lit(0).cast("long")})

    def peek(self, staged: DataFrame, n: int = 10) -> DataFrame:
        """The oldest pending rows; they stay pending."""
        return staged.orderBy("seq").limit(n).drop("seq")

    def row_schema(self) -> T.StructType:
        fields = [T.StructField("id", T.StringType(), False), T.StructField("ts", T.TimestampNTZType(), False)]
        fields += [T.StructField(f, t.spark_type, not t.on_row) for f, t in self.fields.items()]
        fields.append(T.StructField("_ingested_at", T.TimestampNTZType(), False))
        if self.sample is not None:
            fields.append(T.StructField("_sample_rate", T.DoubleType(), False))
        return T.StructType(fields)

    def bounds(self, rows: DataFrame) -> dict:
        row = rows.agg(F.min(millis(F.col("ts"))).alias("a"), F.max(millis(F.col("ts"))).alias("b"), F.count("*").alias("n")).first()
        return {"bucket_from": row["a"], "bucket_to": None if row["b"] is None else row["b"] + 1, "total": row["n"], "rows": row["n"]}

    def context(self, rows: DataFrame, attempt: int = 1, source: str = "flush") -> WriteContext:
        b = self.bounds(rows)
        return WriteContext(self.name, self.kind, b["bucket_from"], b["bucket_to"], b["total"], attempt, source)


LEVELS = ("debug", "info", "warn", "error")


@dataclass(frozen=True, eq=False)
class Log(Event):
    """An event with a level, a message and, from errors, a stack."""

    levels: tuple[str, ...] = field(default=LEVELS, kw_only=True)
    min_level: str | None = field(default=None, kw_only=True)
    bound: Mapping[str, object] = field(default_factory=dict, kw_only=True, compare=False)

    kind = "log"

    def __post_init__(self) -> None:
        if self.min_level is not None and self.min_level not in self.levels:
            raise ValueError(f"min_level is one of {self.levels}")
        if taken := {f.lower() for f in self.fields} & {"level", "message", "error_stack"}:
            raise ValueError(f"reserved: {sorted(taken)}")
        own = {"level": one_of(self.levels), "message": str_(), "error_stack": str_().optional(), **self.fields}
        object.__setattr__(self, "fields", own)
        super().__post_init__()

    def child(self, **bound) -> Log:
        """The same log with fields bound; a write's own field wins, a null one does not."""
        user = {f: t for f, t in self.fields.items() if f not in ("level", "message", "error_stack")}
        if unknown := set(bound) - set(user):
            raise ValueError(f"{self.name}: unknown {sorted(unknown)}")
        return Log(self.name, user, write=self.write, flush=self.flush, sample=self.sample, derive=self.derive, levels=self.levels, min_level=self.min_level, bound={**self.bound, **bound}, seed=self.seed)

    def prepared(self, df: DataFrame, now: int | Column) -> DataFrame:
        for f, v in self.bound.items():
            value = F.lit(v).cast(self.fields[f].spark_type)
            df = df.withColumn(f, F.coalesce(df[f], value) if f in df.columns else value)
        if "error" in df.columns:  # a struct of name, message and stack
            e = F.col("error")
            df = df.withColumn("message", F.coalesce(df["message"], e["message"]) if "message" in df.columns else e["message"])
            df = df.withColumn("error_stack", F.when(e.isNotNull(), F.coalesce(e["stack"], F.concat(e["name"], F.lit(": "), e["message"]))))
        if self.min_level is not None:
            place = F.array_position(F.array(*[F.lit(x) for x in self.levels]), F.col("level"))
            df = df.where(place >= self.levels.index(self.min_level) + 1)
        return super().prepared(df, now)
