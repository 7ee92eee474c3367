"""Field types of dimensions and events, their checks and their columns."""

from __future__ import annotations

import datetime as dt
import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identity import number_text
from tidemark.functions.time import SAFE_INTEGER, millis, timestamp

_NONE = object()
_SPARK = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "ts": T.TimestampNTZType(), "json": T.StringType()}


@dataclass(frozen=True)
class FieldType:
    kind: str
    members: tuple = ()
    is_optional: bool = False
    default: Any = _NONE

    def optional(self) -> FieldType:
        return replace(self, is_optional=True)

    def with_default(self, value: Any) -> FieldType:
        """Optional on input, always there on the row."""
        if (why := self.problem(value)) is not None:
            raise ValueError(f"default: {why}")
        return replace(self, is_optional=True, default=value)

    @property
    def has_default(self) -> bool:
        return self.default is not _NONE

    @property
    def on_row(self) -> bool:
        """Whether every row has it."""
        return not self.is_optional or self.has_default

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "one_of":
            return T.StringType() if all(isinstance(m, str) for m in self.members) else T.DoubleType()
        return _SPARK[self.kind]

    def problem(self, value: Any) -> str | None:
        """Why a value is refused, or None."""
        kind, number = self.kind, isinstance(value, (int, float)) and not isinstance(value, bool)
        ok = {
            "str": isinstance(value, str),
            "int": number and math.isfinite(value) and value == int(value) and abs(value) <= SAFE_INTEGER,
            "float": number and math.isfinite(value),
            "bool": isinstance(value, bool),
            "ts": isinstance(value, dt.datetime),
            "one_of": any(value == m and isinstance(value, str) == isinstance(m, str) for m in self.members),
        }.get(kind)
        if kind == "json":
            try:
                json.dumps(value, allow_nan=False)
                ok = True
            except (TypeError, ValueError):
                ok = False
        return None if ok else f"{value!r} is no {kind}"

    def invalid(self, c: Column) -> Column:
        """True where a value that is there breaks the type; ``c`` has the type's own Spark type."""
        bad = {
            "int": lambda: F.abs(c) > SAFE_INTEGER,
            "float": lambda: F.isnan(c) | (F.abs(c) == float("inf")),
            "one_of": lambda: ~c.isin(*self.members),
            "json": lambda: c.isNotNull() & F.try_parse_json(c).isNull(),
        }.get(self.kind)
        return F.coalesce(bad(), F.lit(False)) if bad else F.lit(False)

    def cast(self, c: Column) -> Column:
        return c.cast(self.spark_type)

    def filled(self, c: Column) -> Column:
        return F.coalesce(c, F.lit(self.default).cast(self.spark_type)) if self.has_default else c

    def text(self, c: Column) -> Column:
        """The text that stands for a value in a series key."""
        if self.kind == "ts":
            return millis(c).cast("string")
        return number_text(c) if isinstance(self.spark_type, T.DoubleType) else c.cast("string")

    def read(self, c: Column) -> Column:
        """The value behind a key's text; null if it cannot be read."""
        if self.kind == "ts":
            return timestamp(c.try_cast("long"))
        found = c.try_cast(self.spark_type)
        return F.when(~self.invalid(found), found)


Shape = Mapping[str, FieldType]


def str_() -> FieldType:
    return FieldType("str")


def int_() -> FieldType:
    return FieldType("int")


def float_() -> FieldType:
    return FieldType("float")


def bool_() -> FieldType:
    return FieldType("bool")


def ts() -> FieldType:
    return FieldType("ts")


def json_() -> FieldType:
    return FieldType("json")


def one_of(members: Iterable) -> FieldType:
    members = tuple(members)
    if not members or len({str(m) for m in members}) != len(members):
        raise ValueError("one_of needs members that print differently")
    if any(not isinstance(m, str) and not (isinstance(m, (int, float)) and math.isfinite(m)) for m in members):
        raise ValueError("one_of takes texts and finite numbers")
    return FieldType("one_of", members)


#: Columns that live rows add.
LIVE = ("bucket_open", "bucket_elapsed_ms")


def check_shape(shape: Shape, reserved: Iterable[str] = (), dims: bool = True) -> None:
    seen = {r.lower() for r in (*reserved, *LIVE)}
    for name, kind in shape.items():
        if not name or name.lower() in seen:
            raise ValueError(f"field {name!r} is empty, reserved or declared twice (names differ by more than case)")
        if dims and kind.kind == "json":
            raise ValueError(f"dimension {name!r}: json cannot name a series")
        seen.add(name.lower())


def check_name(name: str) -> None:
    if not name or any(c.isspace() or c == ":" or 0xD800 <= ord(c) <= 0xDFFF for c in name):
        raise ValueError(f"metric name {name!r}: must be non-empty, without colon, white space or lone surrogates")


def checked(shape: Shape, columns: Mapping[str, Column], where: str) -> dict[str, Column]:
    """Typed columns with defaults filled; a missing or wrong value fails the job when it is read."""
    if unknown := set(columns) - set(shape):
        raise ValueError(f"{where}: unknown {sorted(unknown)}")
    out = {}
    for name, kind in shape.items():
        c = kind.filled(kind.cast(columns[name])) if name in columns else kind.filled(F.lit(None).cast(kind.spark_type))
        if name not in columns and not kind.is_optional:
            raise ValueError(f"{where}: {name!r} is missing")
        found = F
        if not kind.is_optional:
            found = found.when(c.isNull(), F.raise_error(F.lit(f"{where}: {name} is missing")))
        if kind.kind in ("int", "float", "one_of", "json"):
            found = found.when(kind.invalid(c), F.raise_error(F.lit(f"{where}: {name} is no {kind.kind}")))
        out[name] = c if found is F else found.otherwise(c)
    return out


def misfit(shape: Shape, columns: Mapping[str, Column]) -> Column:
    """True for rows that :func:`checked` would refuse, for a dead-letter split."""
    found = F.lit(False)
    for name, kind in shape.items():
        raw = columns.get(name, F.lit(None))
        typed = raw.try_cast(kind.spark_type)
        found = found | (raw.isNotNull() & typed.isNull()) | kind.invalid(typed)
        if not kind.is_optional:
            found = found | raw.isNull()
    return found
