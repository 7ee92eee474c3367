"""Series keys and row ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for an absent dimension.
ABSENT = "\\0"


def number_text(c: Column) -> Column:
    """A double as its shortest decimal text: plain from 1e-6 up to 1e21, else with an exponent; -0 is 0."""
    text = F.abs(c).cast("string")
    whole = F.regexp_replace(text, r"\.0$", "")
    lead, rest = F.regexp_extract(text, r"^(\d)\.(\d+)E", 1), F.regexp_extract(text, r"^(\d)\.(\d+)E", 2)
    rest = F.when(rest == "0", "").otherwise(rest)
    power = F.regexp_extract(text, r"E(-?\d+)$", 1)
    e = F.when(power == "", 0).otherwise(power).cast("int")
    digits = F.concat(lead, rest)
    large = F.when(F.length(digits) <= e + 1, F.rpad(digits, e + 1, "0")).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(30))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    science = F.concat(lead, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"), F.when(e > 0, "+").otherwise(""), e.cast("string"))
    found = F.when(~F.contains(text, F.lit("E")), whole).when((e >= 0) & (e < 21), large).when((e < 0) & (e > -7), small).otherwise(science)
    return F.concat(F.when(c < 0, "-").otherwise(""), found)


def dim_key(parts: Sequence[Column]) -> Column:
    """The key of a series: its dimensions' texts in order of declaration; ``|`` and ``\\`` are escaped."""
    if not parts:
        return F.lit("")
    escaped = [F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for p in parts]
    return F.concat_ws("|", *[F.coalesce(p, F.lit(ABSENT)) for p in escaped])


def dim_parts(key: Column) -> Column:
    """Array of a key's texts; null where absent."""
    found = F.regexp_extract_all(F.concat(F.lit("|"), key), F.lit(r"\|((?:[^|\\]|\\.)*)"), F.lit(1))
    return F.transform(found, lambda p: F.when(p != ABSENT, F.regexp_replace(p, r"\\(.)", "$1")))


def md5_hasher(parts: Sequence[Column]) -> Column:
    """32 hex digits over the parts, each with its length before it so that no two lists read alike."""
    return F.md5(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]))


_hasher: Callable[[Sequence[Column]], Column] = md5_hasher


def set_hasher(hasher: Callable[[Sequence[Column]], Column] | None) -> None:
    """Use another expression for row ids; None goes back to md5."""
    global _hasher
    _hasher = hasher or md5_hasher


def get_hasher() -> Callable[[Sequence[Column]], Column]:
    return _hasher


def row_id(metric: str, bucket_ms: Column, key: Column) -> Column:
    """The same id for the same metric, window and series, however often it ships."""
    return _hasher([F.lit(metric), bucket_ms.cast("string"), key])


def natural_key(dims: Sequence[str]) -> list[str]:
    return ["bucket_ts", *dims]


def uuid7(ms: Column) -> Column:
    """A version 7 UUID: ordered by its milliseconds, the rest random.  Not deterministic."""
    rest = F.replace(F.expr("uuid()"), F.lit("-"))
    stamp = F.lpad(F.lower(F.hex(ms)), 12, "0")
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.pmod(F.xxhash64(rest), F.lit(4)) + 1).cast("int"))
    return F.concat_ws(
        "-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(rest, 1, 3)), F.concat(variant, F.substring(rest, 4, 3)), F.substring(rest, 21, 12)
    )
