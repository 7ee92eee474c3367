"""Durations and epoch-aligned windows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
LONGEST_INTERVAL = 2**31 - 1
SAFE_INTEGER = 2**53 - 1


def parse_duration(value: str | int, name: str = "duration") -> int:
    """Milliseconds of ``'250ms'``, ``'10s'``, ``'5m'``, ``'2h'``, ``'1d'`` or a whole number."""
    if isinstance(value, int) and not isinstance(value, bool) and 0 <= value <= SAFE_INTEGER:
        return value
    m = re.fullmatch(r"([0-9]+)(ms|s|m|h|d)", value.strip()) if isinstance(value, str) else None
    if m is None:
        raise ValueError(f"{name}: not a duration: {value!r}")
    found = int(m[1]) * _UNITS[m[2]]
    if found > SAFE_INTEGER:
        raise ValueError(f"{name}: too long: {value!r}")
    return found


def parse_interval(value: str | int, name: str = "interval") -> int:
    """A duration that a timer can wait for: above 0 and at most 2**31 - 1 ms."""
    found = parse_duration(value, name)
    if not 0 < found <= LONGEST_INTERVAL:
        raise ValueError(f"{name}: must be above 0 and at most {LONGEST_INTERVAL} ms: {value!r}")
    return found


def format_duration(ms: int) -> str:
    """The largest unit that holds ``ms`` exactly."""
    unit = next((u for u in ("d", "h", "m", "s") if ms and ms % _UNITS[u] == 0), "ms")
    return f"{ms // _UNITS[unit]}{unit}"


def check_divides(resolution: int, flush: int) -> None:
    if flush % resolution:
        raise ValueError(f"resolution {format_duration(resolution)} must divide flush {format_duration(flush)}")


def bucket_start(ms: int, resolution: int) -> int:
    if ms < 0 or resolution <= 0:
        raise ValueError("a window needs a time from 0 and a resolution above 0")
    return ms // resolution * resolution


def bucket_range(start: int, end: int, resolution: int) -> range:
    """Starts of the windows that ``[start, end)`` touches: the first is the one that ``start`` falls into; none if it is empty."""
    return range(bucket_start(start, resolution), end if end > start else 0, resolution)


def closed_up_to(resolution: int, now: int, grace: int) -> int:
    """End of the last window that is over, ``grace`` included."""
    return bucket_start(max(0, now - grace), resolution)


def landing(bucket: int, floor: int, resolution: int) -> int:
    """The window a write lands in when all below ``floor`` has shipped: its own, or the first of its grid from there."""
    return bucket if bucket >= floor else -(-floor // resolution) * resolution


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp (sessions run in UTC); finer digits are cut."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 1000).cast("long")


def timestamp(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def bucket_start_col(ms: Column, resolution: int) -> Column:
    return ms - F.pmod(ms, F.lit(resolution))


def landing_col(bucket: Column, floor: Column | int, resolution: int) -> Column:
    floor = floor if isinstance(floor, Column) else F.lit(floor)
    return F.greatest(bucket, floor + F.pmod(-floor, F.lit(resolution)))
