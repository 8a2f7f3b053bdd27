"""Event-time columns and window arithmetic on epoch microseconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MICROS = {
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def event_time(epoch: Column, unit: str = "seconds") -> Column:
    """Epoch seconds or millis as a TIMESTAMP."""
    if unit == "seconds":
        return F.timestamp_seconds(epoch)
    if unit == "millis":
        return F.timestamp_millis(epoch)
    raise ValueError(f"unknown epoch unit {unit!r}")


def micros(duration: str) -> int:
    """``'10 minutes'`` → 600000000."""
    match = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", duration)
    if not match or match.group(2) not in _UNIT_MICROS:
        raise ValueError(f"cannot read duration {duration!r}")
    return int(match.group(1)) * _UNIT_MICROS[match.group(2)]


def format_time(ts: Column, zone: str = "UTC") -> Column:
    """Timestamp as text in an explicit zone."""
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), ts.cast("timestamp_ntz"))
    return F.date_format(local, "yyyy-MM-dd HH:mm:ss.S")
