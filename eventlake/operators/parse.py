"""Text lines to typed records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventlake.functions.text import split_dropping_tail
from eventlake.functions.times import event_time


def csv_records(
    lines: DataFrame, schema: str, column: str = "line", strict: bool = True
) -> DataFrame:
    """Comma-separated lines → the columns of ``schema``; surplus fields are ignored.

    Strict parsing fails the job on a missing field or a bad number. Otherwise such rows come
    back with ``is_bad`` set and the ``line`` kept, for a quarantine.
    """
    fields = StructType.fromDDL(schema)
    parts = split_dropping_tail(F.col(column), ",")
    if strict:
        return lines.select(
            *[parts[i].cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]
        )
    typed = [F.get(parts, i).try_cast(f.dataType) for i, f in enumerate(fields)]
    bad = F.lit(False)
    for value in typed:
        bad = bad | value.isNull()
    return lines.select(
        *[v.alias(f.name) for v, f in zip(typed, fields, strict=True)],
        bad.alias("is_bad"),
        F.col(column).alias("line"),
    )


def with_event_time(df: DataFrame, column: str = "timestamp", unit: str = "seconds") -> DataFrame:
    """Add ``event_time`` next to the raw epoch column."""
    return df.withColumn("event_time", event_time(F.col(column), unit))


def with_processing_time(df: DataFrame, out: str = "event_time") -> DataFrame:
    """Use the time of processing as the time column; results depend on when the job runs."""
    return df.withColumn(out, F.current_timestamp())


def access_log(
    lines: DataFrame, column: str = "line", zone: str = "UTC", keep: Sequence[str] = ()
) -> DataFrame:
    """Space-separated access-log lines → (ip, userId, event_time, method, url) and ``keep``.

    The time is read in ``zone``; the offset written in the line is not used.
    """
    part = F.split(F.col(column), " ")
    local = F.to_timestamp_ntz(part[3], F.lit("dd/MM/yyyy:HH:mm:ss"))
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), utc)
    return lines.select(
        *keep,
        part[0].alias("ip"),
        part[1].alias("userId"),
        F.timestamp_micros(micros).alias("event_time"),
        part[5].alias("method"),
        part[6].alias("url"),
    )
