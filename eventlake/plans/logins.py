"""Repeated login failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.times import micros
from eventlake.operators.detect import repeated_failures


def warning_text(interval: str, fail_times: Column) -> Column:
    seconds = micros(interval) // 1_000_000
    # Fixed value: the text must match.
    return F.concat(
        F.lit(f"login fail in {seconds}s for "), fail_times.cast("string"), F.lit(" times")
    )


def login_failures(
    logins: DataFrame,
    min_failures: int = 2,
    interval: str = "2 seconds",
    **kwargs,
) -> DataFrame:
    """(userId, first_fail, last_fail, fail_times, warning)."""
    runs = repeated_failures(
        logins, "userId", F.col("loginState") == "fail", min_failures, interval, **kwargs
    )
    return runs.withColumn("warning", warning_text(interval, F.col("fail_times")))
