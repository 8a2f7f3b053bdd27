"""Keyed detection in batch form: jumps, rises, repeated failures, click limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions.times import micros
from eventlake.operators.episodes import assign_episodes, finished_episodes
from eventlake.operators.ordered import DEFAULT_CHUNK_ROWS, ordered


def jump_alert(
    df: DataFrame,
    key: str,
    value: str,
    threshold: float,
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """(key, seq, last, now) where consecutive values differ by at least ``threshold``."""
    rows = ordered(df.select(key, seq, value), [key], [seq], chunk_rows)
    compared = rows.framed(1, lambda w: {"last": F.lag(value).over(w)}).result()
    return compared.where(F.abs(F.col("last") - F.col(value)) >= threshold).select(
        key, seq, "last", F.col(value).alias("now")
    )


def rise_alert(
    df: DataFrame,
    key: str,
    value: str,
    interval: str = "10 seconds",
    order: tuple[str, ...] = ("event_time",),
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """(key, rise_start, alert_time): a rise no later value breaks within ``interval``.

    Timing starts at a rise. A value that does not rise, up to and including the end of the
    interval, cancels it; otherwise the alert is raised and the next rise starts anew. Silence
    after a rise still alerts.
    """
    rows = ordered(df.select(key, *order, value), [key], list(order), chunk_rows)
    alerts = finished_episodes(
        rows.framed(1, lambda w: {"__last": F.lag(value).over(w)}),
        opens=F.coalesce(F.col("__last") < F.col(value), F.lit(False)),
        resets=F.coalesce(F.col("__last") >= F.col(value), F.lit(False)),
        window_us=micros(interval),
    )
    return alerts.select(
        key,
        F.col("opened_at").alias("rise_start"),
        F.timestamp_micros(F.unix_micros("opened_at") + micros(interval)).alias("alert_time"),
    )


def repeated_failures(
    df: DataFrame,
    key: str,
    is_failure: Column,
    min_failures: int = 2,
    interval: str = "2 seconds",
    order: tuple[str, ...] = ("event_time",),
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """(key, first_fail, last_fail, fail_times) of unbroken failure runs.

    A run is counted from its first failure for ``interval``; any success within it, its end
    included, discards the run.
    """
    episodes = finished_episodes(
        ordered(df, [key], list(order), chunk_rows),
        opens=F.coalesce(is_failure, F.lit(False)),
        resets=~F.coalesce(is_failure, F.lit(False)),
        window_us=micros(interval),
    )
    return episodes.where(F.col("rows") >= min_failures).select(
        key,
        F.col("opened_at").alias("first_fail"),
        F.col("last_at").alias("last_fail"),
        F.col("rows").alias("fail_times"),
    )


def click_limit(
    clicks: DataFrame,
    keys: list[str],
    limit: int,
    ts: str = "event_time",
    seq: str = "seq",
    reset: str = "calendar_day",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(clicks that pass, warnings): the first ``limit`` clicks pass, the next one warns.

    Counting restarts at midnight (``calendar_day``) or 24 h after the first counted click
    (``rolling_24h``).
    """
    if reset == "calendar_day":
        period = clicks.withColumn("__period", F.to_date(ts))
    elif reset == "rolling_24h":
        at = clicks.withColumn(
            "__at", F.unix_micros(F.col(ts).cast("timestamp"))
        ).withColumn("__opens", F.lit(True))
        rows = ordered(at, keys, [ts, seq], chunk_rows)
        period = (
            assign_episodes(rows, micros("1 day"))
            .result()
            .withColumnRenamed("__episode", "__period")
            .drop("__opens", "__at")
        )
    else:
        raise ValueError(f"unknown reset {reset!r}")
    # Catalyst keeps at most limit + 1 rows per group before the shuffle.
    order = [seq] if reset == "calendar_day" else [ts, seq]
    w = Window.partitionBy(*keys, "__period").orderBy(*order)
    ranked = period.withColumn("__n", F.row_number().over(w)).where(
        F.col("__n") <= limit + 1
    )
    passed = ranked.where(F.col("__n") <= limit).select(*clicks.columns)
    warnings = ranked.where(F.col("__n") == limit + 1).select(
        *keys,
        F.col(seq).alias("warned_at"),
        # Fixed value: the text must match.
        F.lit(f"click over {limit} times.").alias("warning"),
    )
    return passed, warnings
