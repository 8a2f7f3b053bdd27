"""App marketing counts by channel and behavior, and in total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.operators.windows import sliding_count

# The jobs keep this one behavior (fixed value); pass another predicate to change it.
KEPT_BEHAVIOR = "UNINSTALL"


def _kept(events: DataFrame, keep: Column | None) -> DataFrame:
    return events.where(F.col("behavior") == KEPT_BEHAVIOR if keep is None else keep)


def marketing_by_channel(
    events: DataFrame,
    keep: Column | None = None,
    size: str = "1 hour",
    slide: str = "5 seconds",
) -> DataFrame:
    counts = sliding_count(_kept(events, keep), size, slide, ["channel", "behavior"])
    return counts.select("channel", "behavior", "window_end", "count")


def marketing_total(
    events: DataFrame,
    keep: Column | None = None,
    size: str = "1 hour",
    slide: str = "5 seconds",
) -> DataFrame:
    """Counts of all channels together, labelled ``total``."""
    total = F.lit("total")
    labelled = _kept(events, keep).select(
        "event_time", total.alias("channel"), total.alias("behavior")
    )
    counts = sliding_count(labelled, size, slide, ["channel", "behavior"])
    return counts.select("channel", "behavior", "window_end", "count")
