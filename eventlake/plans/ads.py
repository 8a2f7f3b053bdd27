"""Ad clicks by province and the per-user click limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.functions.times import format_time
from eventlake.operators.detect import click_limit
from eventlake.operators.windows import sliding_count


def click_blacklist(
    clicks: DataFrame, limit: int = 100, **kwargs
) -> tuple[DataFrame, DataFrame]:
    """(clicks that pass, warnings) per user and ad; see `click_limit`."""
    return click_limit(clicks, ["userId", "adId"], limit, **kwargs)


def clicks_by_province(
    clicks: DataFrame,
    size: str = "1 hour",
    slide: str = "5 minutes",
    exclude_blacklisted: bool = False,
    limit: int = 100,
    zone: str = "UTC",
    **kwargs,
) -> DataFrame:
    """(province, window_end, window_end_text, count).

    All clicks count unless ``exclude_blacklisted``.
    """
    counted = click_blacklist(clicks, limit, **kwargs)[0] if exclude_blacklisted else clicks
    counts = sliding_count(counted, size, slide, ["province"])
    return counts.select(
        "province",
        "window_end",
        format_time(F.col("window_end"), zone).alias("window_end_text"),
        "count",
    )
