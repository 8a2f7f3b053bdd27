"""Watermarked windows on streams; windows are emitted once, when the watermark closes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.times import format_time, micros
from eventlake.operators.topn import top_n
from eventlake.operators.transforms import keep, page_request, page_requests
from eventlake.session import shared_dir
from eventlake.streaming.panes import CorrectedWindows, drain_closed_windows
from eventlake.streaming.run import drain_batches


def ascending(df: DataFrame, ts: str = "event_time") -> DataFrame:
    """Watermark for input that arrives in event-time order."""
    return df.withWatermark(ts, "0 seconds")


def bounded(df: DataFrame, delay: str, ts: str = "event_time") -> DataFrame:
    """Watermark for input at most ``delay`` out of order."""
    return df.withWatermark(ts, delay)


def with_lateness(
    df: DataFrame, out_of_orderness: str, lateness: str, ts: str = "event_time"
) -> DataFrame:
    """Watermark that keeps windows open for ``lateness`` beyond the out-of-orderness.

    A window is emitted once with all rows that came in time, late ones included, instead of
    being emitted early and then corrected.
    """
    total = micros(out_of_orderness) + micros(lateness)
    return df.withWatermark(ts, f"{total // 1000} milliseconds")


def _ranked(n: int, key: str) -> Callable[[DataFrame], DataFrame]:
    """Top ``n`` of whole windows, as `ClosedWindows` and `CorrectedWindows` hand them over."""

    def rank(counts: DataFrame) -> DataFrame:
        kind = ["kind"] if "kind" in counts.columns else []
        return top_n(counts, ["window_end"], "count", n, [key]).select("window_end", "rank", key, "count", *kind)

    return rank


def drain_hot_items(
    behaviors: DataFrame,
    n: int = 5,
    path: str | None = None,
    size: str = "1 hour",
    slide: str = "5 minutes",
    behavior: str = "pv",
) -> DataFrame:
    """The streaming form of `eventlake.plans.hot_items.hot_items`, run to the end of its input.

    Set the watermark first.
    """
    views = keep(behaviors, F.col("behavior") == behavior)
    return drain_closed_windows(views, size, slide, ["itemId"], _ranked(n, "itemId"), path)


def drain_hot_pages(
    log: DataFrame, n: int = 3, path: str | None = None, size: str = "10 minutes", slide: str = "5 seconds"
) -> DataFrame:
    """The streaming form of `eventlake.plans.hot_pages.hot_pages`, run to the end of its input; see `with_lateness`."""
    return drain_closed_windows(page_requests(log), size, slide, ["url"], _ranked(n, "url"), path)


def drain_hot_page_updates(
    log: DataFrame,
    n: int = 3,
    path: str | None = None,
    size: str = "10 minutes",
    slide: str = "5 seconds",
    out_of_orderness: str = "1 second",
    lateness: str = "1 minute",
) -> DataFrame:
    """(window_end, rank, url, count, kind, batch_id): rankings when windows close, and corrected ones.

    A late request overwrites its page's count in all its windows that are kept, and these are ranked
    again; see `CorrectedWindows`. ``log`` has no watermark of its own.
    """
    spark = log.sparkSession
    path = path or shared_dir(spark, "page-updates")
    updates = CorrectedWindows(
        path, size, slide, ["url"], out_of_orderness, lateness, _ranked(n, "url"), page_request()
    )
    drain_batches(log.select("event_time", "method", "url"), updates)
    schema = "window_end TIMESTAMP, rank INT, url STRING, count BIGINT, kind STRING, batch_id BIGINT"
    return spark.read.schema(schema).parquet(f"{path}/updates")


def drain_ad_clicks(
    clicks: DataFrame, size: str = "1 hour", slide: str = "5 minutes", zone: str = "UTC", path: str | None = None
) -> DataFrame:
    """The streaming form of `eventlake.plans.ads.clicks_by_province`; set the watermark first."""

    def finish(counts: DataFrame) -> DataFrame:
        text = format_time(F.col("window_end"), zone).alias("window_end_text")
        return counts.select("province", "window_end", text, "count")

    return drain_closed_windows(clicks, size, slide, ["province"], finish, path)


def drain_marketing(
    events: DataFrame, kept: Column, size: str = "1 hour", slide: str = "5 seconds", path: str | None = None
) -> DataFrame:
    """The streaming form of `eventlake.plans.marketing.marketing_by_channel`; set the watermark first."""

    def finish(counts: DataFrame) -> DataFrame:
        return counts.select("channel", "behavior", "window_end", "count")

    return drain_closed_windows(keep(events, kept), size, slide, ["channel", "behavior"], finish, path)
