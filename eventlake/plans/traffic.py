"""Page views and unique visitors per hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.hashing import BITMAP_BITS, bitmap_offset
from eventlake.operators.ordered import DEFAULT_CHUNK_ROWS, ordered
from eventlake.operators.transforms import keep
from eventlake.operators.windows import tumbling, tumbling_count


def _views(behaviors: DataFrame, behavior: str) -> DataFrame:
    return keep(behaviors, F.col("behavior") == behavior)


def page_views(
    behaviors: DataFrame, size: str = "1 hour", behavior: str = "pv", ts: str = "event_time"
) -> DataFrame:
    """Views per window; partial counts are made before the shuffle."""
    return tumbling_count(_views(behaviors, behavior), size, [], ts)


def page_views_salted(
    behaviors: DataFrame,
    salt: Column,
    salts: int = 10,
    size: str = "1 hour",
    behavior: str = "pv",
    ts: str = "event_time",
) -> DataFrame:
    """The same counts by way of ``salts`` sub-keys per window, then a sum per window.

    ``salt`` is any spread-out column, so that a retried task salts its rows alike.
    """
    salted = _views(behaviors, behavior).withColumn(
        "__salt", F.pmod(F.xxhash64(salt), F.lit(salts))
    )
    partial = salted.groupBy(F.window(ts, size), "__salt").agg(F.count(F.lit(1)).alias("n"))
    return (
        partial.groupBy("window")
        .agg(F.sum("n").alias("count"))
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "count",
        )
    )


def unique_visitors(
    behaviors: DataFrame, size: str = "1 hour", behavior: str = "pv", ts: str = "event_time"
) -> DataFrame:
    """Exact distinct users per window; batch and stream.

    Users are first made distinct per (window, user), in parallel, then counted per window.
    """
    seen = _views(behaviors, behavior).select(F.window(ts, size).alias("window"), "userId")
    if behaviors.isStreaming:
        distinct = seen.dropDuplicates(["window", "userId"])
        counted = distinct.groupBy("window").agg(F.count(F.lit(1)).alias("uv"))
    else:
        counted = seen.groupBy("window").agg(F.count_distinct("userId").alias("uv"))
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "uv"
    )


def visitor_bitmaps(
    behaviors: DataFrame,
    size: str = "1 hour",
    behavior: str = "pv",
    ts: str = "event_time",
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """(window_start, window_end, bucket, bitmap): each window's visitors as bits of a bitmap of ``bits`` positions.

    The bitmap is in buckets of 32,768 positions (4 KB), only those that have a visitor. Bits are
    set before the shuffle, so a task sends at most one bitmap for each window and bucket, however many views
    there are, and a window never has more than ``bits`` / 8 bytes. Bitmaps merge with `merged_bitmaps`.
    """
    offset = bitmap_offset(F.col("userId").cast("string"), bits)
    hashed = _views(behaviors, behavior).select(ts, offset.alias("offset"))
    placed = hashed.select(
        ts,
        F.bitmap_bucket_number("offset").alias("bucket"),
        F.bitmap_bit_position("offset").alias("position"),
    )
    return tumbling(placed, size, ["bucket"], [F.bitmap_construct_agg("position").alias("bitmap")], ts)


def merged_bitmaps(bitmaps: DataFrame, size: str) -> DataFrame:
    """Bitmaps of windows merged into those of longer windows: visitors of several count once."""
    at = F.col("window_start").alias("at")
    return tumbling(
        bitmaps.select(at, "bucket", "bitmap"), size, ["bucket"], [F.bitmap_or_agg("bitmap").alias("bitmap")], "at"
    )


def bitmap_visitors(bitmaps: DataFrame) -> DataFrame:
    """(window_start, window_end, uv): how many bits of each window's bitmap are set."""
    return bitmaps.groupBy("window_start", "window_end").agg(F.sum(F.bitmap_count("bitmap")).alias("uv"))


def unique_visitors_bitmap(
    behaviors: DataFrame,
    size: str = "1 hour",
    behavior: str = "pv",
    ts: str = "event_time",
    bits: int = BITMAP_BITS,
) -> DataFrame:
    """Set bitmap positions per window: users whose ids collide count once."""
    return bitmap_visitors(visitor_bitmaps(behaviors, size, behavior, ts, bits))


def unique_visitors_running(
    behaviors: DataFrame,
    size: str = "1 hour",
    behavior: str = "pv",
    ts: str = "event_time",
    seq: str = "seq",
    bits: int = BITMAP_BITS,
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """(window_end, seq, uv): the running count each time a window sees a new bitmap position."""
    first_seen = (
        _views(behaviors, behavior)
        .select(
            F.window(ts, size).getField("end").alias("window_end"),
            bitmap_offset(F.col("userId").cast("string"), bits).alias("offset"),
            seq,
        )
        .groupBy("window_end", "offset")
        .agg(F.min(seq).alias(seq))
    )
    rows = ordered(first_seen, ["window_end"], [seq], chunk_rows)
    counted = rows.running({"uv": ("count", F.lit(1))}).result()
    return counted.select("window_end", seq, "uv")
