"""Time windows, count windows and OVER row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions.times import micros
from eventlake.operators.ordered import DEFAULT_CHUNK_ROWS, ordered

# A window covers instants up to one millisecond before its end (in micros).
MILLI = 1_000
# A sliding count works in blocks of so many window lengths.
BLOCK_WINDOWS = 4


def _floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def _bounds(window: str = "window") -> list[Column]:
    return [
        F.col(f"{window}.start").alias("window_start"),
        F.col(f"{window}.end").alias("window_end"),
    ]


def tumbling(
    df: DataFrame, size: str, keys: list[str], aggs: list[Column], ts: str = "event_time"
) -> DataFrame:
    """Aggregates per key and tumbling window; batch and stream."""
    grouped = df.groupBy(F.window(ts, size), *keys).agg(*aggs)
    rest = [c for c in grouped.columns if c != "window"]
    return grouped.select(*_bounds(), *rest)


def tumbling_count(
    df: DataFrame, size: str, keys: list[str], ts: str = "event_time"
) -> DataFrame:
    return tumbling(df, size, keys, [F.count(F.lit(1)).alias("count")], ts)


def tumbling_min_by(
    df: DataFrame,
    size: str,
    key: str,
    by: str,
    ts: str = "event_time",
    seq: str = "seq",
) -> DataFrame:
    """The whole row with the smallest ``by`` per key and window; the first wins ties."""
    columns = [c for c in df.columns if c != key]
    row = F.min_by(F.struct(*columns), F.struct(F.col(by), F.col(seq))).alias("__row")
    best = tumbling(df, size, [key], [row], ts)
    return best.select(
        "window_start", "window_end", key, *[f"__row.{c}" for c in columns]
    )


def sliding_count(
    df: DataFrame,
    size: str,
    slide: str,
    keys: list[str],
    ts: str = "event_time",
    out: str = "count",
    open_after: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Rows per key and sliding window, or the sum of a whole-number ``weight`` of them.

    ``open_after`` (epoch micros, batch only) leaves a row out of the windows that end at or
    before it, for rows that arrived after some of their windows were closed.

    Streams use the built-in sliding window. The batch form counts slide-sized panes first and
    turns each pane into two changes: plus its count where it enters a window, minus it where
    it leaves. A running sum gives the count of every window, so two rows per pane are shuffled
    however many windows overlap (720 for one hour every five seconds). The sum runs within a key
    and a block of ``BLOCK_WINDOWS`` window lengths; a pane whose windows reach into the next block
    is there from its start, so blocks need nothing of each other and a key is never one task.
    """
    size_us, slide_us = micros(size), micros(slide)
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    if df.isStreaming or size_us % slide_us:
        grouped = df.groupBy(F.window(ts, size, slide), *keys).agg(total.alias(out))
        return grouped.select(*_bounds(), *keys, out)

    at = F.unix_micros(F.col(ts))
    pane_end = at - F.pmod(at, F.lit(slide_us)) + slide_us
    enters = pane_end
    if open_after is not None:
        next_end = open_after - F.pmod(open_after, F.lit(slide_us)) + slide_us
        enters = F.least(F.greatest(pane_end, next_end), pane_end + size_us)
    panes = df.groupBy(*keys, pane_end.alias("__pane"), enters.alias("__enters")).agg(
        total.alias("__n")
    )
    block_us = BLOCK_WINDOWS * size_us
    leaves = F.col("__pane") + size_us
    blocks = panes.where(F.col("__enters") < leaves).withColumn(
        "__block",
        F.explode(
            F.sequence(
                _floor_div(F.col("__enters"), block_us), _floor_div(leaves - 1, block_us)
            )
        ),
    )
    begins, ends_ = F.col("__block") * block_us, (F.col("__block") + 1) * block_us
    changes = blocks.select(
        *keys,
        "__block",
        F.explode(
            F.array(
                F.struct(
                    F.greatest("__enters", begins).alias("at"), F.col("__n").alias("change")
                ),
                F.struct(F.least(leaves, ends_).alias("at"), (-F.col("__n")).alias("change")),
            )
        ).alias("__c"),
    ).select(*keys, "__block", "__c.*")
    by_time = Window.partitionBy(*keys, "__block").orderBy("at")
    levels = changes.select(
        *keys,
        "at",
        F.sum("change").over(by_time).alias(out),
        F.lead("at").over(by_time).alias("__until"),
    ).where((F.col(out) > 0) & (F.col("__until") > F.col("at")))
    ends = levels.select(
        *keys,
        F.explode(F.sequence("at", F.col("__until") - slide_us, F.lit(slide_us))).alias(
            "__end"
        ),
        out,
    )
    return ends.select(
        F.timestamp_micros(F.col("__end") - size_us).alias("window_start"),
        F.timestamp_micros("__end").alias("window_end"),
        *keys,
        out,
    )


def count_window_avg(
    df: DataFrame,
    key: str,
    value: str,
    size: int = 10,
    slide: int = 2,
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Mean of the last ``size`` rows per key at every ``slide``-th row; no firing at the tail.

    Output: key, seq of the firing row, ``n`` (row number within the key), ``avg``.
    """
    rows = ordered(df.select(key, seq, value), [key], [seq], chunk_rows)
    framed = rows.running({"n": ("count", F.lit(1))}).framed(
        size - 1, lambda w: {"avg": F.avg(value).over(w.rowsBetween(1 - size, 0))}
    )
    return framed.result().where(F.col("n") % slide == 0).select(key, seq, "n", "avg")


def over_rows(
    df: DataFrame,
    key: str,
    order: list[str],
    preceding: int,
    aggs: dict[str, Column],
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """OVER aggregates on the current row and ``preceding`` rows before it, per key.

    ``aggs`` holds aggregate expressions such as ``F.avg("temperature")``.
    """
    rows = ordered(df, [key], order, chunk_rows)
    return rows.framed(
        preceding,
        lambda w: {n: a.over(w.rowsBetween(-preceding, 0)) for n, a in aggs.items()},
    ).result()


def late_split(
    df: DataFrame,
    size: str,
    out_of_orderness: str,
    lateness: str = "0 seconds",
    slide: str | None = None,
    ts: str = "event_time",
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Add ``watermark`` and ``is_late`` as a per-row watermark would see the rows arrive.

    The watermark before a row is the largest event time of earlier arrivals minus the
    out-of-orderness. A row is late when even the last window holding it ended more than
    ``lateness`` before that.
    """
    slide_us = micros(slide or size)
    rows = ordered(df, [], [seq], chunk_rows)
    seen = rows.running({"__max_ts": ("max", F.col(ts))}, include_current=False).result()
    at = F.unix_micros(F.col(ts))
    last_end = at - F.pmod(at, F.lit(slide_us)) + micros(size)
    watermark = F.unix_micros("__max_ts") - micros(out_of_orderness)
    closed = last_end - MILLI + micros(lateness) <= watermark
    return seen.select(
        *df.columns,
        F.timestamp_micros(watermark).alias("watermark"),
        F.coalesce(closed, F.lit(False)).alias("is_late"),
    )


def windowed_sum_with_lateness(
    df: DataFrame,
    size: str,
    key: str,
    value: str,
    out_of_orderness: str,
    lateness: str,
    ts: str = "event_time",
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(final sums per key and tumbling window, late rows)."""
    split = late_split(
        df, size, out_of_orderness, lateness, ts=ts, seq=seq, chunk_rows=chunk_rows
    )
    on_time = split.where(~F.col("is_late"))
    sums = tumbling(on_time, size, [key], [F.sum(value).alias("sum")], ts)
    return sums, split.where("is_late").select(*df.columns)
