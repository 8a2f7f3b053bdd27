"""Sliding windows on streams by panes, with and without corrections.

A row becomes one entry of the slide-sized pane it lies in, not one for each window that overlaps there
(12 for an hour every five minutes, 120 for ten minutes every five seconds). What windows yet to
come need of earlier micro-batches is a table of the last panes, one for each micro-batch, on shared storage.
A micro-batch reads the table of the one before it only, and one that is handed over again writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions.times import micros
from eventlake.operators.windows import MILLI, sliding_count
from eventlake.session import shared_dir
from eventlake.streaming.run import drain_batches

Finish = Callable[[DataFrame], DataFrame]
_PROGRESS = "until BIGINT"


def _check(size: str, slide: str) -> None:
    if micros(size) % micros(slide):
        raise ValueError("the slide has to divide the size")


class _Carried:
    """The panes and the progress that micro-batch N leaves to N + 1."""

    def __init__(self, path: str, schema: str):
        self.path, self.schema = path, schema

    def before(self, spark: SparkSession, batch_id: int) -> tuple[DataFrame, int | None]:
        if batch_id == 0:
            return spark.createDataFrame([], self.schema), None
        folder = f"{self.path}/%s/batch-{batch_id - 1}"
        panes = spark.read.schema(self.schema).parquet(folder % "panes")
        return panes, spark.read.schema(_PROGRESS).parquet(folder % "progress").first()[0]

    def leave(self, panes: DataFrame, until: int | None, batch_id: int) -> None:
        spark = panes.sparkSession
        panes.write.mode("overwrite").parquet(f"{self.path}/panes/batch-{batch_id}")
        spark.createDataFrame([(until,)], _PROGRESS).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/progress/batch-{batch_id}"
        )

    def table(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """``df`` written once for this micro-batch, so that it is evaluated once."""
        folder = f"{self.path}/{name}/batch-{batch_id}"
        df.write.mode("overwrite").parquet(folder)
        return df.sparkSession.read.schema(df.schema).parquet(folder)


def pane_counts(df: DataFrame, slide: str, keys: list[str], ts: str = "event_time") -> DataFrame:
    """(pane_end, keys, n): rows per pane and key once the watermark has passed the pane's end."""
    counted = df.groupBy(F.window(ts, slide), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.end").alias("pane_end"), *keys, "n")


def _windows(panes: DataFrame, size: str, slide: str, keys: list[str], low: int | None, high: int) -> DataFrame:
    """(window_start, window_end, keys, count) of the windows that end in (low, high], from pane counts."""
    inside = panes.withColumn("__at", F.col("pane_end") - F.expr("INTERVAL 1 MICROSECOND"))
    counts = sliding_count(inside, size, slide, keys, "__at", weight=F.col("n"))
    after = F.unix_micros("window_end") <= high
    return counts.where(after if low is None else after & (F.unix_micros("window_end") > low))


class ClosedWindows:
    """``foreachBatch`` work: closed panes in, closed sliding windows out, under ``path/windows``.

    A window comes out with the first pane that closes at or after its end. ``flush`` gives those that the
    watermark has passed since; it writes where the next micro-batch will, which gives the same windows again.
    """

    def __init__(self, path: str, schema: str, size: str, slide: str, keys: list[str], finish: Finish):
        _check(size, slide)
        self.path, self.size, self.slide, self.keys, self.finish = path, size, slide, keys, finish
        self.carried = _Carried(path, schema)
        self.following = 0

    def _write(self, counts: DataFrame, batch_id: int) -> None:
        self.finish(counts).write.mode("overwrite").parquet(f"{self.path}/windows/batch_id={batch_id}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier, until = self.carried.before(spark, batch_id)
        closed = self.carried.table(batch, "closed", batch_id)
        latest = closed.agg(F.max(F.unix_micros("pane_end"))).first()[0]
        now = max((u for u in (until, latest) if u is not None), default=None)
        panes = earlier.unionByName(closed)
        # Before the first pane has closed there is nothing to tell.
        self._write(_windows(panes, self.size, self.slide, self.keys, until, now or 0), batch_id)
        if now is not None:
            panes = panes.where(F.unix_micros("pane_end") > now - micros(self.size))
        self.carried.leave(panes, now, batch_id)
        self.following = batch_id + 1

    def flush(self, spark: SparkSession, watermark: int) -> None:
        if self.following:
            panes, until = self.carried.before(spark, self.following)
            if until is not None and watermark > until:
                self._write(_windows(panes, self.size, self.slide, self.keys, until, watermark), self.following)


def drain_closed_windows(
    df: DataFrame,
    size: str,
    slide: str,
    keys: list[str],
    finish: Finish = lambda counts: counts,
    path: str | None = None,
) -> DataFrame:
    """``finish`` of the counts per key of all sliding windows the watermark passes until the input ends.

    Set the watermark first. ``finish`` gets whole windows: (window_start, window_end, keys, count).
    """
    spark = df.sparkSession
    path = path or shared_dir(spark, "windows")
    counts = pane_counts(df, slide, keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields)
    closed = ClosedWindows(path, schema, size, slide, keys, finish)
    watermark = drain_batches(counts, closed)
    if watermark is not None:
        closed.flush(spark, watermark)
    empty = finish(_windows(spark.createDataFrame([], schema), size, slide, keys, None, 0))
    if not closed.following:
        return empty
    return spark.read.schema(empty.schema).option("basePath", f"{path}/windows").parquet(
        f"{path}/windows/batch_id=*"
    ).select(*empty.columns)


class CorrectedWindows:
    """``foreachBatch`` work: windows as they close, and again when late rows change them.

    The input is rows as they arrive, not yet watermarked. After each micro-batch the watermark is the largest
    event time so far less ``out_of_orderness``; the next batch is judged by it. A window comes out once the watermark
    reaches its end (``kind`` first), and again in every later micro-batch that adds to it (``corrected``) until
    its end plus ``lateness``, when what is known of it is dropped. A row whose windows are all dropped
    changes nothing. ``counted`` says which rows count; all advance the watermark.

    Under ``path/updates``: what ``finish`` makes of the changed windows (window_start, window_end, keys, count,
    kind), a folder ``batch_id=N`` for each micro-batch.
    """

    def __init__(
        self,
        path: str,
        size: str,
        slide: str,
        keys: list[str],
        out_of_orderness: str,
        lateness: str,
        finish: Finish,
        counted=None,
        ts: str = "event_time",
    ):
        _check(size, slide)
        self.path, self.size, self.slide, self.keys, self.finish = path, size, slide, keys, finish
        self.delay, self.lateness = micros(out_of_orderness) - MILLI, micros(lateness)
        self.counted = F.lit(True) if counted is None else counted
        self.ts = ts

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        slide = micros(self.slide)
        at = F.unix_micros(self.ts)
        kinds = dict(batch.dtypes)
        schema = "pane_end TIMESTAMP, " + "".join(f"`{k}` {kinds[k]}, " for k in self.keys) + "n BIGINT"
        carried = _Carried(self.path, schema)
        earlier, passed = carried.before(spark, batch_id)
        arrived = carried.table(
            batch.groupBy(*self.keys, F.timestamp_micros(at - F.pmod(at, F.lit(slide)) + slide).alias("pane_end")).agg(
                F.count_if(self.counted).alias("n"), F.max(at).alias("latest")
            ),
            "arrived",
            batch_id,
        )
        latest = arrived.agg(F.max("latest")).first()[0]
        reached = [w for w in (passed, None if latest is None else latest - self.delay) if w is not None]
        now = max(reached, default=None)
        new = arrived.where("n > 0").select("pane_end", *self.keys, "n")
        panes = carried.table(
            earlier.unionByName(new).groupBy("pane_end", *self.keys).agg(F.sum("n").alias("n")), "all", batch_id
        )
        dropped = None if passed is None else passed - self.lateness
        # Before the first event time there is nothing to tell.
        changed = _windows(panes, self.size, self.slide, self.keys, dropped, now or 0)
        if passed is None:
            changed = changed.withColumn("kind", F.lit("first"))
        else:
            first = F.unix_micros("window_end") > passed
            again = _windows(new, self.size, self.slide, [], dropped, passed).select("window_end")
            changed = (
                changed.where(first)
                .withColumn("kind", F.lit("first"))
                .unionByName(
                    changed.where(~first)
                    .join(again, "window_end", "left_semi")
                    .withColumn("kind", F.lit("corrected"))
                )
            )
        self.finish(changed).write.mode("overwrite").parquet(f"{self.path}/updates/batch_id={batch_id}")
        if now is not None:
            last_end = F.unix_micros("pane_end") + micros(self.size) - slide
            panes = panes.where(last_end > now - self.lateness)
        carried.leave(panes, now, batch_id)
