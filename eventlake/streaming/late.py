"""Late rows of a stream as an output of their own.

Spark drops late rows inside stateful operators. To keep them, each micro-batch is split against
the largest event time of the batches before it. That maximum is handed from batch to batch: batch N reads the
one row that batch N - 1 left and leaves the next, so a restarted query goes on with the right value and a
replayed batch is split exactly as before, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eventlake.functions.times import micros
from eventlake.operators.windows import MILLI

_PROGRESS = "max_at BIGINT"
LATE = "is_late"


def split_late(
    path: str,
    size: str,
    out_of_orderness: str,
    lateness: str,
    slide: str | None = None,
    ts: str = "event_time",
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps rows apart by whether they are late.

    A row is late when its last window ended more than ``lateness`` before the watermark of the
    earlier batches; a row without event time never is. Rows are tagged and written once, partitioned by the tag,
    and the batch's maximum is observed on the way: the batch is evaluated once. Results are below ``path``
    on shared storage, see `split_rows`; a batch that is handed over again replaces itself.
    """
    size_us, slide_us = micros(size), micros(slide or size)

    def split(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = None
        if batch_id:
            seen = spark.read.schema(_PROGRESS).parquet(f"{path}/progress/batch-{batch_id - 1}").first()[0]
        at = F.unix_micros(ts)
        last_end = at - F.pmod(at, F.lit(slide_us)) + size_us
        is_late = F.lit(False)
        if seen is not None:
            watermark = seen - micros(out_of_orderness)
            is_late = F.coalesce(last_end - MILLI + micros(lateness) <= watermark, F.lit(False))
        observed = Observation()
        batch.observe(observed, F.max(at).alias("max_at")).withColumn(LATE, is_late).write.mode(
            "overwrite"
        ).partitionBy(LATE).parquet(f"{path}/rows/batch_id={batch_id}")
        reached = [m for m in (seen, observed.get["max_at"]) if m is not None]
        spark.createDataFrame([(max(reached, default=None),)], _PROGRESS).coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/progress/batch-{batch_id}")

    return split


def split_rows(df: DataFrame, path: str, late: bool) -> DataFrame:
    """The late rows under ``path``, or the others, with the columns of ``df``; reads their folders only."""
    spark = df.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = spark.read.schema(f"{schema}, batch_id BIGINT, {LATE} BOOLEAN").parquet(f"{path}/rows")
    return rows.where(F.col(LATE) == late).select(*df.columns)
