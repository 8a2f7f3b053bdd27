"""Running unique-visitor counts on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.functions.hashing import BITMAP_BITS, bitmap_offset
from eventlake.functions.times import micros
from eventlake.operators.ordered import DEFAULT_CHUNK_ROWS, ordered
from eventlake.operators.transforms import keep as kept

_TOTALS = "window_end TIMESTAMP, total BIGINT"


def first_sightings(
    behaviors: DataFrame, size: str = "1 hour", behavior: str = "pv", bits: int = BITMAP_BITS
) -> DataFrame:
    """(window_end, offset, seq): first arrival per window and bitmap position.

    Run it in update mode with the watermark set. A position's state keeps the micro-batch that
    saw it first and the least arrival number in there; it comes out in that batch only, whatever
    arrival numbers other batches hold.
    """
    offset = bitmap_offset(F.col("userId").cast("string"), bits).alias("offset")
    # On a stream this is the micro-batch's time, the same for all its rows and for a replay.
    batch_time = F.current_timestamp().alias("at")
    first = (
        kept(behaviors, F.col("behavior") == behavior)
        .select("event_time", offset, "seq", batch_time)
        .groupBy(F.window("event_time", size), "offset")
        .agg(F.min(F.struct("at", "seq")).alias("first"), F.max("at").alias("latest"))
        .where(F.col("first.at") == F.col("latest"))
    )
    return first.select(
        F.col("window.end").alias("window_end"), "offset", F.col("first.seq").alias("seq")
    )


def number_first_sightings(
    path: str, chunk_rows: int = DEFAULT_CHUNK_ROWS, keep: str = "1 day"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that counts up the visitors of every window.

    A batch holds new sightings only. They are numbered in arrival order on top of the count
    their window had reached; each batch leaves the counts of open windows to the next, which reads
    those of one batch. Windows that ended more than ``keep`` before the newest one are closed; ``keep`` is to be
    at least the window and the watermark's delay. Results, under ``path`` on shared storage: ``path/uv/batch-N`` with
    (window_end, seq, uv).
    """

    def number(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            earlier = spark.createDataFrame([], _TOTALS)
        else:
            earlier = spark.read.schema(_TOTALS).parquet(f"{path}/totals/batch-{batch_id - 1}")
        rows = ordered(batch, ["window_end"], ["seq"], chunk_rows)
        counted = rows.running({"n": ("count", F.lit(1))}).result()
        reached = earlier.select("window_end", F.col("total").alias("__reached"))
        counted.join(reached, "window_end", "left").select(
            "window_end", "seq", (F.col("n") + F.coalesce("__reached", F.lit(0))).alias("uv")
        ).write.mode("overwrite").parquet(f"{path}/uv/batch-{batch_id}")
        new = spark.read.schema("window_end TIMESTAMP").parquet(f"{path}/uv/batch-{batch_id}")
        new = new.groupBy("window_end").agg(F.count(F.lit(1)).alias("total"))
        totals = earlier.unionByName(new).groupBy("window_end").agg(F.sum("total").alias("total"))
        newest = totals.agg(F.max(F.unix_micros("window_end"))).first()[0]
        if newest is not None:
            totals = totals.where(F.unix_micros("window_end") > newest - micros(keep))
        totals.write.mode("overwrite").parquet(f"{path}/totals/batch-{batch_id}")

    return number
