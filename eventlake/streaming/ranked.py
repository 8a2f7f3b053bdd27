"""The changelog of a ranked result on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.functions.times import micros
from eventlake.operators.changelog import state_changes
from eventlake.operators.topn import top_n
from eventlake.operators.windows import tumbling_count
from eventlake.session import shared_dir
from eventlake.streaming.run import drain_batches


class RankedChanges:
    """``foreachBatch`` work: changed counts in, changes of every window's top ``n`` out.

    The input is (window_end, key, count) in update mode: counts that grew in this micro-batch. As counts only
    grow, what is new in a window's top ``n`` is either among them or was in it before, so all
    that a batch leaves to the next is the ranking of each window still open: at most ``n`` rows. Windows that
    ended more than ``keep`` before the newest one are closed.

    Under ``path/changes``: (op, window_end, rank, key, count), a folder ``batch_id=N`` for each micro-batch. A batch
    that is handed over again replaces itself.
    """

    def __init__(self, path: str, key: str, kind: str, n: int, keep: str):
        self.path, self.key, self.n, self.keep = path, key, n, micros(keep)
        self.schema = f"window_end TIMESTAMP, rank INT, `{key}` {kind}, count BIGINT"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, key = batch.sparkSession, self.key
        columns = ["window_end", "rank", key, "count"]
        if batch_id == 0:
            before = spark.createDataFrame([], self.schema)
        else:
            before = spark.read.schema(self.schema).parquet(f"{self.path}/state/batch-{batch_id - 1}")
        folder = f"{self.path}/changed/batch-{batch_id}"
        batch.select("window_end", key, "count").write.mode("overwrite").parquet(folder)
        changed = spark.read.schema(batch.select("window_end", key, "count").schema).parquet(folder)
        windows = changed.select("window_end").distinct()
        touched = before.join(windows, "window_end", "left_semi")
        standing = touched.alias("s").join(
            changed.alias("c"),
            (F.col("s.window_end") == F.col("c.window_end")) & F.col(f"s.{key}").eqNullSafe(F.col(f"c.{key}")),
            "left_anti",
        )
        ranked = top_n(
            standing.select("window_end", key, "count").unionByName(changed), ["window_end"], "count", self.n, [key]
        ).select(*columns)
        ranked.write.mode("overwrite").parquet(f"{self.path}/ranked/batch-{batch_id}")
        after = spark.read.schema(self.schema).parquet(f"{self.path}/ranked/batch-{batch_id}")
        state_changes(touched, after, ["window_end", "rank"]).write.mode("overwrite").parquet(
            f"{self.path}/changes/batch_id={batch_id}"
        )
        newest = windows.agg(F.max(F.unix_micros("window_end"))).first()[0]
        state = before.join(windows, "window_end", "left_anti").unionByName(after)
        if newest is not None:
            state = state.where(F.unix_micros("window_end") > newest - self.keep)
        state.write.mode("overwrite").parquet(f"{self.path}/state/batch-{batch_id}")


def drain_ranked_changes(
    rows: DataFrame, key: str, n: int = 5, size: str = "6 hours", keep: str = "6 hours", path: str | None = None
) -> DataFrame:
    """(batch_id, op, window_end, rank, key, count): how the top ``n`` of tumbling windows change.

    Set the watermark first; ``keep`` is to be at least the window and the watermark's delay. Equal counts
    rank by key.
    """
    spark = rows.sparkSession
    path = path or shared_dir(spark, "ranked-changes")
    kind = dict(rows.dtypes)[key]
    counts = tumbling_count(rows, size, [key]).select("window_end", key, "count")
    changes = RankedChanges(path, key, kind, n, keep)
    drain_batches(counts, changes, mode="update")
    found = spark.read.schema(f"op STRING, {changes.schema}, batch_id BIGINT").parquet(f"{path}/changes")
    return found.select("batch_id", "op", "window_end", "rank", key, "count")
