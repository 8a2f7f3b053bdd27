"""Running a stream over what is available now and reading its result back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.session import ROCKSDB_PROVIDER, shared_dir

_PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Use the RocksDB state store for queries started inside."""
    before = spark.conf.get(_PROVIDER_CONF, None)
    spark.conf.set(_PROVIDER_CONF, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER_CONF)
        else:
            spark.conf.set(_PROVIDER_CONF, before)


def drain(
    stream: DataFrame, path: str | None = None, checkpoint: str | None = None
) -> DataFrame:
    """Run an append-mode stream to the end of its input into a Parquet folder and read it.

    The file sink's log makes the folder exactly-once: calling again with the same ``path`` and
    ``checkpoint`` continues where the last run stopped.
    """
    spark = stream.sparkSession
    path = path or shared_dir(spark, "drain")
    checkpoint = checkpoint or shared_dir(spark, "drain-checkpoint")
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    mode: str = "append",
    checkpoint: str | None = None,
) -> int | None:
    """Run a stream to the end of its input, handing every micro-batch to ``write``.

    A batch may be handed over again after a failure, so ``write`` has to overwrite by batch id.
    Returns the last watermark in epoch micros, None where the stream has none.
    """
    spark = stream.sparkSession
    with rocksdb_state(spark):
        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint or shared_dir(spark, "batches"))
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    progress = query.lastProgress
    reached = (progress.eventTime or {}).get("watermark") if progress else None
    return int(datetime.fromisoformat(reached).timestamp() * 1000) * 1000 if reached else None


def write_batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Writer that keeps each micro-batch in its own ``batch_id=N`` folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest_update(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Newest row per key of an update-mode result kept by `write_batch_folder`."""
    updates = spark.read.schema(f"{schema}, batch_id BIGINT").parquet(path)
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    newest = updates.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "batch_id").alias("__row")
    )
    return newest.select(*keys, *[f"__row.{c}" for c in rest])
