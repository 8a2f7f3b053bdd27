"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.session import shared_dir

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# An Arrow batch is held several times over, in a JVM outside its heap and in its Python worker.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHUFFLE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Keys of at most so many rows (8 bytes each) are broadcast to filter a table; more are joined by a shuffle.
SENT_KEYS = 2_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """What runs meanwhile hands Python batches of about ``most`` bytes, not of so many rows whatever their size."""
    before = spark.conf.get(_BATCH_CONF)
    number = before.lower().rstrip("bkmg")
    size = int(number) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(before.lower().rstrip("b")[-1], 1)
    spark.conf.set(_BATCH_CONF, min(size, most))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile gives up its shuffle files as soon as it is written."""
    before = spark.conf.get(_SHUFFLE_CONF, None)
    spark.conf.set(_SHUFFLE_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CONF)
        else:
            spark.conf.set(_SHUFFLE_CONF, before)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut and every later read sees the same rows.

    Nothing else reads the shuffles of that job, so their files go with its end and not at some later collection.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{purpose}")
    with small_batches(spark), passing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def among(df: DataFrame, keys: DataFrame, how: str = "left_semi", most: int | None = None) -> DataFrame:
    """``df`` joined with the rows of ``keys`` by all columns that both have; in place if the keys are few.

    ``keys`` is a written table, as it is counted first.
    """
    few = keys.count() <= (SENT_KEYS if most is None else most)
    return df.join(F.broadcast(keys) if few else keys, [c for c in keys.columns if c in df.columns], how)


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def seeded_unit(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def text_blocks(
    batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text"
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their texts come to about ``most_bytes`` (a longer text stands alone)."""
    for batch in batches:
        lengths = pa.compute.fill_null(
            pa.compute.binary_length(batch.column(column)), 0
        ).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def over_texts(
    df: DataFrame, columns: list[Column], work: Callable, schema: str, most_bytes: int = 4 << 20
) -> DataFrame:
    """``work`` on Arrow blocks of the columns, one of which is called text; ``work`` yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(text_blocks(batches, most_bytes))

    return df.select(*columns).mapInArrow(run, schema)
