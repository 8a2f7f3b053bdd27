"""Line files and CSV tables, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column ``line``."""
    return spark.read.text(path).select(F.col("value").alias("line"))


def text_lines_stream(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Lines of the files in a folder or glob as a stream."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path).select(F.col("value").alias("line"))


def csv_table(
    spark: SparkSession, path: str, schema: str, view: str | None = None
) -> DataFrame:
    """Headerless CSV with a declared schema; a bad number fails the job."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").csv(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def csv_table_stream(
    spark: SparkSession, path: str, schema: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(path)


def records(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A handful of literal records, for tests and lookups."""
    return spark.createDataFrame(rows, schema)
