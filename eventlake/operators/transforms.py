"""Routing, connecting and redistributing streams; all work on batch and stream input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.text import split_dropping_tail

# Page views are requests for anything but these assets (fixed pattern).
PAGE_URL_PATTERN = r"^((?!\.(css|js|png|ico)$).)*$"


def map_length(lines: DataFrame, column: str = "line") -> DataFrame:
    """Length of each line in UTF-16 units."""
    units = F.length(F.encode(F.col(column), "UTF-16BE")) / 2
    return lines.select(units.cast("int").alias("length"))


def flat_map_split(lines: DataFrame, column: str = "line", separator: str = ",") -> DataFrame:
    return lines.select(F.explode(split_dropping_tail(F.col(column), separator)).alias("token"))


def filter_prefix(lines: DataFrame, prefix: str, column: str = "line") -> DataFrame:
    return lines.where(F.col(column).startswith(prefix))


def keep(df: DataFrame, predicate: Column, ts: str = "event_time") -> DataFrame:
    """Filter that leaves a stream's watermark alone.

    Catalyst moves a filter below the watermark unless it uses the event time, and rows dropped
    there no longer advance it. On streams the predicate is therefore tied to the event time;
    on batch input it stays plain and reaches the scan.
    """
    if df.isStreaming:
        return df.where(F.when(F.col(ts).isNotNull(), predicate))
    return df.where(predicate)


def page_request() -> Column:
    """Whether a request is a GET for a page, not for a static asset."""
    return (F.col("method") == "GET") & F.col("url").rlike(PAGE_URL_PATTERN)


def page_requests(log: DataFrame) -> DataFrame:
    """GET requests for pages, static assets left out."""
    return keep(log, page_request())


def route(df: DataFrame, branches: dict[str, Column]) -> dict[str, DataFrame]:
    """One DataFrame per named predicate; a row may satisfy several."""
    return {name: df.where(predicate) for name, predicate in branches.items()}


def tagged(df: DataFrame, branches: dict[str, Column], out: str = "branch") -> DataFrame:
    """Every row once for each predicate it satisfies, with the predicate's name in ``out``; one scan for all.

    Written with `eventlake.sinks.files.write_branches`, the branches are outputs of their own.
    """
    names = [F.when(predicate, F.lit(name)) for name, predicate in branches.items()]
    return df.select("*", F.explode(F.array_compact(F.array(*names))).alias(out))


def split_by(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(rows satisfying the predicate, all others); NULL counts as not satisfying."""
    holds = F.coalesce(predicate, F.lit(False))
    return df.where(holds), df.where(~holds)


def connect(
    left: DataFrame, right: DataFrame, left_map: list[Column], right_map: list[Column]
) -> DataFrame:
    """Two differently typed inputs, each mapped on its own, as one; absent columns are NULL."""
    return left.select(*left_map).unionByName(
        right.select(*right_map), allowMissingColumns=True
    )


def union_all(*inputs: DataFrame) -> DataFrame:
    """Bag union of same-typed inputs."""
    return reduce(DataFrame.unionByName, inputs)


def rebalance(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Even round-robin distribution; without a number AQE chooses the partition size."""
    return df.repartition(partitions) if partitions else df.hint("rebalance")


def partition_by_key(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Hash distribution on the keys."""
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def global_order(df: DataFrame, *order: str) -> DataFrame:
    """One sequence over all partitions: range-partitioned and sorted, never a single task."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def with_partition_id(df: DataFrame, out: str = "partition_id") -> DataFrame:
    """The index of the task that handles each row."""
    return df.withColumn(out, F.spark_partition_id())
