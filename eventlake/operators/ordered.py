"""Keyed operators that depend on row order, safe for keys of any size.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. `ordered` first counts rows per
key. Where no key has more than ``chunk_rows`` rows, that plain window is what is used. Otherwise
the hot keys are cut along their order into chunks, each chunk is one window partition, and what a
chunk needs from the rows before it is carried over from small tables:

* `OrderedRows.running` adds the totals of all earlier chunks to the chunk-local aggregate;
* `OrderedRows.framed` repeats the last ``n`` rows before a chunk inside it while a frame of ``n``
  preceding rows is computed.

Chunks are ranges of nearly equal size: the hot keys' positions are range-partitioned once, and the
borders are kept, so a burst or an outlier makes no chunk large (rows of one key at one instant stay
together). There are at most ``rows / chunk_rows`` ranges, and one more for each hot key; borders
and chunk totals are that many. Borders go to the tasks; totals are written to shared storage and
joined. The leading order column is an integer or a timestamp.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from eventlake.session import shared_dir

CHUNK = "__chunk"
_CARRIED = "__carried"
DEFAULT_CHUNK_ROWS = 1_000_000

_LOCAL = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_MERGE = _LOCAL | {"count": F.sum}


def written(df: DataFrame, purpose: str) -> DataFrame:
    """A small result as a table in the shared folder, cut off from its lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _position(df: DataFrame, order: list[str]) -> Column:
    """The leading order column as a number to cut along."""
    kind = dict(df.dtypes)[order[0]]
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(order[0]).cast("timestamp"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(order[0]).cast("bigint")
    raise ValueError(f"order column {order[0]!r} must be an integer or timestamp, not {kind}")


@dataclass(frozen=True)
class OrderedRows:
    """Rows with their keys and order; ``cut`` says whether hot keys are cut into chunks."""

    df: DataFrame
    keys: list[str]
    order: list[str]
    cut: bool

    @property
    def partition(self) -> list[str]:
        return [*self.keys, CHUNK] if self.cut else self.keys

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> OrderedRows:
        """Rows changed one by one; keys, order and chunk columns have to stay."""
        return replace(self, df=change(self.df))

    def hot(self) -> DataFrame:
        """Rows of the keys that are cut."""
        return self.df.where(F.col(CHUNK).isNotNull())

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)

    def join_chunks(self, carry: DataFrame, df: DataFrame | None = None) -> DataFrame:
        """Left join of one small row per chunk, keyed by ``__c_<key>`` and ``__c_chunk``."""
        pairs = [F.col(k).eqNullSafe(F.col(f"__c_{k}")) for k in self.keys]
        match = reduce(lambda a, b: a & b, pairs, F.col(CHUNK) == F.col("__c_chunk"))
        left = self.df if df is None else df
        return left.join(carry, match, "left")

    def chunk_keys(self) -> list[Column]:
        return [
            *[F.col(k).alias(f"__c_{k}") for k in self.keys],
            F.col(CHUNK).alias("__c_chunk"),
        ]

    def running(
        self, aggs: dict[str, tuple[str, Column]], include_current: bool = True
    ) -> OrderedRows:
        """Add running aggregates: output column → (``sum|count|max|min``, expression).

        With ``include_current=False`` they cover the rows strictly before the current one.
        """
        frame = self.window.rowsBetween(
            Window.unboundedPreceding, 0 if include_current else -1
        )
        if not self.cut:
            return self.map(
                lambda df: df.select(
                    "*", *[_LOCAL[fn](e).over(frame).alias(o) for o, (fn, e) in aggs.items()]
                )
            )
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy(CHUNK)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        totals = (
            self.hot()
            .groupBy(*self.partition)
            .agg(*[_LOCAL[fn](e).alias(o) for o, (fn, e) in aggs.items()])
        )
        carry = written(
            totals.select(
                *self.chunk_keys(),
                *[
                    _MERGE[fn](o).over(earlier).alias(f"__c_{o}")
                    for o, (fn, _) in aggs.items()
                ],
            ),
            "chunk-totals",
        )
        local = self.df.select(
            "*",
            *[_LOCAL[fn](e).over(frame).alias(f"__l_{o}") for o, (fn, e) in aggs.items()],
        )
        merged = self.join_chunks(carry, local).select(
            *self.df.columns, *[_merged(o, fn).alias(o) for o, (fn, _) in aggs.items()]
        )
        return replace(self, df=merged)

    def framed(self, n: int, columns: Callable[[WindowSpec], dict[str, Column]]) -> OrderedRows:
        """Add columns that look at the current row and up to ``n`` rows before it.

        ``columns`` gets the ordered window and returns windowed expressions, e.g. a lag or an
        aggregate over ``rowsBetween(-n, 0)``.
        """
        new = [c.alias(name) for name, c in columns(self.window).items()]
        if not self.cut:
            return self.map(lambda df: df.select("*", *new))
        by_chunk = Window.partitionBy(*self.partition).orderBy(
            *[F.col(o).desc() for o in self.order]
        )
        latest = F.row_number().over(by_chunk)
        tails = self.hot().withColumn("__rank", latest).where(F.col("__rank") <= n)
        # A chunk may hold fewer than n rows, so a tail is offered to the next n chunks.
        following = Window.partitionBy(*self.keys).orderBy(CHUNK).rowsBetween(1, n)
        successors = tails.where(F.col("__rank") == 1).select(
            *self.chunk_keys(), F.collect_list(CHUNK).over(following).alias("__next")
        )
        carried = written(
            self.join_chunks(successors, tails)
            .withColumn(CHUNK, F.explode("__next"))
            .withColumn("__rank", latest)
            .where(F.col("__rank") <= n)
            .select(*self.df.columns, F.lit(True).alias(_CARRIED)),
            "chunk-tails",
        )
        rows = self.df.withColumn(_CARRIED, F.lit(False)).unionByName(carried)
        framed = rows.select("*", *new).where(~F.col(_CARRIED)).drop(_CARRIED)
        return replace(self, df=framed)


def _merged(out: str, fn: str) -> Column:
    local, carried = F.col(f"__l_{out}"), F.col(f"__c_{out}")
    if fn == "max":
        return F.greatest(local, carried)
    if fn == "min":
        return F.least(local, carried)
    if fn == "count":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return F.coalesce(local + carried, local, carried)


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> OrderedRows:
    """Rows to be handled per key in order; without keys the input is one sequence.

    Runs one aggregate over the key columns to find keys above ``chunk_rows`` rows; keys that share a
    64-bit hash are cut alike.
    """
    position = F.coalesce(_position(df, order), F.lit(-(1 << 63)).cast("bigint"))
    named = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    narrow = df.select(named.alias("__key"), position.alias("__at"))
    sizes = narrow.groupBy("__key").agg(F.count(F.lit(1)).alias("__rows"))
    hot = written(sizes.where(F.col("__rows") > chunk_rows), "hot-keys")
    rows = hot.agg(F.sum("__rows")).first()[0]
    if rows is None:
        return OrderedRows(df, keys, order, cut=False)
    # Ranges of nearly equal size by key and position; their borders are drawn once and kept.
    ranges = (
        narrow.join(hot.select("__key"), "__key", "left_semi")
        .repartitionByRange(-(-rows // chunk_rows), "__key", "__at")
        .groupBy("__key", F.spark_partition_id().alias("__range"))
        .agg(F.min("__at").alias("__from"))
    )
    borders: dict[int, list[int]] = {}
    for row in written(ranges.select("__key", "__from"), "chunk-borders").collect():
        borders.setdefault(row["__key"], []).append(row["__from"])
    cuts = {key: np.array(sorted(found), dtype=np.int64) for key, found in borders.items()}

    @F.pandas_udf("bigint")
    def chunk_of(key: pd.Series, at: pd.Series) -> pd.Series:
        """The chunk of a row, None for keys small enough to stay whole."""
        keys_, ats = key.to_numpy(np.int64), at.to_numpy(np.int64)
        found = np.full(len(keys_), -1, dtype=np.int64)
        for one in np.unique(keys_).tolist():
            if one in cuts:
                mine = keys_ == one
                found[mine] = np.maximum(0, np.searchsorted(cuts[one], ats[mine], "right") - 1)
        return pd.Series(found, dtype="Int64").mask(found < 0)

    return OrderedRows(df.withColumn(CHUNK, chunk_of(named, position)), keys, order, cut=True)
