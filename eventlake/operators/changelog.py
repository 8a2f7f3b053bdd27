"""Changelog of a keyed aggregate: what a retracting sink would be told."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.operators.ordered import DEFAULT_CHUNK_ROWS, ordered


def retract_changelog(
    df: DataFrame,
    key: str,
    value: Column,
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """For each input row ``-`` the key's previous (count, sum) if any, then ``+`` the new one."""
    rows = ordered(df.select(key, seq, value.alias("__v")), [key], [seq], chunk_rows)
    totals = rows.running(
        {"count": ("count", F.lit(1)), "sum": ("sum", F.col("__v"))}
    ).result()
    previous = F.struct(
        F.lit("-").alias("op"),
        (F.col("count") - 1).alias("count"),
        (F.col("sum") - F.col("__v")).alias("sum"),
    )
    current = F.struct(F.lit("+").alias("op"), F.col("count"), F.col("sum").alias("sum"))
    changes = F.when(F.col("count") > 1, F.array(previous, current)).otherwise(
        F.array(current)
    )
    return totals.select(key, seq, F.explode(changes).alias("c")).select(
        key, seq, "c.op", "c.count", "c.sum"
    )


def state_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What turns one keyed state into another: ``-`` for rows that go or change, ``+`` for new ones.

    Both have the same columns and at most one row for each value of ``keys``. Columns: op, then theirs.
    """
    rest = [c for c in before.columns if c not in keys]
    old = before.select(*keys, F.struct(F.lit(True).alias("__there"), *rest).alias("__old"))
    new = after.select(*keys, F.struct(F.lit(True).alias("__there"), *rest).alias("__new"))
    a, b = old.alias("a"), new.alias("b")
    match = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.join(b, match, "full").where(~F.col("__old").eqNullSafe(F.col("__new")))
    named = both.select(
        *[
            F.when(F.col("__old").isNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys
        ],
        "__old",
        "__new",
    )
    signed = [F.struct(F.lit(op).alias("op"), F.col(c).alias("row")) for op, c in (("-", "__old"), ("+", "__new"))]
    changes = named.select(*keys, F.explode(F.array(*signed)).alias("c")).where(F.col("c.row").isNotNull())
    return changes.select(F.col("c.op").alias("op"), *keys, *[f"c.row.{c}" for c in rest])


def folded(changes: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """The state a log of `state_changes` leads to: of each key the newest row, unless it was taken back.

    A ``-`` comes before the ``+`` of the same step.
    """
    rest = [c for c in changes.columns if c not in (*keys, order, "op")]
    newest = F.max_by(F.struct("op", *rest), F.struct(F.col(order), F.col("op") == "+"))
    return (
        changes.groupBy(*keys)
        .agg(newest.alias("__last"))
        .where(F.col("__last.op") == "+")
        .select(*keys, *[f"__last.{c}" for c in rest])
    )
