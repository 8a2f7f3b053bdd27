"""Ranked top-N per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    df: DataFrame, group: list[str], by: str, n: int, ties: list[str], out: str = "rank"
) -> DataFrame:
    """The ``n`` rows with the largest ``by`` per group, ranked from 1.

    Equal values rank by ``ties`` ascending. Catalyst limits every task to ``n`` rows per group
    before the shuffle, so a group of any size costs ``n`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(F.col(by).desc(), *ties)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
