"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its smallest node.

    Loops, repeated and reversed edges are fine; rows with a null end are ignored. Each step is a
    partial minimum per node and an equi-join, so a node with very many edges is split like any
    skewed join. Every step is written to the shared folder, which cuts the lineage.
    """
    now = written(_down(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    before = None
    for _ in range(rounds):
        state = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == before or not state[0]:
            break
        before = state
        now = written(_large_star(now), "components")
        now = written(_small_star(now), "components")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        now.select("v", "v").distinct()
    )


def _down(edges: DataFrame) -> DataFrame:
    return (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where(F.col("v") > F.col("u"))
    return _down(larger.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(rest.union(lowest.select("u", F.col("m").alias("v"))))
