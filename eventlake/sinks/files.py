"""CSV file sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path)


def stream_to_csv(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only stream; the sink log makes it exactly-once across restarts."""
    return (
        df.writeStream.format("csv")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def write_branches(df: DataFrame, path: str, branch: str = "branch", mode: str = "errorifexists") -> None:
    """Rows tagged with their branch, in one pass over ``df``: a folder ``branch=<name>`` for each."""
    df.write.mode(mode).partitionBy(branch).parquet(path)


def read_branch(df: DataFrame, path: str, name: str, branch: str = "branch") -> DataFrame:
    """The rows of one branch that `write_branches` wrote of ``df``, without the tag; reads its folder only."""
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    return found.where(F.col(branch) == name).select(*[c for c in df.columns if c != branch])
