"""Payloads for message topics; the connector jar is the deployment's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def record_text(name: str, columns: dict[str, str]) -> Column:
    """``Name{id='a', timestamp=1, temperature=2.0}`` (fixed format); columns maps name to type."""
    parts: list[Column] = []
    for i, (column, kind) in enumerate(columns.items()):
        quote = "'" if kind == "string" else ""
        parts.append(F.lit(f"{', ' if i else ''}{column}={quote}"))
        parts.append(F.col(column).cast("string"))
        parts.append(F.lit(quote))
    return F.concat(F.lit(f"{name}{{"), *parts, F.lit("}"))


def csv_values(df: DataFrame) -> DataFrame:
    """All columns as one CSV line, column ``value``."""
    return df.select(F.to_csv(F.struct(*df.columns)).alias("value"))


def text_values(df: DataFrame, name: str) -> DataFrame:
    """All columns as record text, column ``value``."""
    return df.select(record_text(name, dict(df.dtypes)).alias("value"))


def write_topic(values: DataFrame, servers: str, topic: str) -> None:
    """Batch write of a ``value`` column to a topic."""
    values.write.format("kafka").option("kafka.bootstrap.servers", servers).option(
        "topic", topic
    ).save()


def stream_to_topic(
    values: DataFrame, servers: str, topic: str, checkpoint: str
) -> StreamingQuery:
    return (
        values.writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )
