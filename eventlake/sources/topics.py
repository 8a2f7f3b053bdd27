"""Message topics. The connector jar is the deployment's; payload handling is here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_options(
    servers: str,
    topic: str | None = None,
    pattern: str | None = None,
    starting_offsets: str = "latest",
    discovery_interval_ms: int | None = None,
    extra: dict[str, str] | None = None,
) -> dict[str, str]:
    """Reader options for one topic or for every topic matching a regex."""
    if (topic is None) == (pattern is None):
        raise ValueError("give exactly one of topic and pattern")
    options = {
        "kafka.bootstrap.servers": servers,
        "startingOffsets": starting_offsets,
    }
    if topic is not None:
        options["subscribe"] = topic
    else:
        options["subscribePattern"] = pattern
    if discovery_interval_ms is not None:
        options["kafka.metadata.max.age.ms"] = str(discovery_interval_ms)
    return options | (extra or {})


def topic_stream(spark: SparkSession, **kwargs) -> DataFrame:
    """Stream of raw topic records; see `topic_options` for the arguments."""
    return spark.readStream.format("kafka").options(**topic_options(**kwargs)).load()


def topic_values(records: DataFrame) -> DataFrame:
    """Raw topic records → (topic, value) as text."""
    return records.select("topic", F.col("value").cast("string").alias("value"))


def csv_payload(records: DataFrame, schema: str) -> DataFrame:
    """Raw topic records whose value is one CSV line → typed columns; bad lines fail."""
    parsed = F.from_csv(
        F.col("value").cast("string"), F.lit(schema), {"mode": "FAILFAST"}
    )
    return records.select(parsed.alias("r")).select("r.*")
