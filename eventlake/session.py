"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Needed by every stateful operator that keeps more than one value per key.
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def builder(app: str = "eventlake") -> SparkSession.Builder:
    """Session builder with the settings the library relies on.

    Nothing about cluster size is set here: executors, memory and shuffle partitions are the
    deployment's business. AQE coalesces small shuffles and splits skewed join partitions.
    """
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder all executors share (``spark.checkpoint.dir``).

    Only on a local master (unit tests) is a local folder made and set where none is named.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="eventlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/eventlake/{purpose}-{uuid.uuid4().hex}"
