"""Keyed upserts: the last write per key wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The newest row per key; partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("__row"))
    return newest.select(*keys, *[f"__row.{c}" for c in rest])


def merge_latest(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` after an upsert of ``updates``, which has one row per key."""
    kept = target.join(updates.select(*keys), keys, "left_anti")
    return kept.unionByName(updates.select(*target.columns))


def hash_entries(df: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    """(field, value) text pairs for a keyed hash: the newest value per key."""
    newest = latest_per_key(df.select(key, value, seq), [key], seq)
    return newest.select(
        F.col(key).cast("string").alias("field"), F.col(value).cast("string").alias("value")
    )


def upsert_batches(
    write: Callable[[DataFrame], None], keys: list[str], seq: str = "seq"
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function handing ``write`` the newest row per key of each batch.

    ``write`` upserts by key, so a replayed batch leaves the same result.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write(latest_per_key(batch, keys, seq))

    return run


def upsert_statements(table: str, staging: str, keys: list[str], values: list[str]) -> list[str]:
    """Set-based upsert from a staging table: update rows that exist, insert the others."""

    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    same = " AND ".join(f"s.{quoted(k)} = {table}.{quoted(k)}" for k in keys)
    sets = ", ".join(
        f"{quoted(v)} = (SELECT s.{quoted(v)} FROM {staging} s WHERE {same})" for v in values
    )
    columns = ", ".join(quoted(c) for c in [*keys, *values])
    picked = ", ".join(f"s.{quoted(c)}" for c in [*keys, *values])
    return [
        f"UPDATE {table} SET {sets} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same})",
        f"INSERT INTO {table} ({columns}) SELECT {picked} FROM {staging} s "
        f"WHERE NOT EXISTS (SELECT 1 FROM {table} WHERE {same})",
    ]


def jdbc_upsert(
    url: str, table: str, staging: str, keys: list[str], values: list[str], **properties: str
) -> Callable[[DataFrame], None]:
    """Writer for `upsert_batches`: executors fill a staging table, one transaction merges it."""

    def write(rows: DataFrame) -> None:
        rows.select(*keys, *values).write.mode("overwrite").jdbc(
            url, staging, properties=properties
        )
        _execute(rows.sparkSession, url, upsert_statements(table, staging, keys, values), properties)

    return write


def _execute(
    spark: SparkSession, url: str, statements: list[str], properties: dict[str, str]
) -> None:
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for name, value in properties.items():
        settings.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for sql in statements:
            statement.executeUpdate(sql)
        connection.commit()
    finally:
        connection.close()
