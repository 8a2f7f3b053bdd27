"""Documents for a search index: every field as text, no id, so every write appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``fields`` maps document field to column; one JSON ``document`` per row."""
    texts = [F.col(column).cast("string").alias(name) for name, column in fields.items()]
    return df.select(F.to_json(F.struct(*texts)).alias("document"))
