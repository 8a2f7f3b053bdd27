"""User-defined functions: scalar, aggregate and table forms, callable from SQL too."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlake.functions.hashing import string_hash
from eventlake.functions.text import split_dropping_tail

DEFAULT_HASH_ADDEND = 13


def hash_code(text: Column, addend: int = DEFAULT_HASH_ADDEND) -> Column:
    """Scalar function: string hash plus a factor, entirely JVM-side."""
    return string_hash(text, addend)


def avg_temp(value: Column) -> Column:
    """Aggregate function (sum, count) → mean; partial aggregation on the map side."""
    return F.sum(value) / F.count(value)


def avg_temp_sql(value: str) -> str:
    """`avg_temp` of a SQL expression, to be put into a statement.

    A function registered by name can't hold aggregates, and a grouped pandas function would see a
    whole group in one task; as text the aggregate stays partial.
    """
    return f"sum({value}) / count({value})"


def split_words(text: Column, separator: str = "_") -> Column:
    """Table function body: array<struct<word, length>> of the pieces of ``text``."""
    return F.transform(
        split_dropping_tail(text, separator),
        lambda w: F.struct(w.alias("word"), F.length(w).alias("length")),
    )


@F.udtf(
    returnType=T.StructType().add("word", T.StringType()).add("length", T.IntegerType())
)
class SplitWords:
    """The table function for SQL ``LATERAL`` with a separator argument."""

    def eval(self, text: str, separator: str) -> Iterator[tuple[str, int]]:
        if text is None:
            return
        pieces = text.split(separator)
        if text:
            while pieces and not pieces[-1]:
                pieces.pop()
        for piece in pieces:
            yield piece, len(piece)


def register(spark: SparkSession) -> None:
    """Make the table function callable by name in ``spark.sql``; aggregates have `avg_temp_sql`."""
    spark.udtf.register("split_words", SplitWords)
