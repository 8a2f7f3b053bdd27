"""JSON envelopes: required fields, the priority-ordered sub-path, the output pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names of the envelope and of its meta entries (fixed values).
DATA_FIELD = "data"
META_FIELD = "meta"
EXTRA_FIELD = "extra_data"
ENVELOPE_FIELDS = [DATA_FIELD, META_FIELD, EXTRA_FIELD]
META_ENTRIES = "map<string,struct<priority:string,value:string>>"


def read_envelopes(df: DataFrame, column: str = "value") -> DataFrame:
    """Add data, meta and extra_data as text, parsing each value once.

    All three are NULL when one of them is missing or null, or the value is no JSON object.
    """
    parsed = df.select("*", F.json_tuple(column, *ENVELOPE_FIELDS).alias(*ENVELOPE_FIELDS))
    complete = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in ENVELOPE_FIELDS])
    return parsed.select(
        *df.columns, *[F.when(complete, F.col(f)).alias(f) for f in ENVELOPE_FIELDS]
    )


def with_meta_entries(df: DataFrame, meta: str = META_FIELD, out: str = "entries") -> DataFrame:
    """Add meta entries in path order as array<struct<neg_priority, pair, key, value>>.

    Higher priority first, then ``key=value`` ascending. NULL when the text is no JSON object
    or an entry lacks an integer priority or a value.
    """

    def entry(e: Column) -> Column:
        text, value = e["value"]["priority"], e["value"]["value"]
        priority = F.when(text.rlike(r"^[+-]?0*\d{1,10}$"), text.try_cast("int"))
        return F.struct(
            (-priority.cast("bigint")).alias("neg_priority"),
            F.concat(e["key"], F.lit("="), value).alias("pair"),
            e["key"].alias("key"),
            value.alias("value"),
        )

    # Two steps, so that the parsed entries are a column and not parsed again per use.
    raw = F.map_entries(F.from_json(meta, META_ENTRIES))
    parsed = df.withColumn("__entries", F.transform(raw, entry))
    valid = F.forall(
        "__entries", lambda e: e["neg_priority"].isNotNull() & e["pair"].isNotNull()
    )
    return parsed.withColumn(out, F.when(valid, F.array_sort("__entries"))).drop("__entries")


def entries_path(entries: Column) -> Column:
    """Sub-path such as ``b=7/a=x``; empty for no entries, NULL for bad meta."""
    return F.array_join(F.transform(entries, lambda e: e["pair"]), "/")


def data_pair(data: Column, extra: Column) -> Column:
    """``{"data": ..., "extraData": ...}`` with both payloads as JSON strings."""
    return F.to_json(F.struct(data.alias("data"), extra.alias("extraData")))
