"""Raw-zone ingest: envelopes from topics become lines under meta-derived lake paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.jsonmeta import (
    data_pair,
    entries_path,
    read_envelopes,
    with_meta_entries,
)

# Sub-paths hidden from scans of the lake root (fixed values).
META_SUB_PATH = ".meta"
ERROR_SUB_PATH = ".error"
LAKE_ZONE = "Asia/Shanghai"


def route_envelopes(values: DataFrame) -> DataFrame:
    """(topic, value) → (path, topic, data, entries).

    A good envelope gives its data under the meta path and its meta under ``.meta``; anything
    else gives the whole value under ``.error/<topic>``. ``entries`` holds the path's parts as
    array<struct<key, value>> and is empty for the two hidden paths. Other columns are kept.
    """
    rest = [c for c in values.columns if c not in ("topic", "value")]
    parsed = with_meta_entries(read_envelopes(values), out="__m")
    pairs = F.transform(
        "__m", lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))
    )
    no_pairs = F.array().cast("array<struct<key:string,value:string>>")

    def target(path: Column, data: Column, entries: Column) -> Column:
        return F.struct(path.alias("path"), data.alias("data"), entries.alias("entries"))

    good = F.array(
        target(
            entries_path(F.col("__m")),
            data_pair(F.col("data"), F.col("extra_data")),
            pairs,
        ),
        target(F.lit(META_SUB_PATH), data_pair(F.col("meta"), F.lit("")), no_pairs),
    )
    bad = F.array(
        target(
            F.concat(F.lit(f"{ERROR_SUB_PATH}/"), F.col("topic")),
            data_pair(F.col("value"), F.lit("")),
            no_pairs,
        )
    )
    return parsed.select(
        *rest,
        "topic",
        F.explode(F.when(F.col("__m").isNotNull(), good).otherwise(bad)).alias("__t"),
    ).select("__t.path", "topic", "__t.data", "__t.entries", *rest)


def bucket_date(at: Column, zone: str = LAKE_ZONE, date_format: str = "yyyy-MM-dd") -> Column:
    """Date part of a lake bucket, in the lake's own zone."""
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), at.cast("timestamp_ntz"))
    return F.date_format(local, date_format)


def bucketed(routed: DataFrame, at: Column | None = None, **kwargs) -> DataFrame:
    """Add ``dt``, from ``at`` or the clock of the run, and ``bucket``, the full sub-path."""
    dt = bucket_date(F.current_timestamp() if at is None else at, **kwargs)
    return routed.withColumn("dt", dt).withColumn(
        "bucket", F.concat_ws("/", F.nullif("path", F.lit("")), "dt")
    )
