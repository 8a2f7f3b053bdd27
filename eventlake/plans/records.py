"""The jobs' record types derived from the ``events``, ``nation`` and ``pages`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ["search", "mail", "partner"]


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def with_times(events: DataFrame) -> DataFrame:
    """``ts`` as a TIMESTAMP called ``event_time`` and ``event_id`` as arrival number ``seq``."""
    return events.withColumn("event_time", F.col("ts").cast("timestamp")).withColumn(
        "seq", F.col("event_id")
    )


def sensor_readings(events: DataFrame) -> DataFrame:
    return with_times(events).select(
        "seq", F.col("user_id").alias("id"), "event_time", F.col("value").alias("temperature")
    )


def exact_readings(events: DataFrame) -> DataFrame:
    """Readings with two-decimal temperatures, whose sums do not depend on row order."""
    return sensor_readings(events).withColumn(
        "temperature", F.col("temperature").cast("decimal(12,2)")
    )


def epoch_seconds() -> Column:
    return F.unix_seconds(F.col("ts").cast("timestamp"))


def keyed_readings(events: DataFrame) -> DataFrame:
    """(id, timestamp, temperature) with text ids and epoch seconds, as in the line files."""
    return events.select(
        F.concat(F.lit("sensor_"), F.col("user_id").cast("string")).alias("id"),
        epoch_seconds().alias("timestamp"),
        F.col("value").alias("temperature"),
    )


def reading_lines(events: DataFrame) -> DataFrame:
    """The same readings as comma-separated lines."""
    columns = [F.col(c).cast("string") for c in ("id", "timestamp", "temperature")]
    return keyed_readings(events).select(F.concat_ws(",", *columns).alias("line"))


def topic_records(events: DataFrame) -> DataFrame:
    """The lines as raw topic records: (topic, value) with the value as bytes."""
    topic = F.concat(F.lit("topic"), (F.col("user_id") % 3).cast("string")).alias("topic")
    columns = [
        F.concat(F.lit("sensor_"), F.col("user_id").cast("string")),
        epoch_seconds().cast("string"),
        F.col("value").cast("string"),
    ]
    return events.select(topic, F.concat_ws(",", *columns).cast("binary").alias("value"))


def user_behaviors(events: DataFrame) -> DataFrame:
    return with_times(events).select(
        "seq",
        F.col("user_id").alias("userId"),
        prop_k().alias("itemId"),
        F.col("event_type").alias("behavior"),
        "event_time",
    )


def login_events(events: DataFrame) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "fail").otherwise("success")
    return with_times(events).select(
        "seq", F.col("user_id").alias("userId"), state.alias("loginState"), "event_time"
    )


def ad_clicks(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Clicks with the nation standing in for the province; ``nation`` has 25 rows."""
    province = F.broadcast(
        nation.select(F.col("n_nationkey").alias("__n"), F.col("n_name").alias("province"))
    )
    return (
        with_times(events)
        .join(province, F.col("user_id") % 25 == F.col("__n"))
        .select(
            "seq",
            F.col("user_id").alias("userId"),
            prop_k().alias("adId"),
            "province",
            "event_time",
        )
    )


def marketing_events(events: DataFrame) -> DataFrame:
    channels = F.array(*[F.lit(c) for c in CHANNELS])
    return with_times(events).select(
        "seq",
        F.col("user_id").alias("userId"),
        F.col("event_type").alias("behavior"),
        F.get(channels, (prop_k() % 3).cast("int")).alias("channel"),
        "event_time",
    )


def access_log_lines(events: DataFrame, pages: DataFrame) -> DataFrame:
    """(seq, line): access-log lines, some arriving minutes or hours behind their time."""
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    behind = (
        F.when(F.col("event_id") % 50 == 0, F.expr("INTERVAL 2 HOURS"))
        .when(F.col("event_id") % 50 == 25, F.expr("INTERVAL 5 MINUTES"))
        .otherwise(F.expr("INTERVAL 0 SECONDS"))
    )
    requests = events.select(
        "event_id",
        "user_id",
        (F.col("ts") - behind).alias("at"),
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        (F.col("event_id") % n_pages).alias("page_id"),
    )
    asset = F.when(F.col("event_id") % 7 == 0, "/site.css").when(
        F.col("event_id") % 7 == 1, "/site.css?x"
    )
    return requests.join(pages.select("page_id", "url"), "page_id").select(
        F.col("event_id").alias("seq"),
        F.concat_ws(
            " ",
            F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string")),
            F.col("user_id").cast("string"),
            F.lit("-"),
            F.date_format("at", "dd/MM/yyyy:HH:mm:ss"),
            F.lit("+0000"),
            "method",
            F.concat("url", F.coalesce(asset, F.lit(""))),
        ).alias("line"),
    )


def envelopes(events: DataFrame) -> DataFrame:
    """(seq, topic, value, at): raw envelopes, some malformed in each of the known ways."""
    eid = F.col("event_id")
    k = prop_k().cast("string")
    priority = F.when(eid % 23 == 0, F.lit('"high"')).otherwise((eid % 7).cast("string"))
    meta = F.when(eid % 31 == 0, F.lit("{}")).otherwise(
        F.concat(
            F.lit('{"shard":{"priority":3,"value":'),
            (prop_k() % 3).cast("string"),
            F.lit('},"type":{"priority":'),
            priority,
            F.lit(',"value":"'),
            F.col("event_type"),
            F.lit('"}}'),
        )
    )
    data = F.when(eid % 29 == 0, F.lit("null")).otherwise(
        F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit("}"))
    )
    extra = F.when(eid % 19 == 0, F.lit("")).otherwise(
        F.concat(F.lit(',"extra_data":"e'), k, F.lit('"'))
    )
    end = F.when(eid % 17 == 0, F.lit("")).otherwise(F.lit("}"))
    value = F.concat(F.lit('{"data":'), data, F.lit(',"meta":'), meta, extra, end)
    return with_times(events).select(
        "seq",
        F.concat(F.lit("topic"), (F.col("user_id") % 3).cast("string")).alias("topic"),
        value.alias("value"),
        F.col("event_time").alias("at"),
    )


def delayed_readings(events: DataFrame) -> DataFrame:
    """Exact readings where every 50th arrives two hours behind its time."""
    late = F.when(F.col("seq") % 50 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(
        F.expr("INTERVAL 0 SECONDS")
    )
    return exact_readings(events).withColumn("event_time", F.col("event_time") - late)
