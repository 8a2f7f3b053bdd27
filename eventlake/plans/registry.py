"""One callable per operator and job, each over the whole driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions import jsonmeta, times, udfs
from eventlake.operators import changelog, detect, parse, rolling, topn, transforms, windows
from eventlake.plans import ads, logins, marketing, raw_zone, traffic
from eventlake.plans import hot_items as items
from eventlake.plans import hot_pages as pages
from eventlake.plans import records as rec
from eventlake.schemas import SENSOR_READING
from eventlake.session import shared_dir
from eventlake.sinks import documents, files, lake, topics, upsert
from eventlake.sources import files as file_sources
from eventlake.sources import topics as topic_sources
from eventlake.streaming import late, processors, ranked, run, visitors
from eventlake.streaming import windows as stream_windows

Query = Callable[[SparkSession, str], DataFrame]

# 'view' plays the page view, 'error' the failed login and the kept marketing behavior.
VIEW = "view"
JUMP_THRESHOLD = 50.0
RISE_INTERVAL = "10 hours"
LOGIN_INTERVAL = "24 hours"
HOUR_US = 3_600_000_000


class _Tables:
    """The driver tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table as a stream; a glob, since a stream reads folders or globs only."""
        path = f"{self.dir}/{name[:-1]}[{name[-1]}].parquet"
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(path)

    def in_batches(self, name: str, order: str, n: int = 3, even: bool = False) -> DataFrame:
        """The table as a stream of several micro-batches, in the order of a number column.

        Every micro-batch is one whole part of the table. All parts have the same number of files,
        filled up with empty ones, and a trigger takes so many; nulls are in the first part. Parts
        are about equal in rows or, with ``even``, cover equal ranges of a whole-number column.
        """
        table = getattr(self, name)
        path = shared_dir(self.spark, f"batches-{name}")
        if even:
            low, high = table.agg(F.min(order), F.max(order)).first()
            cuts = [] if low is None else [low + (high - low + 1) * k // n - 1 for k in range(1, n)]
        else:
            cuts = table.approxQuantile(order, [k / n for k in range(1, n)], 0.01)
        bounds = [-float("inf"), *cuts, float("inf")]
        most = max(1, -(-table.rdd.getNumPartitions() // n))
        for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
            inside = (F.col(order) > low) & (F.col(order) <= high)
            part = table.where(inside | F.col(order).isNull() if k == 0 else inside)
            part.repartitionByRange(most, order).write.mode("append").parquet(path)
            files = len(self.spark.read.schema(table.schema).parquet(path).inputFiles())
            for _ in range((k + 1) * most - files):
                table.limit(0).coalesce(1).write.mode("append").parquet(path)
        return (
            self.spark.readStream.schema(table.schema)
            .option("maxFilesPerTrigger", most)
            .parquet(path)
        )


_QUERIES: dict[str, Query] = {}


def _query(build: Callable[[_Tables], DataFrame]) -> Callable[[_Tables], DataFrame]:
    _QUERIES[build.__name__] = lambda spark, sf_dir: build(_Tables(spark, sf_dir))
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Sources -------------------------------------------------------------------------------------


def _line_files(t: _Tables) -> str:
    path = shared_dir(t.spark, "lines")
    rec.reading_lines(t.events).write.text(path)
    return path


@_query
def src_text_lines(t):
    return file_sources.text_lines(t.spark, _line_files(t))


@_query
def src_text_stream(t):
    return run.drain(file_sources.text_lines_stream(t.spark, _line_files(t)))


@_query
def src_topic_value(t):
    return topic_sources.topic_values(rec.topic_records(t.events))


@_query
def src_csv_table(t):
    file_sources.csv_table(t.spark, _line_files(t), SENSOR_READING, view="input_table")
    return t.spark.table("input_table")


@_query
def src_csv_payload(t):
    return topic_sources.csv_payload(rec.topic_records(t.events), SENSOR_READING)


@_query
def parse_csv_record(t):
    return parse.csv_records(rec.reading_lines(t.events), SENSOR_READING)


def _access_log(t: _Tables) -> DataFrame:
    lines = rec.access_log_lines(t.events, t.pages)
    return parse.access_log(lines, keep=["seq"])


@_query
def parse_access_log(t):
    return _access_log(t)


@_query
def view_rename_rowtime(t):
    parse.with_event_time(rec.keyed_readings(t.events)).selectExpr(
        "id", "timestamp AS ts", "temperature AS temp", "event_time AS rt"
    ).createOrReplaceTempView("sensor")
    return t.spark.table("sensor")


# Projections, filters, scalar functions --------------------------------------------------------


@_query
def map_length(t):
    return transforms.map_length(t.documents, "text")


@_query
def flatmap_split(t):
    return transforms.flat_map_split(t.documents, "text")


@_query
def filter_prefix(t):
    return transforms.filter_prefix(rec.reading_lines(t.events), "sensor_1")


@_query
def filter_equals(t):
    return rec.user_behaviors(t.events).where(F.col("behavior") == VIEW)


@_query
def filter_static_assets(t):
    return transforms.page_requests(_access_log(t))


@_query
def table_select_filter(t):
    readings = rec.keyed_readings(t.events)
    return readings.selectExpr("id", "temperature AS temp").where("id = 'sensor_6'")


@_query
def sql_select_where(t):
    rec.keyed_readings(t.events).createOrReplaceTempView("readings")
    return t.spark.sql("SELECT id, temperature AS temp FROM readings WHERE id = 'sensor_6'")


@_query
def epoch_to_event_time(t):
    epochs = t.events.select(
        "event_id",
        rec.epoch_seconds().alias("s"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )
    return epochs.select(
        "event_id",
        times.event_time(F.col("s")).alias("from_seconds"),
        times.event_time(F.col("ms"), "millis").alias("from_millis"),
    )


@_query
def json_envelope(t):
    parsed = jsonmeta.read_envelopes(rec.envelopes(t.events))
    return parsed.where(F.col("data").isNotNull()).select("seq", *jsonmeta.ENVELOPE_FIELDS)


@_query
def json_meta_path(t):
    parsed = jsonmeta.with_meta_entries(jsonmeta.read_envelopes(rec.envelopes(t.events)))
    return parsed.select("seq", jsonmeta.entries_path(F.col("entries")).alias("path"))


@_query
def json_encode_pair(t):
    pair = jsonmeta.data_pair(F.col("event_type"), F.col("props"))
    return t.events.select("event_id", pair.alias("pair"))


# Partitioning --------------------------------------------------------------------------------


def _narrow(t: _Tables) -> DataFrame:
    return t.events.select("event_id", "user_id", "value")


@_query
def part_rebalance(t):
    return transforms.rebalance(_narrow(t))


@_query
def part_by_key(t):
    return transforms.partition_by_key(_narrow(t), "user_id")


@_query
def part_global(t):
    return transforms.global_order(_narrow(t), "event_id")


# Aggregations --------------------------------------------------------------------------------


@_query
def wordcount(t):
    return rolling.word_count(t.documents, "text")


@_query
def rolling_sum(t):
    summed = rolling.rolling_sum(rec.exact_readings(t.events), "id", F.col("temperature"))
    return summed.select("seq", "id", F.col("rolling_sum").cast("double").alias("rolling_sum"))


@_query
def rolling_max_by(t):
    return rolling.rolling_max_by(rec.sensor_readings(t.events), "id", "temperature")


@_query
def rolling_reduce(t):
    return rolling.rolling_reduce(
        rec.sensor_readings(t.events), "id", "event_time", "temperature"
    )


def _newest_and_hottest(earlier: tuple, later: tuple) -> tuple:
    return later[0], max(earlier[1], later[1])


@_query
def rolling_reduce_user(t):
    # Chunks of 2,000 rows at most, so that busy keys are folded in several.
    return rolling.rolling_reduce_user(
        rec.sensor_readings(t.events), "id", ["event_time", "temperature"], _newest_and_hottest, chunk_rows=2_000
    )


@_query
def rolling_reduce_stream(t):
    readings = rec.sensor_readings(t.in_batches("events", "event_id"))
    found = run.drain(
        processors.rolling_reduce_stream(readings, "id", "temperature", _newest_and_hottest)
    )
    return found.select(
        "id", "seq", F.timestamp_micros("at").alias("event_time"), F.col("value").alias("temperature")
    )


@_query
def group_count_avg(t):
    grouped = rolling.group_count_avg(rec.exact_readings(t.events), "id", "temperature")
    return grouped.withColumn("avg", F.col("avg").cast("double"))


# Windows -------------------------------------------------------------------------------------


@_query
def tumbling_count(t):
    return windows.tumbling_count(rec.sensor_readings(t.events), "15 seconds", ["id"])


@_query
def tumbling_full_window(t):
    counted = windows.tumbling_count(rec.sensor_readings(t.events), "15 seconds", ["id"])
    return counted.select(
        "id", F.unix_millis("window_end").alias("window_end_ms"), F.col("count").alias("size")
    )


@_query
def tumbling_min_by(t):
    return windows.tumbling_min_by(
        rec.sensor_readings(t.events), "6 hours", "id", "temperature"
    )


@_query
def count_window_avg(t):
    averaged = windows.count_window_avg(rec.exact_readings(t.events), "id", "temperature")
    return averaged.withColumn("avg", F.col("avg").cast("double"))


@_query
def sliding_count(t):
    return windows.sliding_count(
        rec.user_behaviors(t.events), "1 hour", "5 minutes", ["behavior"]
    )


def _lateness(t: _Tables) -> tuple[DataFrame, DataFrame]:
    return windows.windowed_sum_with_lateness(
        rec.delayed_readings(t.events), "15 seconds", "id", "temperature", "2 seconds", "1 minute"
    )


@_query
def window_allowed_lateness(t):
    sums, _ = _lateness(t)
    return sums.withColumn("sum", F.col("sum").cast("double"))


@_query
def late_side_output(t):
    _, late = _lateness(t)
    return late.withColumn("temperature", F.col("temperature").cast("double"))


@_query
def late_side_output_stream(t):
    readings = rec.delayed_readings(t.in_batches("events", "event_id", 4, even=True))
    path = shared_dir(t.spark, "late")
    run.drain_batches(readings, late.split_late(path, "15 seconds", "2 seconds", "1 minute"))
    found = late.split_rows(readings, path, late=True)
    return found.withColumn("temperature", F.col("temperature").cast("double"))


def _hourly(stream: DataFrame) -> DataFrame:
    return run.drain(windows.tumbling_count(stream, "1 hour", []))


@_query
def wm_ascending(t):
    return _hourly(stream_windows.ascending(rec.sensor_readings(t.stream("events"))))


@_query
def wm_bounded(t):
    readings = rec.sensor_readings(t.stream("events"))
    return _hourly(stream_windows.bounded(readings, "2 hours"))


# State, timers, several streams ----------------------------------------------------------------


@_query
def temp_jump_alert(t):
    return detect.jump_alert(
        rec.sensor_readings(t.events), "id", "temperature", JUMP_THRESHOLD
    )


@_query
def running_count_key(t):
    counted = rolling.running_count(rec.sensor_readings(t.events), "id")
    return counted.select("seq", "id", "running_count")


@_query
def running_count_all(t):
    counted = rolling.running_count(rec.sensor_readings(t.events))
    return counted.select("seq", "running_count")


@_query
def split_high_low(t):
    temperature = F.col("temperature")
    return transforms.tagged(
        rec.sensor_readings(t.events), {"high": temperature > 30, "low": temperature <= 30}
    )


@_query
def side_output_low(t):
    _, low = transforms.split_by(rec.sensor_readings(t.events), F.col("temperature") >= 30)
    return low


@_query
def retract_changelog(t):
    changes = changelog.retract_changelog(
        rec.exact_readings(t.events), "id", F.col("temperature")
    )
    return changes.withColumn("sum", F.col("sum").cast("double"))


@_query
def rise_alert(t):
    return detect.rise_alert(
        rec.sensor_readings(t.events),
        "id",
        "temperature",
        RISE_INTERVAL,
        order=("event_time", "seq"),
    )


@_query
def connect_comap(t):
    high, low = transforms.split_by(rec.sensor_readings(t.events), F.col("temperature") > 30)
    warnings = high.select("id", "temperature")
    return transforms.connect(
        warnings,
        low,
        [F.col("id"), F.col("temperature"), F.lit("high temp warning").alias("status")],
        [F.col("id"), F.lit("normal").alias("status")],
    )


@_query
def union_all(t):
    readings = rec.sensor_readings(t.events)
    high, low = transforms.split_by(readings, F.col("temperature") > 30)
    return transforms.union_all(high, low, readings)


# OVER windows, top-N, SQL windows --------------------------------------------------------------


@_query
def sql_tumble(t):
    rec.exact_readings(t.events).createOrReplaceTempView("exact_readings")
    return t.spark.sql(
        """SELECT id, count(id) AS cnt, CAST(avg(temperature) AS DOUBLE) AS avg_temp,
                  window.end AS window_end
           FROM exact_readings GROUP BY id, window(event_time, '10 seconds')"""
    )


@_query
def sql_hop(t):
    rec.user_behaviors(t.events).where(F.col("behavior") == VIEW).createOrReplaceTempView(
        "item_views"
    )
    return t.spark.sql(
        """SELECT itemId AS item_id, window.end AS window_end, count(itemId) AS cnt
           FROM item_views GROUP BY itemId, window(event_time, '1 hour', '5 minutes')"""
    )


@_query
def over_rows_count_avg(t):
    over = windows.over_rows(
        rec.exact_readings(t.events),
        "id",
        ["event_time", "seq"],
        2,
        {"cnt": F.count("id"), "avg_temp": F.avg("temperature")},
    )
    return over.select(
        "id", "event_time", "cnt", F.col("avg_temp").cast("double").alias("avg_temp")
    )


@_query
def topn_per_window(t):
    counts = windows.tumbling_count(rec.user_behaviors(t.events), "6 hours", ["itemId"])
    return topn.top_n(counts, ["window_end"], "count", 5, ["itemId"])


# Analytics jobs --------------------------------------------------------------------------------


@_query
def hot_items(t):
    return items.hot_items(rec.user_behaviors(t.events), behavior=VIEW)


@_query
def hot_items_sql(t):
    rec.user_behaviors(t.events).createOrReplaceTempView("behaviors")
    return items.hot_items_sql(t.spark, "behaviors", behavior=VIEW)


@_query
def hot_pages(t):
    return pages.hot_pages(_access_log(t))


@_query
def hot_pages_late(t):
    _, late = pages.page_counts(_access_log(t))
    return late


@_query
def page_views(t):
    return traffic.page_views(rec.user_behaviors(t.events), behavior=VIEW)


@_query
def page_views_salted(t):
    return traffic.page_views_salted(
        rec.user_behaviors(t.events), F.col("seq"), behavior=VIEW
    )


@_query
def unique_visitors(t):
    return traffic.unique_visitors(rec.user_behaviors(t.events), behavior=VIEW)


@_query
def uv_bitmap(t):
    return traffic.unique_visitors_bitmap(rec.user_behaviors(t.events), behavior=VIEW)


@_query
def uv_bitmap_daily(t):
    hourly = traffic.visitor_bitmaps(rec.user_behaviors(t.events), behavior=VIEW)
    return traffic.bitmap_visitors(traffic.merged_bitmaps(hourly, "1 day"))


@_query
def uv_running(t):
    return traffic.unique_visitors_running(rec.user_behaviors(t.events), behavior=VIEW)


def _clicks(t: _Tables) -> DataFrame:
    return rec.ad_clicks(t.events, t.nation)


@_query
def ad_clicks_by_province(t):
    return ads.clicks_by_province(_clicks(t))


@_query
def click_filtered(t):
    return ads.click_blacklist(_clicks(t), limit=1)[0]


@_query
def click_blacklist(t):
    return ads.click_blacklist(_clicks(t), limit=1)[1]


@_query
def click_blacklist_rolling(t):
    return ads.click_blacklist(_clicks(t), limit=1, reset="rolling_24h")[1]


@_query
def marketing_by_channel(t):
    return marketing.marketing_by_channel(
        rec.marketing_events(t.events), F.col("behavior") == "error"
    )


@_query
def marketing_total(t):
    return marketing.marketing_total(
        rec.marketing_events(t.events), F.col("behavior") == "error"
    )


@_query
def login_fail(t):
    return logins.login_failures(
        rec.login_events(t.events), interval=LOGIN_INTERVAL, order=("event_time", "seq")
    )


@_query
def raw_route(t):
    routed = raw_zone.route_envelopes(rec.envelopes(t.events))
    return routed.select("seq", "path", "topic", "data")


def _bucketed(t: _Tables) -> DataFrame:
    routed = raw_zone.route_envelopes(rec.envelopes(t.events))
    return raw_zone.bucketed(routed, F.col("at"), date_format="yyyy-MM")


@_query
def raw_bucket_rows(t):
    base = shared_dir(t.spark, "lake")
    lake.write_lake(_bucketed(t), base)
    return lake.read_lake_lines(t.spark, base)


# User-defined functions ------------------------------------------------------------------------


@_query
def udaf_avg(t):
    averaged = t.spark.sql(
        f"SELECT id, {udfs.avg_temp_sql('temperature')} AS avg_temp FROM {{readings}} GROUP BY id",
        readings=rec.exact_readings(t.events),
    )
    return averaged.withColumn("avg_temp", F.round("avg_temp", 6).cast("double"))


@_query
def udf_hash_code(t):
    readings = rec.keyed_readings(t.events)
    return readings.select("id", udfs.hash_code(F.col("id"), 23).alias("hash_code"))


@_query
def udtf_split_lateral(t):
    return rec.keyed_readings(t.events).select(
        "id", "timestamp", F.inline(udfs.split_words(F.col("id")))
    )


# Sinks -----------------------------------------------------------------------------------------


@_query
def sink_topic_payload(t):
    return topics.text_values(rec.keyed_readings(t.events), "SensorReading")


@_query
def sink_csv_payload(t):
    return topics.csv_values(rec.keyed_readings(t.events))


@_query
def sink_csv_roundtrip(t):
    path = shared_dir(t.spark, "csv")
    files.write_csv(rec.keyed_readings(t.events), path)
    return file_sources.csv_table(t.spark, path, SENSOR_READING)


@_query
def sink_latest_per_key(t):
    return upsert.hash_entries(rec.sensor_readings(t.events), "id", "temperature")


@_query
def sink_jdbc_upsert(t):
    readings = rec.with_times(t.events).select(
        F.col("user_id").alias("id"), F.col("value").alias("temp"), "seq", "event_type"
    )
    stored = F.coalesce(F.col("event_type") != VIEW, F.lit(True))
    before = upsert.latest_per_key(readings.where(stored), ["id"])
    batch = upsert.latest_per_key(readings.where(~stored), ["id"])
    return upsert.merge_latest(before.select("id", "temp"), batch, ["id"])


@_query
def sink_doc_payload(t):
    return documents.documents(
        rec.keyed_readings(t.events), {"id": "id", "temp": "temperature", "ts": "timestamp"}
    )


# Streaming forms, run to the end of their input ------------------------------------------------


@_query
def hot_items_stream(t):
    behaviors = stream_windows.ascending(rec.user_behaviors(t.in_batches("events", "event_id")))
    return stream_windows.drain_hot_items(behaviors, behavior=VIEW)


@_query
def hot_pages_stream(t):
    lines = rec.access_log_lines(t.in_batches("events", "event_id"), t.pages)
    log = parse.access_log(lines, keep=["seq"])
    return stream_windows.drain_hot_pages(
        stream_windows.with_lateness(log, "3 hours", "1 minute")
    )


@_query
def hot_pages_updates_stream(t):
    events = t.in_batches("events", "event_id", 6, even=True)
    log = parse.access_log(rec.access_log_lines(events, t.pages), keep=["seq"])
    return stream_windows.drain_hot_page_updates(log, lateness="3 hours")


@_query
def topn_changelog(t):
    events = t.in_batches("events", "event_id", 4, even=True)
    behaviors = stream_windows.ascending(rec.user_behaviors(events))
    return ranked.drain_ranked_changes(behaviors, "itemId")


@_query
def ad_clicks_stream(t):
    clicks = rec.ad_clicks(t.in_batches("events", "event_id"), t.nation)
    return stream_windows.drain_ad_clicks(stream_windows.ascending(clicks))


@_query
def marketing_by_channel_stream(t):
    events = stream_windows.ascending(rec.marketing_events(t.in_batches("events", "event_id")))
    return stream_windows.drain_marketing(events, F.col("behavior") == "error")


@_query
def unique_visitors_stream(t):
    behaviors = stream_windows.ascending(rec.user_behaviors(t.in_batches("events", "event_id")))
    return run.drain(traffic.unique_visitors(behaviors, behavior=VIEW))


@_query
def temp_jump_alert_stream(t):
    return run.drain(
        processors.jump_alert_stream(
            rec.sensor_readings(t.in_batches("events", "event_id")), "id", "temperature", JUMP_THRESHOLD
        )
    )


@_query
def running_count_stream(t):
    return run.drain(
        processors.running_count_stream(rec.sensor_readings(t.in_batches("events", "event_id")), "id")
    )


@_query
def rise_alert_stream(t):
    readings = stream_windows.ascending(rec.sensor_readings(t.in_batches("events", "event_id")))
    return run.drain(
        processors.rise_alert_stream(readings, "id", "temperature", 10 * HOUR_US)
    )


@_query
def login_fail_stream(t):
    events = stream_windows.bounded(rec.login_events(t.in_batches("events", "event_id")), "3 seconds")
    return run.drain(processors.login_failures_stream(events, 24 * HOUR_US))


@_query
def click_blacklist_stream(t):
    clicks = rec.ad_clicks(t.in_batches("events", "event_id"), t.nation)
    return run.drain(processors.click_limit_stream(clicks, 1))


@_query
def uv_running_stream(t):
    behaviors = stream_windows.ascending(rec.user_behaviors(t.in_batches("events", "event_id")))
    path = shared_dir(t.spark, "uv")
    run.drain_batches(
        visitors.first_sightings(behaviors, behavior=VIEW),
        visitors.number_first_sightings(path),
        mode="update",
    )
    schema = "window_end TIMESTAMP, seq BIGINT, uv BIGINT"
    return t.spark.read.schema(schema).parquet(f"{path}/uv/*")


@_query
def category_counts_stream(t):
    events = rec.with_times(t.in_batches("events", "event_id")).select(
        "seq", F.col("user_id").alias("id"), F.col("event_type").alias("behavior")
    )
    return run.drain(processors.category_counts_stream(events, "id", "behavior"))


@_query
def count_window_avg_stream(t):
    averaged = run.drain(
        processors.count_window_avg_stream(
            rec.sensor_readings(t.in_batches("events", "event_id")), "id", "temperature"
        )
    )
    return averaged.withColumn("avg", F.round("avg", 6))


@_query
def over_rows_stream(t):
    over = run.drain(
        processors.over_rows_stream(rec.sensor_readings(t.in_batches("events", "event_id")), "id", "temperature")
    )
    return over.select("id", "seq", "count", F.round("avg", 6).alias("avg"))


@_query
def retract_changelog_stream(t):
    changes = run.drain(
        processors.changelog_stream(rec.sensor_readings(t.in_batches("events", "event_id")), "id", "temperature")
    )
    return changes.withColumn("sum", F.round("sum", 2))


@_query
def count_avg_update_stream(t):
    path = shared_dir(t.spark, "updates")
    readings = rec.exact_readings(t.in_batches("events", "event_id"))
    run.drain_batches(
        rolling.group_count_avg(readings, "id", "temperature"),
        run.write_batch_folder(path),
        mode="update",
    )
    newest = run.latest_update(
        t.spark, path, "id BIGINT, count BIGINT, avg DECIMAL(16,6)", ["id"]
    )
    return newest.withColumn("avg", F.col("avg").cast("double"))
