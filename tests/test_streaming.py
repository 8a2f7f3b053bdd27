"""Streaming forms over several micro-batches agree with the batch forms on closed windows."""

import time

import pytest
from pyspark.sql import functions as F

from eventlake.operators import changelog, detect, rolling, windows
from eventlake.operators.parse import with_event_time
from eventlake.plans import hot_items, hot_pages, logins, traffic
from eventlake.plans import records as rec
from eventlake.session import shared_dir
from eventlake.sinks import files
from eventlake.streaming import late, processors, run, visitors
from eventlake.streaming import windows as sw
from tests.fixtures import LOGIN_ROWS, rows

HOUR_US = 3_600_000_000
BATCHES = 3


def in_files(spark, df, order, n=BATCHES):
    """``df`` as ``n`` files, in order."""
    path = shared_dir(spark, "stream-source")
    size = df.count()
    bounds = [size * i // n for i in range(n + 1)]
    numbered = df.select("*", F.row_number().over(_by(order)).alias("__i")).cache()
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = numbered.where((F.col("__i") > low) & (F.col("__i") <= high)).drop("__i")
        part.coalesce(1).write.mode("append").parquet(path)
    return path, df.schema


def _by(order):
    from pyspark.sql import Window

    return Window.orderBy(order)


def stream(spark, source):
    path, schema = source
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


@pytest.fixture(scope="module")
def source(spark, events):
    return in_files(spark, events, "event_id")


def closed(df, events, delay="0 seconds"):
    end = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return df.where(F.col("window_end") <= F.lit(end) - F.expr(f"INTERVAL {delay}"))


def test_windows(spark, events, source):
    readings = sw.bounded(rec.sensor_readings(stream(spark, source)), "2 hours")
    found = run.drain(windows.tumbling_count(readings, "1 hour", ["id"]))
    batch = windows.tumbling_count(rec.sensor_readings(events), "1 hour", ["id"])
    assert rows(found) == rows(closed(batch, events, "2 hours"))


def test_min_by(spark, events, source):
    readings = sw.ascending(rec.sensor_readings(stream(spark, source)))
    found = run.drain(windows.tumbling_min_by(readings, "6 hours", "id", "temperature"))
    batch = windows.tumbling_min_by(rec.sensor_readings(events), "6 hours", "id", "temperature")
    assert rows(found) == rows(closed(batch, events))


def test_hot_items(spark, events, source):
    behaviors = sw.ascending(rec.user_behaviors(stream(spark, source)))
    found = sw.drain_hot_items(behaviors, behavior="view")
    batch = hot_items.hot_items(rec.user_behaviors(events), behavior="view")
    assert rows(found) == rows(closed(batch, events))


def test_hot_pages(spark):
    log = spark.createDataFrame(
        [(i, i * 7, "GET", f"/p{i % 3}") for i in range(40)] + [(40, 5000, "GET", "/end")],
        "seq bigint, timestamp bigint, method string, url string",
    )
    source = in_files(spark, log, "seq")
    requests = sw.with_lateness(
        with_event_time(stream(spark, source)), "1 second", "1 minute"
    )
    kwargs = {"size": "1 minute", "slide": "30 seconds"}
    found = sw.drain_hot_pages(requests, **kwargs)
    batch = hot_pages.hot_pages(with_event_time(log), **kwargs)
    assert rows(found) == rows(batch.where("url <> '/end'")) and found.count() > 20


def test_unique_visitors(spark, events, source):
    behaviors = sw.ascending(rec.user_behaviors(stream(spark, source)))
    found = run.drain(traffic.unique_visitors(behaviors, behavior="view"))
    batch = traffic.unique_visitors(rec.user_behaviors(events), behavior="view")
    assert rows(found) == rows(closed(batch, events))


@pytest.mark.parametrize("chunk_rows", [1_000_000, 2])
def test_running_visitors(spark, events, source, chunk_rows):
    path = shared_dir(spark, "uv")
    behaviors = sw.ascending(rec.user_behaviors(stream(spark, source)))
    run.drain_batches(
        visitors.first_sightings(behaviors, "1 day", "view"),
        visitors.number_first_sightings(path, chunk_rows),
        mode="update",
    )
    found = spark.read.parquet(f"{path}/uv/*")
    batch = traffic.unique_visitors_running(rec.user_behaviors(events), "1 day", "view")
    assert rows(found) == rows(batch)


def test_running_visitors_with_arrival_numbers_out_of_order(spark):
    """A first sighting counts whatever numbers earlier batches had."""
    at = "timestamp'2024-01-01 10:00:00'"
    rows_ = [(0, 1, 10), (0, 2, 11), (1, 3, 5), (1, 4, 12), (2, 1, 1), (2, 5, 2)]
    df = spark.createDataFrame(rows_, "file int, userId bigint, seq bigint").selectExpr(
        "file", "userId", "seq", "'view' AS behavior", f"{at} AS event_time"
    )
    path = shared_dir(spark, "uv")
    behaviors = sw.ascending(stream(spark, in_files(spark, df, "file")))
    run.drain_batches(
        visitors.first_sightings(behaviors, behavior="view"),
        visitors.number_first_sightings(path),
        mode="update",
    )
    found = spark.read.parquet(f"{path}/uv/*").collect()
    assert sorted(r.seq for r in found) == [2, 5, 10, 11, 12]
    assert sorted(r.uv for r in found) == [1, 2, 3, 4, 5]


def test_word_count_in_update_mode(spark):
    lines = spark.createDataFrame([(i, "a b a") for i in range(6)], "i int, line string")
    source = in_files(spark, lines, "i")
    path = shared_dir(spark, "counts")
    run.drain_batches(
        rolling.word_count(stream(spark, source)), run.write_batch_folder(path), mode="update"
    )
    found = run.latest_update(spark, path, "word STRING, count BIGINT", ["word"])
    assert rows(found) == [("a", 12), ("b", 6)]


def _near(x, y):
    return abs(x - y) < 1e-6 if isinstance(x, float) else x == y


def assert_close(found, expected):
    """Equal but for the last digits of sums made in another order."""
    pairs = zip(rows(found), rows(expected), strict=True)
    assert all(_near(x, y) for a, b in pairs for x, y in zip(a, b, strict=True))


def test_stateful_rows(spark, events, source):
    def readings():
        return rec.sensor_readings(stream(spark, source))

    batch = rec.sensor_readings(events)
    found = run.drain(processors.jump_alert_stream(readings(), "id", "temperature", 50.0))
    assert rows(found) == rows(detect.jump_alert(batch, "id", "temperature", 50.0))

    found = run.drain(processors.count_window_avg_stream(readings(), "id", "temperature"))
    expected = windows.count_window_avg(batch, "id", "temperature")
    assert_close(found, expected)

    found = run.drain(processors.over_rows_stream(readings(), "id", "temperature"))
    expected = windows.over_rows(
        batch, "id", ["seq"], 2, {"count": F.count("id"), "avg": F.avg("temperature")}
    ).select("id", "seq", "count", "avg")
    assert_close(found, expected)

    found = run.drain(processors.changelog_stream(readings(), "id", "temperature"))
    expected = changelog.retract_changelog(batch, "id", F.col("temperature"))
    assert_close(found, expected)

    found = run.drain(
        processors.rolling_reduce_stream(
            readings(), "id", "temperature", lambda a, b: (b[0], max(a[1], b[1]))
        )
    )
    expected = rolling.rolling_reduce(batch, "id", "event_time", "temperature").select(
        "id", "seq", F.unix_micros("event_time"), "temperature"
    )
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("reset", ["calendar_day", "rolling_24h"])
def test_click_limit(spark, reset):
    clicks = spark.createDataFrame(
        [(i, 1, 7, i * 30_000) for i in range(12)],
        "seq bigint, userId bigint, adId bigint, timestamp bigint",
    )
    source = in_files(spark, clicks, "seq")
    found = run.drain(
        processors.click_limit_stream(with_event_time(stream(spark, source)), 1, reset, None)
    )
    passed, warned = detect.click_limit(
        with_event_time(clicks), ["userId", "adId"], 1, reset=reset
    )
    assert rows(found.where("kind = 'pass'").select("seq")) == rows(passed.select("seq"))
    assert rows(found.where("kind = 'warn'").select("seq")) == rows(warned.select("warned_at"))


@pytest.mark.parametrize("reset", ["calendar_day", "rolling_24h"])
def test_click_limit_clears_counts(spark, reset):
    """Counts are cleared by timer and start again; clicks in order give what the batch gives."""
    day = 86_400
    times = [10, 20, 30, day + 5, day + 40, 3 * day, 3 * day + 1, 6 * day, 6 * day + 9, 6 * day + 10]
    clicks = spark.createDataFrame(
        [(i, 1 + i % 2 * (at > 5 * day), 7, at) for i, at in enumerate(times)],
        "seq bigint, userId bigint, adId bigint, timestamp bigint",
    )
    source = in_files(spark, clicks, "seq")
    found = run.drain(
        processors.click_limit_stream(with_event_time(stream(spark, source)), 1, reset, "1 hour")
    )
    passed, warned = detect.click_limit(with_event_time(clicks), ["userId", "adId"], 1, reset=reset)
    assert rows(found.where("kind = 'pass'").select("seq")) == rows(passed.select("seq"))
    assert rows(found.where("kind = 'warn'").select("seq")) == rows(warned.select("warned_at"))


def test_login_failures_and_rises(spark, events, source):
    data = [(i, *r) for i, r in enumerate([*LOGIN_ROWS, (0, "success", 1558431000)])]
    df = spark.createDataFrame(
        data, "seq bigint, userId bigint, loginState string, timestamp bigint"
    )
    fixture = in_files(spark, df, "seq")
    events_in = sw.bounded(with_event_time(stream(spark, fixture)), "3 seconds")
    found = run.drain(processors.login_failures_stream(events_in, 2_000_000))
    assert rows(found.select("userId", F.unix_seconds("first_fail"), "fail_times")) == [
        (1035, 1558430842, 3)
    ]
    by_hours = sw.bounded(rec.login_events(stream(spark, source)), "3 seconds")
    found = run.drain(processors.login_failures_stream(by_hours, 24 * HOUR_US))
    batch = logins.login_failures(rec.login_events(events), interval="24 hours")
    end = events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    expected = batch.drop("warning").where(
        F.col("first_fail") + F.expr("INTERVAL 24 HOURS 3 SECONDS") < F.lit(end)
    )
    assert rows(found) == rows(expected)

    readings = sw.ascending(rec.sensor_readings(stream(spark, source)))
    found = run.drain(processors.rise_alert_stream(readings, "id", "temperature", 10 * HOUR_US))
    batch = detect.rise_alert(rec.sensor_readings(events), "id", "temperature", "10 hours")
    assert rows(found) == rows(batch.where(F.col("alert_time") < F.lit(end)))


def test_late_rows_survive_a_restart(spark):
    times = [0, 10, 20, 200, 12, 201, 15, 190, 400]
    df = spark.createDataFrame(list(enumerate(times)), "seq bigint, timestamp bigint")
    path, schema = in_files(spark, df, "seq", 9)
    base = shared_dir(spark, "late")

    source_rows = with_event_time(stream(spark, (path, schema)))

    def go():
        split = late.split_late(base, "15 seconds", "2 seconds", "1 minute")
        run.drain_batches(with_event_time(stream(spark, (path, schema))), split, checkpoint=f"{base}/cp")

    go()
    more = spark.createDataFrame([(9, 100), (10, 399), (11, None)], "seq bigint, timestamp bigint")
    more.coalesce(1).write.mode("append").parquet(path)
    go()
    assert {r.seq for r in late.split_rows(source_rows, base, True).collect()} == {4, 6, 9}
    assert {r.seq for r in late.split_rows(source_rows, base, False).collect()} == {0, 1, 2, 3, 5, 7, 8, 10, 11}


def test_late_split_reads_one_row_of_progress(spark, tmp_path):
    split = late.split_late(str(tmp_path), "15 seconds", "2 seconds", "1 minute")
    df = spark.createDataFrame([(i, 100 * i) for i in range(6)], "seq bigint, timestamp bigint")
    for b in range(4):
        for _ in range(2):  # handed over again
            split(with_event_time(df.where(F.col("seq") == 5 - b)), b)
        if b >= 2:  # what earlier batches left is not read again
            (tmp_path / "progress" / f"batch-{b - 2}").rename(tmp_path / f"gone-{b}")
    assert {r.seq for r in late.split_rows(with_event_time(df), str(tmp_path), True).collect()} == {2, 3, 4}
    assert {r.seq for r in late.split_rows(with_event_time(df), str(tmp_path), False).collect()} == {5}


def test_file_sink_restart_neither_loses_nor_repeats(spark):
    df = spark.createDataFrame([(i, f"line {i}") for i in range(9)], "seq bigint, line string")
    path, schema = in_files(spark, df, "seq")
    out, checkpoint = shared_dir(spark, "out"), shared_dir(spark, "cp")
    files.stream_to_csv(stream(spark, (path, schema)), out, checkpoint).awaitTermination()
    more = spark.createDataFrame([(9, "line 9")], schema)
    more.coalesce(1).write.mode("append").parquet(path)
    files.stream_to_csv(stream(spark, (path, schema)), out, checkpoint).awaitTermination()
    found = spark.read.schema(schema).csv(out)
    assert rows(found) == [(i, f"line {i}") for i in range(10)]


def test_processing_time_timer(spark):
    df = spark.createDataFrame([("sensor_1",), ("ab",)], "id string")
    path = shared_dir(spark, "timer-source")
    df.coalesce(1).write.parquet(path)
    out = shared_dir(spark, "timer")
    timed = processors.key_timer_stream(
        spark.readStream.schema(df.schema).parquet(path), "id", delay_ms=500
    )
    with run.rocksdb_state(spark):
        query = (
            timed.writeStream.foreachBatch(run.write_batch_folder(out))
            .option("checkpointLocation", shared_dir(spark, "timer-cp"))
            .trigger(processingTime="1 second")
            .start()
        )
        deadline = time.time() + 60
        found = []
        while time.time() < deadline and len(found) < 4:
            time.sleep(2)
            found = spark.read.parquet(out).collect() if query.lastProgress else []
        query.stop()
    assert {(r.id, r.value) for r in found if r.kind == "length"} == {("sensor_1", 8), ("ab", 2)}
    assert {r.id for r in found if r.kind == "timer"} == {"sensor_1", "ab"}
