"""Pane-based windows on micro-batches, corrections, and changelogs of rankings."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from eventlake.operators import changelog, windows
from eventlake.plans import records as rec
from eventlake.plans import registry, traffic
from eventlake.streaming import panes, ranked

START = datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def rows(spark, *seconds_and_keys):
    data = [(START + timedelta(seconds=s), k) for s, k in seconds_and_keys]
    return spark.createDataFrame(data, "event_time TIMESTAMP, url STRING")


def seconds(ts):
    return int((ts - START).total_seconds())


def updates(spark, path):
    found = spark.read.option("basePath", f"{path}/updates").parquet(f"{path}/updates/batch_id=*")
    return sorted((r.batch_id, seconds(r.window_end), r.url, r["count"], r.kind) for r in found.collect())


def replayed(batches, size, slide, delay, late):
    """The same by plain loops over the rows as they come."""
    counts, out, passed, newest = {}, [], None, None
    for b, batch in enumerate(batches):
        touched = set()
        for s, key in batch:
            newest = s if newest is None else max(newest, s)
            end = s - s % slide + slide
            for e in range(end, end + size, slide):
                if passed is None or e > passed - late:
                    counts[e, key] = counts.get((e, key), 0) + 1
                    touched.add(e)
        now = newest - delay if newest is not None else passed
        now = now if passed is None else max(passed, now)
        for (e, key), n in counts.items():
            if e <= now and (passed is None or e > passed):
                out.append((b, e, key, n, "first"))
            elif e <= now and e in touched:
                out.append((b, e, key, n, "corrected"))
        passed = now
    return sorted(out)


BATCHES = [
    [(100, "a"), (101, "b"), (130, "a"), (61, "a")],
    [(129, "b"), (150, "a"), (119, "a")],  # late for windows that were ranked
    [],
    [(300, "a"), (131, "b")],
    [(135, "a"), (290, "b"), (10, "a")],  # whose windows are dropped, but for the second
    [(400, "b")],
]


def test_corrected_windows(spark, tmp_path):
    work = panes.CorrectedWindows(str(tmp_path), "30 seconds", "10 seconds", ["url"], "5 seconds", "1 minute", lambda c: c)
    for b, batch in enumerate(BATCHES):
        work(rows(spark, *batch), b)
        if b in (1, 3):
            work(rows(spark, *batch), b)  # handed over again
    # A window's end counts as reached one millisecond early; rows are whole seconds here.
    assert updates(spark, tmp_path) == replayed(BATCHES, 30, 10, 5, 60)
    kinds = {u[4] for u in updates(spark, tmp_path)}
    assert kinds == {"first", "corrected"}


def test_what_is_carried_is_bounded(spark, tmp_path):
    work = panes.CorrectedWindows(str(tmp_path), "30 seconds", "10 seconds", ["url"], "5 seconds", "1 minute", lambda c: c)
    for b in range(6):
        work(rows(spark, *[(b * 100 + s, "a") for s in range(100)]), b)
        kept = spark.read.parquet(f"{tmp_path}/panes/batch-{b}")
        assert kept.count() <= 10  # 30 s and 60 s and 5 s in panes of 10 s


def test_finished_keys_that_do_not_count_move_the_watermark(spark, tmp_path):
    work = panes.CorrectedWindows(
        str(tmp_path), "30 seconds", "10 seconds", ["url"], "5 seconds", "0 seconds", lambda c: c, F.col("url") != "x"
    )
    work(rows(spark, (5, "a"), (200, "x")), 0)
    assert updates(spark, tmp_path) == [(0, e, "a", 1, "first") for e in (10, 20, 30)]


@pytest.mark.parametrize("size,slide", [("1 minute", "10 seconds"), ("30 seconds", "30 seconds")])
def test_closed_windows(spark, tmp_path, size, slide):
    data = rows(spark, *[(7 * i * i % 600, "ab"[i % 2]) for i in range(80)])
    pane = windows.tumbling(data, slide, ["url"], [F.count(F.lit(1)).alias("n")])
    pane = pane.select(F.col("window_end").alias("pane_end"), "url", "n")
    schema = "pane_end TIMESTAMP, url STRING, n BIGINT"
    work = panes.ClosedWindows(str(tmp_path), schema, size, slide, ["url"], lambda c: c)
    at = F.unix_seconds("pane_end") - int((START - datetime(1970, 1, 1)).total_seconds())
    for b, (low, high) in enumerate([(0, 100), (100, 110), (110, 110), (110, 400), (400, 700)]):
        for _ in range(1 + b % 2):
            work(pane.where((at > low) & (at <= high)), b)
    work.flush(spark, int((START + timedelta(seconds=900)).timestamp() - datetime.fromtimestamp(0).timestamp()) * 1_000_000)
    found = spark.read.parquet(f"{tmp_path}/windows/batch_id=*")
    expected = windows.sliding_count(data, size, slide, ["url"])
    columns = ["window_end", "url", "count"]
    assert sorted(found.select(columns).collect()) == sorted(expected.select(columns).collect())


def test_batches_without_rows_or_times(spark, tmp_path):
    work = panes.CorrectedWindows(str(tmp_path), "30 seconds", "10 seconds", ["url"], "5 seconds", "1 minute", lambda c: c)
    work(rows(spark, (1, "a")).limit(0), 0)
    work(rows(spark, (1, "a")).selectExpr("CAST(NULL AS TIMESTAMP) AS event_time", "url"), 1)
    assert updates(spark, tmp_path) == []
    work(rows(spark, (5, "a"), (90, "b")), 2)
    assert updates(spark, tmp_path) == [(2, e, "a", 1, "first") for e in (10, 20, 30)]
    closed = panes.ClosedWindows(str(tmp_path / "c"), "pane_end TIMESTAMP, n BIGINT", "30 seconds", "10 seconds", [], lambda c: c)
    closed(spark.createDataFrame([], "pane_end TIMESTAMP, n BIGINT"), 0)
    closed.flush(spark, 10**15)
    assert spark.read.parquet(f"{tmp_path}/c/windows/batch_id=*").count() == 0


def test_slide_has_to_divide_the_size(spark, tmp_path):
    with pytest.raises(ValueError):
        panes.ClosedWindows(str(tmp_path), "n BIGINT", "10 seconds", "3 seconds", [], lambda c: c)


def test_weights_count_as_rows(spark):
    data = rows(spark, (1, "a"), (1, "a"), (2, "a"), (40, "b"))
    weighed = data.groupBy("event_time", "url").agg(F.count(F.lit(1)).alias("w"))
    plain = windows.sliding_count(data, "30 seconds", "10 seconds", ["url"])
    found = windows.sliding_count(weighed, "30 seconds", "10 seconds", ["url"], weight=F.col("w"))
    assert sorted(found.collect()) == sorted(plain.collect())


def test_folding_the_changelog_gives_the_ranking(spark):
    log = registry.queries()["topn_changelog"](spark, SF)
    state = changelog.folded(log, "batch_id", ["window_end", "rank"])
    expected = registry.queries()["topn_per_window"](spark, SF).select("window_end", "rank", "itemId", "count")
    assert sorted(state.select("window_end", "rank", "itemId", "count").collect()) == sorted(expected.collect())
    assert log.where("op = '-'").count() > 0


def test_ranked_changes_keep_open_windows_only_and_replace_themselves(spark, tmp_path):
    schema = "window_end TIMESTAMP, itemId BIGINT, count BIGINT"
    work = ranked.RankedChanges(str(tmp_path), "itemId", "bigint", 2, "6 hours")
    hour = lambda h: START + timedelta(hours=h)
    steps = [
        [(hour(6), 1, 1), (hour(6), 2, 1), (hour(6), 3, 1)],
        [(hour(6), 3, 2)],
        [(hour(6), None, 9), (hour(12), 5, 1)],
        [(hour(18), 5, 1)],
    ]
    for b, step in enumerate(steps):
        for _ in range(2):
            work(spark.createDataFrame(step, schema), b)
    found = spark.read.option("basePath", f"{tmp_path}/changes").parquet(f"{tmp_path}/changes/batch_id=*")
    log = sorted((r.batch_id, r.op, seconds(r.window_end) // 3600, r.rank, r.itemId, r["count"]) for r in found.where("batch_id < 2").collect())
    assert log == [
        (0, "+", 6, 1, 1, 1), (0, "+", 6, 2, 2, 1),
        (1, "+", 6, 1, 3, 2), (1, "+", 6, 2, 1, 1), (1, "-", 6, 1, 1, 1), (1, "-", 6, 2, 2, 1),
    ]
    top = {(r.op, r.rank, r.itemId) for r in found.where("batch_id = 2 AND hour(window_end) = 6").collect()}
    assert top == {("+", 1, None), ("-", 1, 3), ("+", 2, 3), ("-", 2, 1)}
    assert {seconds(r.window_end) // 3600 for r in spark.read.parquet(f"{tmp_path}/state/batch-3").collect()} == {18}


def test_state_changes_with_null_keys_and_values(spark):
    before = spark.createDataFrame([(1, "a"), (2, None), (None, "n"), (4, "d")], "k INT, v STRING")
    after = spark.createDataFrame([(1, "b"), (2, None), (None, "m"), (5, None)], "k INT, v STRING")
    found = {tuple(r) for r in changelog.state_changes(before, after, ["k"]).collect()}
    assert found == {("-", 1, "a"), ("+", 1, "b"), ("-", None, "n"), ("+", None, "m"), ("-", 4, "d"), ("+", 5, None)}


def test_bitmaps_merge_and_are_made_without_distinct(spark):
    behaviors = rec.user_behaviors(spark.read.parquet(f"{SF}/events.parquet"))
    hourly = traffic.visitor_bitmaps(behaviors, behavior="view")
    assert {r.n for r in hourly.select(F.length("bitmap").alias("n")).collect()} == {4096}
    days = {r.window_start: r.uv for r in traffic.bitmap_visitors(traffic.merged_bitmaps(hourly, "1 day")).collect()}
    offsets = traffic.bitmap_offset(F.col("userId").cast("string"))
    views = behaviors.where("behavior = 'view'")
    plain = views.groupBy(F.date_trunc("day", "event_time").alias("d")).agg(F.count_distinct(offsets).alias("n"))
    assert days == {r.d: r.n for r in plain.collect()}
    plan = traffic.unique_visitors_bitmap(behaviors, behavior="view")._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "bitmap_construct_agg" in plan
    # Users that share a position count once; 32 positions only.
    few = traffic.unique_visitors_bitmap(behaviors, behavior="view", bits=32)
    assert max(r.uv for r in few.collect()) <= 32
