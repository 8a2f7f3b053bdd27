import random

import pytest
from pyspark.sql import functions as F

from eventlake.operators import changelog, rolling, topn, transforms, windows
from eventlake.plans import records as rec
from tests.fixtures import HELLO_LINES, rows

CHUNKS = [1_000_000, 7]


@pytest.fixture(scope="module")
def skewed(spark):
    """400 readings, most of one key, with ties; some keys NULL."""
    rng = random.Random(5)
    data = [
        (i, rng.choice([1, 1, 1, 1, 2, 3, None]), i * 10, float(rng.randint(0, 9)))
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "seq bigint, id bigint, timestamp bigint, temperature double")
    return df.repartition(3).cache(), data


def by_key(data):
    keys = {}
    for row in data:
        keys.setdefault(row[1], []).append(row)
    return keys


def test_word_count(spark):
    lines = spark.createDataFrame([(line,) for line in HELLO_LINES], "line string")
    counts = {r.word: r["count"] for r in rolling.word_count(lines).collect()}
    assert counts["hello"] == 3
    assert sorted(w for w, n in counts.items() if n == 1) == sorted(
        ["there", "world", "again", "one", "more", "line", "now", "the", "end", "c"]
    )


def test_rolling_max_by_golden(sensors):
    found = rolling.rolling_max_by(sensors, "id", "temperature").orderBy("seq").collect()
    assert [r.temperature for r in found] == [
        35.8, 15.4, 6.7, 38.1, 36.8, 25.4, 6.7, 38.1, 38.1, 48.1,
    ]
    assert found[6].timestamp == 1547718202
    assert found[7].timestamp == found[8].timestamp == 1547718205


def test_rolling_reduce_golden(sensors):
    found = rolling.rolling_reduce(sensors, "id", "timestamp", "temperature").orderBy("seq")
    kept = found.collect()
    assert kept[6].timestamp == 1547718231 and kept[6].temperature == 6.7
    assert kept[7].timestamp == kept[8].timestamp == 1547718225


def test_group_count_avg_golden(sensors):
    found = {r.id: (r["count"], r.avg) for r in rolling.group_count_avg(
        sensors, "id", "temperature").collect()}
    assert found["sensor_10"] == (4, pytest.approx(38.1, abs=1e-9))
    assert found["sensor_7"] == (2, pytest.approx(5.2, abs=1e-9))


@pytest.mark.parametrize("chunk_rows", CHUNKS)
def test_running_aggregates_match_a_plain_loop(skewed, chunk_rows):
    df, data = skewed
    expected_sum, expected_count, expected_max = [], [], []
    state = {}
    for seq, key, ts, value in data:
        total, n, best = state.get(key, (0.0, 0, None))
        best = (value, seq, ts) if best is None or value > best[0] else best
        state[key] = (total + value, n + 1, best)
        expected_sum.append((seq, key, total + value))
        expected_count.append((seq, key, n + 1))
        expected_max.append((key, seq, best[0], best[1]))
    key = lambda r: tuple((v is None, v) for v in r)
    summed = rolling.rolling_sum(df, "id", F.col("temperature"), chunk_rows=chunk_rows)
    assert rows(summed.select("seq", "id", "rolling_sum")) == sorted(expected_sum, key=key)
    counted = rolling.running_count(df, "id", chunk_rows=chunk_rows)
    assert rows(counted.select("seq", "id", "running_count")) == sorted(expected_count, key=key)
    best = rolling.rolling_max_by(df, "id", "temperature", chunk_rows=chunk_rows)
    assert rows(best.select("id", "seq", "temperature", "max_seq")) == sorted(
        expected_max, key=key
    )
    everything = rolling.running_count(df, chunk_rows=chunk_rows)
    assert rows(everything.select("seq", "running_count")) == [(i, i + 1) for i in range(400)]


@pytest.mark.parametrize("chunk_rows", CHUNKS)
def test_row_frames_match_a_plain_loop(skewed, chunk_rows):
    df, data = skewed
    expected_count_window, expected_over = [], []
    for key, group in by_key(data).items():
        values = [r[3] for r in group]
        for n, row in enumerate(group, 1):
            if n % 2 == 0:
                last = values[max(0, n - 10) : n]
                expected_count_window.append((row[0], key, n, sum(last) / len(last)))
            last = values[max(0, n - 3) : n]
            expected_over.append((row[0], key, len(last), sum(last)))
    key = lambda r: tuple((v is None, v) for v in r)
    averaged = windows.count_window_avg(df, "id", "temperature", chunk_rows=chunk_rows)
    assert rows(averaged.select("seq", "id", "n", "avg")) == sorted(
        expected_count_window, key=key
    )
    over = windows.over_rows(
        df, "id", ["seq"], 2, {"n": F.count(F.lit(1)), "s": F.sum("temperature")}, chunk_rows
    )
    assert rows(over.select("seq", "id", "n", "s")) == sorted(expected_over, key=key)


def test_count_window_golden(spark):
    df = spark.createDataFrame(
        [(i, "k", float(i)) for i in range(7)], "seq bigint, id string, v double"
    )
    found = windows.count_window_avg(df, "id", "v").orderBy("n")
    assert [(r.n, r.avg) for r in found.collect()] == [(2, 0.5), (4, 1.5), (6, 2.5)]


@pytest.mark.parametrize("chunk_rows", CHUNKS)
def test_changelog_retracts_what_it_said(skewed, chunk_rows):
    df, data = skewed
    found = changelog.retract_changelog(df, "id", F.col("temperature"), chunk_rows=chunk_rows)
    balance = {}
    for r in found.collect():
        entry = (r.id, r["count"], r["sum"])
        balance[entry] = balance.get(entry, 0) + (1 if r.op == "+" else -1)
    left = {e for e, n in balance.items() if n}
    assert left == {
        (k, len(g), sum(r[3] for r in g)) for k, g in by_key(data).items()
    }


def test_min_by_keeps_the_first_of_equals(spark):
    df = spark.createDataFrame(
        [(0, "a", 3, 2.0), (1, "a", 5, 1.0), (2, "a", 7, 1.0), (3, "a", 20, 5.0)],
        "seq bigint, id string, timestamp bigint, temperature double",
    ).withColumn("event_time", F.timestamp_seconds("timestamp"))
    found = windows.tumbling_min_by(df, "15 seconds", "id", "temperature").orderBy("window_end")
    assert [r.seq for r in found.collect()] == [1, 3]


@pytest.mark.parametrize(("size", "slide"), [("1 hour", "5 minutes"), ("1 minute", "1 minute")])
def test_sliding_count_equals_the_built_in_window(skewed, size, slide):
    df, _ = skewed
    timed = df.withColumn("event_time", F.timestamp_seconds("timestamp"))
    mine = windows.sliding_count(timed, size, slide, ["id"])
    built_in = timed.groupBy(F.window("event_time", size, slide), "id").count()
    expected = built_in.select("window.start", "window.end", "id", "count")
    assert rows(mine) == rows(expected)
    total = windows.sliding_count(timed, size, slide, [])
    built_in = timed.groupBy(F.window("event_time", size, slide)).count()
    assert rows(total) == rows(built_in.select("window.start", "window.end", "count"))


@pytest.mark.parametrize("chunk_rows", CHUNKS)
def test_late_rows_against_a_loop(spark, chunk_rows):
    rng = random.Random(3)
    data = [(i, "a", i * 5 - rng.choice([0, 0, 0, 30, 90, 200]), 1.0) for i in range(200)]
    df = spark.createDataFrame(data, "seq bigint, id string, t bigint, v double").withColumn(
        "event_time", F.timestamp_seconds(F.col("t") + 1000)
    )
    expected, newest = set(), None
    for seq, _, t, _ in data:
        end = ((t + 1000) // 15 + 1) * 15
        if newest is not None and (end * 1000 - 1 + 60_000) <= (newest - 2) * 1000:
            expected.add(seq)
        newest = max(newest or 0, t + 1000)
    sums, late = windows.windowed_sum_with_lateness(
        df, "15 seconds", "id", "v", "2 seconds", "1 minute", chunk_rows=chunk_rows
    )
    assert expected and {r.seq for r in late.collect()} == expected
    assert sums.agg(F.sum("sum")).first()[0] == len(data) - len(expected)


def test_top_n_breaks_ties_by_key(spark):
    df = spark.createDataFrame(
        [(1, "a", 3), (1, "b", 5), (1, "c", 3), (2, "a", 1)], "w int, k string, n int"
    )
    found = topn.top_n(df, ["w"], "n", 2, ["k"])
    assert rows(found) == [(1, "a", 3, 2), (1, "b", 5, 1), (2, "a", 1, 1)]


def test_top_n_limits_before_the_shuffle(skewed):
    df, _ = skewed
    ranked = topn.top_n(df, ["id"], "temperature", 3, ["seq"])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_split_union_connect(sensors):
    high, low = transforms.split_by(sensors, F.col("temperature") > 30)
    assert (high.count(), low.count()) == (5, 5)
    everything = transforms.union_all(high, low, sensors)
    assert set(everything.groupBy("seq").count().select("count").distinct().collect()) == {(2,)}
    joined = transforms.connect(
        high.select("id", "temperature"),
        low,
        [F.col("id"), F.col("temperature"), F.lit("high temp warning").alias("status")],
        [F.col("id"), F.lit("normal").alias("status")],
    )
    assert joined.where("status = 'normal' AND temperature IS NULL").count() == 5


def test_partitioning_keeps_rows(sensors):
    for df in (
        transforms.rebalance(sensors, 3),
        transforms.rebalance(sensors),
        transforms.partition_by_key(sensors, "id", partitions=3),
        transforms.global_order(sensors, "seq"),
    ):
        assert sorted(r.seq for r in df.collect()) == list(range(10))
    keyed = transforms.with_partition_id(
        transforms.partition_by_key(sensors, "id", partitions=3)
    )
    spread = keyed.groupBy("id").agg(F.count_distinct("partition_id").alias("n"))
    assert {r.n for r in spread.collect()} == {1}


def test_filters(spark, sensors):
    urls = ["/a.css", "/a.css?x", "/a", "/p.png"]
    log = spark.createDataFrame([("GET", u) for u in urls] + [("POST", "/a")], "method string, url string")
    assert rows(transforms.page_requests(log)) == [("GET", "/a"), ("GET", "/a.css?x")]
    selected = sensors.selectExpr("id", "temperature").where("id = 'sensor_6'")
    assert rows(selected) == [("sensor_6", 15.4), ("sensor_6", 25.4)]
    lines = spark.createDataFrame([("a😀",), ("b",)], "line string")
    assert rows(transforms.map_length(lines)) == [(1,), (3,)]
    assert rows(transforms.filter_prefix(lines, "b")) == [("b",)]


def test_records_from_the_driver_tables_are_pruned(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    counts = windows.sliding_count(rec.user_behaviors(events), "1 hour", "5 minutes", ["behavior"])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan


def test_an_outlier_makes_no_large_chunk(spark):
    """One row of a far year, and a burst, leave the chunks near their target."""
    from eventlake.operators.ordered import CHUNK, ordered

    rows = spark.range(20_000).selectExpr("id AS seq", "1 AS k", "timestamp_seconds(1700000000 + id) AS at")
    far = spark.sql("SELECT 20000L AS seq, 1 AS k, timestamp'2460-01-01' AS at")
    found = ordered(rows.union(far), ["k"], ["at"], chunk_rows=1000)
    sizes = [r["count"] for r in found.df.groupBy(CHUNK).count().collect()]
    assert found.cut and len(sizes) >= 15 and max(sizes) < 3000
    counted = found.running({"n": ("count", F.lit(1))}).result()
    assert counted.where("n <> seq + 1").isEmpty()
    whole = ordered(rows.union(far), [], ["at"], chunk_rows=1000)
    assert max(r["count"] for r in whole.df.groupBy(CHUNK).count().collect()) < 3000
