import os

import pytest
from pyspark.sql import functions as F

from eventlake.operators import parse, transforms
from eventlake.plans import raw_zone
from eventlake.schemas import SENSOR_READING
from eventlake.session import shared_dir
from eventlake.sinks import documents, files, lake, topics, upsert
from eventlake.sources import files as sources
from eventlake.sources import topics as topic_sources
from eventlake.streaming import run
from tests.fixtures import SENSOR_ROWS, rows

LINES = [f"{i},{t},{v}" for i, t, v in SENSOR_ROWS]


def lines_df(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "line string")


def test_records_from_memory(spark):
    df = sources.records(spark, SENSOR_ROWS, SENSOR_READING)
    assert rows(df) == sorted(SENSOR_ROWS)


def test_csv_lines(spark):
    df = parse.csv_records(lines_df(spark, LINES), SENSOR_READING)
    assert rows(df) == sorted(SENSOR_ROWS)
    more = parse.csv_records(lines_df(spark, ["a,1,2.0,surplus"]), SENSOR_READING)
    assert rows(more) == [("a", 1, 2.0)]


@pytest.mark.parametrize("bad", ["a,x,1.0", "a,1", ""])
def test_bad_line_fails_or_is_set_aside(spark, bad):
    df = lines_df(spark, ["a,1,1.0", bad])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|INVALID_ARRAY_INDEX"):
        parse.csv_records(df, SENSOR_READING).collect()
    kept = parse.csv_records(df, SENSOR_READING, strict=False)
    assert [r.line for r in kept.where("is_bad").collect()] == [bad]


def test_access_log(spark):
    line = "83.149.9.216 - - 17/05/2015:10:05:03 +0000 GET /presentations/"
    found = parse.access_log(lines_df(spark, [line])).withColumn(
        "event_time", F.unix_seconds("event_time")
    )
    assert rows(found) == [("83.149.9.216", "-", 1431857103, "GET", "/presentations/")]
    east = parse.access_log(lines_df(spark, [line]), zone="Asia/Shanghai")
    assert east.select(F.unix_seconds("event_time")).first()[0] == 1431857103 - 8 * 3600


def test_processing_time(spark):
    stamped = parse.with_processing_time(lines_df(spark, ["x"]))
    seconds = stamped.select(F.unix_seconds("event_time") - F.unix_seconds(F.current_timestamp()))
    assert seconds.first()[0] == 0


def test_text_and_csv_files(spark):
    path = shared_dir(spark, "t")
    files.write_csv(sources.records(spark, SENSOR_ROWS, SENSOR_READING), path)
    assert sorted(r.line for r in sources.text_lines(spark, path).collect()) == sorted(LINES)
    table = sources.csv_table(spark, path, SENSOR_READING, view="fixture_table")
    assert rows(table) == rows(spark.table("fixture_table")) == sorted(SENSOR_ROWS)
    stream = run.drain(sources.csv_table_stream(spark, path, SENSOR_READING))
    assert rows(stream) == sorted(SENSOR_ROWS)


def test_topic_payloads(spark):
    records = spark.createDataFrame(
        [("t", line.encode()) for line in LINES], "topic string, value binary"
    )
    assert {r.value for r in topic_sources.topic_values(records).collect()} == set(LINES)
    assert rows(topic_sources.csv_payload(records, SENSOR_READING)) == sorted(SENSOR_ROWS)
    readings = sources.records(spark, SENSOR_ROWS, SENSOR_READING)
    assert {r.value for r in topics.csv_values(readings).collect()} == set(LINES)
    text = topics.text_values(readings.limit(1), "SensorReading").first().value
    assert text == "SensorReading{id='sensor_1', timestamp=1547718199, temperature=35.8}"


def test_topic_options():
    options = topic_sources.topic_options("h:1", pattern="raw.*", starting_offsets="earliest",
                                          discovery_interval_ms=60000)
    assert options == {
        "kafka.bootstrap.servers": "h:1",
        "startingOffsets": "earliest",
        "subscribePattern": "raw.*",
        "kafka.metadata.max.age.ms": "60000",
    }
    assert topic_sources.topic_options("h:1", topic="a")["subscribe"] == "a"
    with pytest.raises(ValueError):
        topic_sources.topic_options("h:1")


def test_upserts(spark, sensors):
    newest = upsert.latest_per_key(sensors.select("id", "temperature", "seq"), ["id"])
    assert {(r.id, r.temperature) for r in newest.collect()} == {
        ("sensor_1", 36.8), ("sensor_6", 25.4), ("sensor_7", 3.7), ("sensor_10", 48.1),
    }
    assert ("sensor_7", "3.7") in rows(upsert.hash_entries(sensors, "id", "temperature"))
    target = spark.createDataFrame([("sensor_7", 0.0), ("x", 1.0)], "id string, temperature double")
    merged = upsert.merge_latest(target, newest.where("id = 'sensor_7'"), ["id"])
    assert rows(merged) == [("sensor_7", 3.7), ("x", 1.0)]
    seen = []
    upsert.upsert_batches(lambda df: seen.append(df.count()), ["id"])(sensors, 0)
    assert seen == [4]


def test_upsert_statements():
    update, insert = upsert.upsert_statements("t", "s_t", ["id"], ["temp"])
    assert update == (
        'UPDATE t SET "temp" = (SELECT s."temp" FROM s_t s WHERE s."id" = t."id") '
        'WHERE EXISTS (SELECT 1 FROM s_t s WHERE s."id" = t."id")'
    )
    assert insert == (
        'INSERT INTO t ("id", "temp") SELECT s."id", s."temp" FROM s_t s '
        'WHERE NOT EXISTS (SELECT 1 FROM t WHERE s."id" = t."id")'
    )


def test_documents(spark):
    df = sources.records(spark, SENSOR_ROWS[:1], SENSOR_READING)
    found = documents.documents(df, {"id": "id", "temp": "temperature", "ts": "timestamp"})
    assert rows(found) == [('{"id":"sensor_1","temp":"35.8","ts":"1547718199"}',)]


ENVELOPES = [
    ("a", '{"data":{"v":1},"meta":{"a":{"priority":1,"value":"x"},"b":{"priority":5,"value":7}},"extra_data":"e"}'),
    ("a", '{"data":2,"meta":{},"extra_data":"e"}'),
    ("a", "broken"),
    ("b", '{"data":3,"meta":{"dt":{"priority":1,"value":"q"}},"extra_data":"e"}'),
    ("b", '{"data":4,"meta":{"a":"x"},"extra_data":"e"}'),
]


@pytest.fixture
def routed(spark):
    values = spark.createDataFrame(ENVELOPES, "topic string, value string")
    at = F.timestamp_seconds(F.lit(1704124800 - 3600 * 9))  # 23:00 in Shanghai, 2023-12-31 + 1 day
    return raw_zone.bucketed(raw_zone.route_envelopes(values), at)


LAKE = {
    ("b=7/a=x", '{"data":"{\\"v\\":1}","extraData":"e"}'),
    ("", '{"data":"2","extraData":"e"}'),
    (".error/a", '{"data":"broken","extraData":""}'),
    (".error/b", '{"data":"{\\"data\\":4,\\"meta\\":{\\"a\\":\\"x\\"},\\"extra_data\\":\\"e\\"}","extraData":""}'),
    ("dt=q", '{"data":"3","extraData":"e"}'),
    (".meta", '{"data":"{}","extraData":""}'),
    (".meta", '{"data":"{\\"a\\":{\\"priority\\":1,\\"value\\":\\"x\\"},\\"b\\":{\\"priority\\":5,\\"value\\":7}}","extraData":""}'),
    (".meta", '{"data":"{\\"dt\\":{\\"priority\\":1,\\"value\\":\\"q\\"}}","extraData":""}'),
}


def test_routing(routed):
    assert {(r.path, r.data) for r in routed.collect()} == LAKE
    assert {r.dt for r in routed.collect()} == {"2024-01-01"}
    assert {r.bucket for r in routed.where("path = ''").collect()} == {"2024-01-01"}


def found_in_lake(spark, base):
    return sorted((r.path, r.line) for r in lake.read_lake_lines(spark, base).collect())


def test_lake_folders(spark, routed):
    base = shared_dir(spark, "lake")
    lake.write_lake(routed, base, nested=[["b", "a"]])
    assert found_in_lake(spark, base) == sorted(LAKE)
    with pytest.raises(ValueError):  # a key called like one of the writer's own columns
        lake.write_lake(routed, base, nested=[["dt"]])
    assert os.path.isdir(f"{base}/path=dt%3Dq/dt=2024-01-01")
    assert os.path.isdir(f"{base}/b=7/a=x/dt=2024-01-01")
    visible = lake.read_lake_lines(spark, base, hidden=False)
    assert not [r for r in visible.collect() if r.path.startswith(".")]


def test_lake_batches_replace_themselves(spark, routed):
    base = shared_dir(spark, "lake")
    write = lake.lake_batches(base)
    write(routed, 0)
    once = found_in_lake(spark, base)
    write(routed, 0)
    assert found_in_lake(spark, base) == once and len(once) == len(LAKE)
    write(routed, 1)
    assert len(found_in_lake(spark, base)) == 2 * len(LAKE)


def test_flat_lake_keeps_every_row(spark, routed):
    base = shared_dir(spark, "lake")
    lake.write_lake(routed, base)
    assert os.path.isdir(f"{base}/path=b%3D7%2Fa%3Dx/dt=2024-01-01")
    assert found_in_lake(spark, base) == sorted(LAKE)


def test_branches_take_one_scan_and_one_write(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "value")
    marked = transforms.tagged(df, {"high": F.col("value") > 30, "even": F.col("event_id") % 2 == 0, "none": F.lit(None).cast("boolean")})
    assert marked._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    path = str(tmp_path / "branches")
    files.write_branches(marked, path)
    high, even = (files.read_branch(marked, path, name) for name in ("high", "even"))
    assert sorted(high.collect()) == sorted(df.where("value > 30").collect())
    assert sorted(even.collect()) == sorted(df.where("event_id % 2 = 0").collect())
    assert files.read_branch(marked, path, "none").count() == 0


def test_lake_files_roll_by_bytes(spark):
    rows_ = [(f"k={i % 3 if i % 5 else 9}", "2024-01", '{"data":"%s","extraData":"x"}' % ("d" * (i % 90))) for i in range(4000)]
    df = spark.createDataFrame(rows_, "path string, dt string, data string")
    df = df.withColumn("entries", F.array().cast("array<struct<key:string,value:string>>"))
    for roll in (1 << 30, 20_000):
        base = shared_dir(spark, "rolled")
        lake.write_lake(df, base, roll_bytes=roll)
        sizes = {}
        for folder, _, names in os.walk(base):
            for name in names:
                if name.endswith(".json"):
                    sizes.setdefault(folder, []).append(os.path.getsize(f"{folder}/{name}"))
        assert len(sizes) == 4
        for files_ in sizes.values():
            if roll > sum(files_):
                continue
            assert max(files_) <= 1.1 * roll
            assert len(files_) <= 2 + 5 * sum(files_) // roll
        found = lake.read_lake_lines(spark, base)
        assert found.count() == len(rows_)
        lengths = found.groupBy("path").agg(F.sum(F.length("line")).alias("n"))
        expected = df.groupBy("path").agg(F.sum(F.length("data")).alias("n"))
        assert sorted(lengths.collect()) == sorted(expected.collect())
