import pytest
from pyspark.sql import functions as F

from eventlake.functions import hashing, jsonmeta, text, times, udfs


def one(spark, value, column, kind="string"):
    df = spark.createDataFrame([(value,)], f"s {kind}")
    return df.select(column(F.col("s")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("line", "tokens"),
    [
        ("a,b", ["a", "b"]),
        ("a,,", ["a"]),
        (",a", ["", "a"]),
        ("a,,b", ["a", "", "b"]),
        ("", [""]),
        (",,", []),
    ],
)
def test_split_drops_trailing_empty_tokens(spark, line, tokens):
    assert one(spark, line, lambda c: text.split_dropping_tail(c, ",")) == tokens


def python_hash(value, base, mask):
    units = value.encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * base + int.from_bytes(units[i : i + 2], "big")) & mask
    return h


@pytest.mark.parametrize("value", ["", "a", "sensor_10", "中文", "a😀b", "x" * 50])
def test_string_hash_over_utf16_units(spark, value):
    h = (python_hash(value, 31, 2**32 - 1) + 23) % 2**32
    signed = h - 2**32 if h >= 2**31 else h
    assert one(spark, value, lambda c: hashing.string_hash(c, 23)) == signed
    assert one(spark, value, hashing.bitmap_offset) == python_hash(value, 61, 2**29 - 1)


def test_hash_goldens(spark):
    expected = {
        "sensor_1": 1262115075,
        "sensor_6": 1262115080,
        "sensor_7": 1262115081,
        "sensor_10": 470861019,
    }
    for value, h in expected.items():
        assert one(spark, value, lambda c: udfs.hash_code(c, 23)) == h
    assert one(spark, "937166", hashing.bitmap_offset) == 5543688


@pytest.mark.parametrize(
    ("meta", "path"),
    [
        ('{"a":{"priority":1,"value":"x"},"b":{"priority":5,"value":7}}', "b=7/a=x"),
        ('{"b":{"priority":1,"value":"x"},"a":{"priority":1,"value":"y"}}', "a=y/b=x"),
        ('{"a":{"priority":"+2","value":"x"},"b":{"priority":-1,"value":"y"}}', "a=x/b=y"),
        ("{}", ""),
        ('{"a":{"priority":1}}', None),
        ('{"a":{"priority":1,"value":null}}', None),
        ('{"a":{"priority":1.5,"value":"x"}}', None),
        ('{"a":{"priority":"high","value":"x"}}', None),
        ('{"a":{"priority":99999999999,"value":"x"}}', None),
        ('{"a":"x"}', None),
        ('{"a":"x","b":{"priority":1,"value":"y"}}', None),
        ('{"a":[1],"b":{"priority":1,"value":"y"}}', None),
        ('{"a":{"priority":1,"value":{"v":2}}}', 'a={"v":2}'),
        ('{"a":null}', None),
        ("[1]", None),
        ("not json", None),
    ],
)
def test_meta_path(spark, meta, path):
    df = spark.createDataFrame([(meta,)], "meta string")
    found = jsonmeta.with_meta_entries(df).select(jsonmeta.entries_path(F.col("entries")))
    assert found.first()[0] == path


@pytest.mark.parametrize(
    ("value", "fields"),
    [
        ('{"data":{"v":1},"meta":{},"extra_data":"e"}', ('{"v":1}', "{}", "e")),
        ('{"data":1,"meta":"m","extra_data":[2]}', ("1", "m", "[2]")),
        ('{"data":null,"meta":{},"extra_data":"e"}', None),
        ('{"data":1,"meta":{}}', None),
        ('{"data":1,', None),
        ('{"data":1,"meta":{},"extra_data":"e"', None),
        ('{"data": {"a": 1},"meta":{},"extra_data":true}', ('{"a":1}', "{}", "true")),
        ("[]", None),
        ("", None),
    ],
)
def test_envelope(spark, value, fields):
    df = spark.createDataFrame([(value,)], "value string")
    found = tuple(jsonmeta.read_envelopes(df).drop("value").first())
    assert found == (fields or (None, None, None))


def test_data_pair_keeps_payloads_as_text(spark):
    pair = one(spark, '{"v":1}', lambda c: jsonmeta.data_pair(c, F.lit("")))
    assert pair == '{"data":"{\\"v\\":1}","extraData":""}'


def test_times(spark):
    assert times.micros("5 minutes") == 300_000_000
    with pytest.raises(ValueError):
        times.micros("soon")
    in_zone = one(
        spark, 0, lambda c: times.format_time(times.event_time(c), "Asia/Shanghai"), "bigint"
    )
    assert in_zone == "1970-01-01 08:00:00.0"


def test_udfs_from_sql(spark, sensors):
    udfs.register(spark)
    sensors.createOrReplaceTempView("udf_sensors")
    mean = spark.sql(
        f"SELECT id, {udfs.avg_temp_sql('temperature')} AS a FROM udf_sensors GROUP BY id"
    )
    native = sensors.groupBy("id").agg(udfs.avg_temp(F.col("temperature")).alias("a"))
    expected = {"sensor_1": 36.3, "sensor_6": 20.4, "sensor_7": 5.2, "sensor_10": 38.1}
    for df in (mean, native):
        assert {r.id: pytest.approx(r.a, abs=1e-9) for r in df.collect()} == expected
    split = spark.sql(
        "SELECT DISTINCT word, length FROM udf_sensors, LATERAL split_words(id, '_') "
        "WHERE id = 'sensor_1'"
    )
    assert {tuple(r) for r in split.collect()} == {("sensor", 6), ("1", 1)}
