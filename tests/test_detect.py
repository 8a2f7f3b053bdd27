import random
from collections import Counter
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.operators import detect, episodes
from eventlake.operators.parse import with_event_time
from eventlake.plans import ads, logins
from tests.fixtures import LOGIN_ROWS, click_rows, rows

DAY = 86_400


def test_jump_alert_golden(sensors):
    found = detect.jump_alert(sensors, "id", "temperature", 10.0).orderBy("seq")
    assert [tuple(r) for r in found.drop("seq").collect()] == [
        ("sensor_10", 38.1, 28.1),
        ("sensor_10", 28.1, 38.1),
        ("sensor_10", 38.1, 48.1),
    ]


def logins_df(spark, data=LOGIN_ROWS):
    numbered = [(i, *r) for i, r in enumerate(data)]
    df = spark.createDataFrame(
        numbered, "seq bigint, userId bigint, loginState string, timestamp bigint"
    )
    return with_event_time(df)


def test_login_failure_golden(spark):
    found = logins.login_failures(logins_df(spark), order=("event_time", "seq"))
    seconds = found.select(
        "userId", F.unix_seconds("first_fail"), F.unix_seconds("last_fail"), "warning"
    )
    assert rows(seconds) == [(1035, 1558430842, 1558430844, "login fail in 2s for 3 times")]


def failure_runs(events, interval, least):
    """Greedy runs of one key's (time, failed) events in order."""
    out, run = [], None
    for t, failed in events:
        if run and t > run[0] + interval:
            out.append(run)
            run = None
        if not failed:
            run = None
        elif run:
            run = (run[0], t, run[2] + 1)
        else:
            run = (t, t, 1)
    return [*out, *([run] if run else [])]


@pytest.mark.parametrize("chunk_rows", [1_000_000, 9, 60])
@pytest.mark.parametrize("failing", [0.5, 0.97, 1.0])
def test_login_failures_against_a_loop(spark, chunk_rows, failing):
    rng = random.Random(int(failing * 100))
    data = [
        (rng.choice([1, 1, 1, 2, 3]), "fail" if rng.random() < failing else "success", t)
        for t in sorted(rng.randint(0, 400) for _ in range(300))
    ]
    expected = []
    for user in (1, 2, 3):
        events = [(t, s == "fail") for u, s, t in data if u == user]
        expected += [(user, *r) for r in failure_runs(events, 5, 2) if r[2] >= 2]
    found = logins.login_failures(
        logins_df(spark, data),
        interval="5 seconds",
        order=("event_time", "seq"),
        chunk_rows=chunk_rows,
    ).select("userId", F.unix_seconds("first_fail"), F.unix_seconds("last_fail"), "fail_times")
    assert expected and rows(found) == sorted(expected)


@pytest.mark.parametrize("chunk_rows", [1_000_000, 11])
def test_rise_alerts_against_a_loop(spark, chunk_rows):
    rng = random.Random(2)
    data, value = [], 0.0
    for t in sorted(rng.sample(range(2000), 300)):
        value += rng.choice([1.0, 1.0, 1.0, 1.0, 1.0, 0.0, -2.0])
        data.append((len(data), "k", t, value))
    expected, start, last = [], None, None
    for _, _, t, v in data:
        if start is not None and t > start + 30:
            expected.append(start)
            start = None
        if last is not None:
            if v > last:
                start = t if start is None else start
            else:
                start = None
        last = v
    expected += [start] if start is not None else []
    df = with_event_time(
        spark.createDataFrame(data, "seq bigint, id string, timestamp bigint, v double")
    )
    found = detect.rise_alert(df, "id", "v", "30 seconds", chunk_rows=chunk_rows)
    seconds = found.select(F.unix_seconds("rise_start"), F.unix_seconds("alert_time"))
    assert expected and rows(seconds) == [(s, s + 30) for s in sorted(expected)]


def test_silence_after_a_rise_alerts_and_the_interval_end_still_cancels(spark):
    def alerts(points):
        df = with_event_time(
            spark.createDataFrame(
                [("k", t, v) for t, v in points], "id string, timestamp bigint, v double"
            )
        )
        found = detect.rise_alert(df, "id", "v", "10 seconds")
        return rows(found.select(F.unix_seconds("rise_start")))

    assert alerts([(0, 1.0), (5, 2.0)]) == [(5,)]
    assert alerts([(0, 1.0), (5, 2.0), (15, 2.0)]) == []
    assert alerts([(0, 1.0), (5, 2.0), (16, 2.0)]) == [(5,)]
    assert alerts([(0, 1.0), (5, 1.0)]) == []


@pytest.fixture(scope="module")
def clicks(spark):
    df = spark.createDataFrame(
        click_rows(),
        "seq bigint, userId bigint, adId bigint, province string, timestamp bigint",
    )
    return with_event_time(df)


def test_click_limit(clicks):
    passed, warnings = ads.click_blacklist(clicks, 100)
    assert passed.count() == len(click_rows()) - 30
    # The 101st click of the busy user is warned about, the 29 after it are dropped.
    assert rows(warnings) == [(7, 70, 100, "click over 100 times.")]


def test_clicks_by_province(clicks):
    expected = Counter()
    for _, _, _, province, at in click_rows():
        for k in range(1, 13):
            expected[province, (at // 300 + k) * 300] += 1
    found = ads.clicks_by_province(clicks)
    seconds = found.select("province", F.unix_seconds("window_end").alias("e"), "count", "window_end_text").collect()
    assert {(r.province, r.e): r["count"] for r in seconds} == expected
    for r in seconds:
        assert r.window_end_text == datetime.fromtimestamp(r.e, timezone.utc).strftime("%Y-%m-%d %H:%M:%S") + ".0"
    allowed = ads.clicks_by_province(clicks, exclude_blacklisted=True)
    assert allowed.where("province = 'north'").agg(F.max("count")).first()[0] == 100


@pytest.mark.parametrize("chunk_rows", [1_000_000, 6])
@pytest.mark.parametrize("reset", ["calendar_day", "rolling_24h"])
def test_click_limit_resets(spark, reset, chunk_rows):
    rng = random.Random(9)
    data = [
        (i, rng.choice([1, 1, 1, 2]), 7, t)
        for i, t in enumerate(sorted(rng.randint(0, 6 * DAY) for _ in range(60)))
    ]
    state, passed, warned = {}, set(), set()
    for seq, user, _, t in data:
        first, n = state.get(user, (t, 0))
        over = first // DAY != t // DAY if reset == "calendar_day" else t > first + DAY
        first, n = (t, 0) if over else (first, n)
        n += 1
        state[user] = (first, n)
        if n <= 2:
            passed.add(seq)
        elif n == 3:
            warned.add(seq)
    df = with_event_time(
        spark.createDataFrame(data, "seq bigint, userId bigint, adId bigint, timestamp bigint")
    )
    ok, warnings = ads.click_blacklist(df, 2, reset=reset, chunk_rows=chunk_rows)
    assert {r.seq for r in ok.collect()} == passed
    assert warned and {r.warned_at for r in warnings.collect()} == warned


def walked(openings, window, running=None):
    """What runs after (time, opens) rows, by a plain loop."""
    for at, opens in openings:
        if not opens:
            running = None
        elif running is None or at > running + window:
            running = at
    return running


@pytest.mark.parametrize("seed", range(6))
def test_step_functions_compose_to_the_walk(seed):
    import pandas as pd

    rng = random.Random(seed)
    none, window = episodes._NONE, 10
    at, chunks = 0, []
    for _ in range(40):
        chunk = []
        for _ in range(rng.randrange(1, 6)):
            at += rng.choice([0, 1, 3, 12])
            chunk.append((at, rng.random() > (0.02 if seed % 2 else 0.2)))
        chunks.append(chunk)
        at += 1  # rows of one instant share a chunk
    summarise = episodes._summarise([], window)
    steps = []
    for chunk in chunks:
        pdf = pd.DataFrame(chunk, columns=["__at", "__opens"]).assign(**{"__n": range(len(chunk)), "__chunk": 0})
        steps.append(episodes._as_step(summarise(pdf).iloc[0].to_dict()))
    for first in range(0, 40, 7):
        whole = steps[first]
        for k in range(first + 1, 40):
            whole = episodes.composed(whole, steps[k], window)
            rows = [r for c in chunks[first : k + 1] for r in c]
            for running in [None, *range(chunks[first][0][0] - 25, chunks[first][0][0])]:
                (found,) = episodes._applied(np.array([none if running is None else running]), whole, window)
                expected = walked(rows, window, running)
                assert found == (none if expected is None else expected)
            assert len(whole[3]) <= window + 2


def test_a_thousand_chunks(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for seq in range(2000):
        at += rng.choice([1, 1, 2, 40])
        rows.append((seq, 1, "fail" if rng.random() < 0.9 else "success", at))
    df = with_event_time(spark.createDataFrame(rows, "seq bigint, userId bigint, loginState string, timestamp bigint"))
    few = logins.login_failures(df, interval="10 seconds", chunk_rows=2)
    whole = logins.login_failures(df, interval="10 seconds")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect()))
