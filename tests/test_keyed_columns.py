"""Columnar keyed processors against row-by-row loops, and user functions folded by chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.operators import rolling
from eventlake.streaming import processors


class Value:
    """A value or list state in memory."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update

    def clear(self):
        self.held = None


class Entries(dict):
    def getValue(self, key):
        return self[key]

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value


class Handle:
    def getValueState(self, *_):
        return Value()

    getListState = getValueState

    def getMapState(self, *_):
        return Entries()

    def registerTimer(self, at_ms):
        self.timer = at_ms


def in_pieces(processor, batches, key=("k",)):
    """Output rows of micro-batches, each handed over in Arrow batches of a few rows, in any order."""
    import pandas as pd

    processor.init(Handle())
    rng, out = random.Random(1), []
    for batch in batches:
        rows = list(batch)
        rng.shuffle(rows)
        size = rng.randrange(1, 4)
        frames = [pd.DataFrame(rows[i : i + size], columns=list(processor.columns)) for i in range(0, len(rows), size)]
        for found in processor.handleInputRows(key, iter(frames), None):
            out += list(map(tuple, found.itertuples(index=False)))
    return out


def batches_of(rows, seed):
    rng, out = random.Random(seed), []
    while rows:
        n = rng.randrange(1, 6)
        out.append(rows[:n])
        rows = rows[n:]
    return out


VALUES = [round(random.Random(4).uniform(0, 40), 2) for _ in range(60)]


@pytest.mark.parametrize("seed", range(4))
def test_values_in_arrival_order(seed):
    rows = list(enumerate(VALUES))
    batches = batches_of(rows, seed)
    found = in_pieces(processors.JumpAlert(10.0), batches)
    assert found == [("k", i, a, b) for i, (a, b) in enumerate(zip(VALUES, VALUES[1:]), 1) if abs(a - b) >= 10]
    found = in_pieces(processors.OverRows(2), batches)
    frames = [VALUES[max(0, i - 2) : i + 1] for i in range(len(VALUES))]
    assert [(f[1], f[2]) for f in found] == [(i, len(v)) for i, v in enumerate(frames)]
    assert np.allclose([f[3] for f in found], [np.mean(v) for v in frames])
    found = in_pieces(processors.CountWindowAvg(10, 2), batches)
    assert [(f[1], f[2]) for f in found] == [(i, i + 1) for i in range(1, len(VALUES), 2)]
    assert np.allclose([f[3] for f in found], [np.mean(VALUES[max(0, i - 9) : i + 1]) for i in range(1, len(VALUES), 2)])
    found = in_pieces(processors.Changelog(), batches)
    expected, total = [], 0.0
    for i, v in rows:
        expected += [("k", i, "-", i, total)] if i else []
        total += v
        expected.append(("k", i, "+", i + 1, total))
    assert found == expected
    counts = in_pieces(processors.RunningCount(), [[(i,) for i, _ in b] for b in batches])
    assert counts == [("k", i, i + 1) for i, _ in rows]


def test_null_values_differ_by_nothing():
    batches = [[(0, 1.0), (1, None)], [(2, 50.0), (3, 80.0)], [(4, None)], [(5, 1.0)]]
    assert in_pieces(processors.JumpAlert(10.0), batches) == [("k", 3, 50.0, 80.0)]


def clicks(rows, limit, rolling_day):
    day, first, n, out = 86_400_000_000, None, 0, []
    for seq, at in rows:
        over = first is None or (at > first + day if rolling_day else at // day != first // day)
        if over:
            first, n = at, 0
        if n <= limit:
            n += 1
            out.append(("k", "a", seq, "pass" if n <= limit else "warn"))
    return out


@pytest.mark.parametrize("reset", ["calendar_day", "rolling_24h"])
@pytest.mark.parametrize("limit", [1, 3])
def test_click_limits(reset, limit):
    rng = random.Random(limit)
    hour, at, rows = 3_600_000_000, 0, []
    for seq in range(200):
        at += rng.choice([-2, 0, 1, 1, 5, 30]) * hour // 3
        rows.append((seq, max(at, 0)))
    for seed in range(3):
        found = in_pieces(processors.ClickLimit(limit, reset), batches_of(rows, seed), ("k", "a"))
        assert found == clicks(rows, limit, reset == "rolling_24h")


def test_counts_by_category():
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", None, "c"])) for i in range(80)]
    seen, expected = {}, []
    for i, c in rows:
        seen[c] = seen.get(c, 0) + 1
        expected.append((i, c, seen[c]))
    found = in_pieces(processors.CountsByCategory(), batches_of(rows, 3))
    assert [(s, c if isinstance(c, str) else None, n) for _, s, c, n in found] == expected


def joined(a, b):
    """Associative, not commutative."""
    return a[0] + b[0], b[1], max(a[2], b[2])


@pytest.mark.parametrize("chunk_rows", [1, 3, 10, 1000])
def test_user_reduce_at_any_chunk_size(spark, chunk_rows):
    rng = random.Random(7)
    rows = [(i, rng.choice(["x", "x", "x", "y", "z"]), chr(97 + i % 26), rng.random(), rng.randrange(99)) for i in range(120)]
    df = spark.createDataFrame(rows, "seq BIGINT, id STRING, word STRING, at DOUBLE, n INT").repartition(5)
    found = rolling.rolling_reduce_user(df, "id", ["word", "at", "n"], joined, chunk_rows=chunk_rows)
    assert found.columns == ["id", "seq", "word", "at", "n"]
    so_far, expected = {}, []
    for seq, key, *new in rows:
        so_far[key] = joined(so_far[key], tuple(new)) if key in so_far else tuple(new)
        expected.append((key, seq, *so_far[key]))
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert rolling.rolling_reduce_user(df.limit(0), "id", ["n"], joined).collect() == []


def test_null_keys_are_a_key(spark):
    df = spark.createDataFrame([(1, None, 2), (2, None, 3), (3, "a", 1)], "seq BIGINT, id STRING, n INT")
    for chunk_rows in (1, 100):
        found = rolling.rolling_reduce_user(df, "id", ["n"], lambda a, b: (a[0] + b[0],), chunk_rows=chunk_rows)
        assert {(r.id, r.seq, r.n) for r in found.collect()} == {(None, 1, 2), (None, 2, 5), ("a", 3, 1)}
