"""Keyed processors on buckets of keys: one state for all keys of a bucket, results as for each key by itself."""

import random

import pandas as pd

from eventlake.streaming import processors, run
from tests.test_keyed_columns import Handle, Value
from tests.test_streaming import in_files, stream


class Counted(Value):
    writes = 0

    def update(self, value):
        Counted.writes += 1
        super().update(value)


class CountedHandle(Handle):
    def getValueState(self, *_):
        return Counted()


def test_a_bucket_is_read_and_written_once():
    """The cost of a micro-batch goes with buckets, not with keys: 500 keys are one state."""
    rng, seen = random.Random(3), {}
    processor = processors.RunningCount()
    processor.init(CountedHandle())
    Counted.writes = 0
    for batch in range(3):
        rows = [(rng.randrange(500), 2000 * batch + i) for i in range(2000)]
        frame = pd.DataFrame(rows, columns=["bucket_key0", "seq"])
        frame["null_bits"] = (frame["bucket_key0"] == 0).astype(int)
        found = pd.concat(list(processor.handleInputRows((7,), iter([frame]), None)))
        expected = set()
        for key, seq in rows:
            seen[key] = seen.get(key, 0) + 1
            expected.add((key or None, seq, seen[key]))
        assert {(None if pd.isna(k) else k, s, n) for k, s, n in found.itertuples(index=False)} == expected
    assert Counted.writes == 3


def test_null_and_large_keys_over_batches(spark):
    rng = random.Random(4)
    keys = [None, 0, (1 << 60) + 1, (1 << 60) + 2, -5]
    rows = [(i, rng.choice(keys), rng.choice(["a", None, ""])) for i in range(300)]
    df = spark.createDataFrame(rows, "seq BIGINT, id BIGINT, kind STRING")
    source = in_files(spark, df, "seq")
    seen, expected = {}, set()
    for seq, key, kind in rows:
        seen[key, kind] = seen.get((key, kind), 0) + 1
        expected.add((key, seq, kind, seen[key, kind]))
    found = run.drain(processors.category_counts_stream(stream(spark, source), "id", "kind"))
    assert set(map(tuple, found.collect())) == expected
    by_text = run.drain(processors.running_count_stream(stream(spark, source), "kind")).collect()
    counts = {}
    for seq, _, kind in rows:
        counts[kind] = counts.get(kind, 0) + 1
        assert (kind, seq, counts[kind]) in set(map(tuple, by_text))
