"""Tasks get texts in batches of bounded bytes, whatever a row's size."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlake.llm import common

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])


def test_batches_are_cut_by_bytes(spark):
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 2000).cast("binary").alias("text"))
    before = spark.conf.get(CONF)
    found = common.written(texts.mapInArrow(sizes, "n BIGINT, bytes BIGINT"), "batch-sizes").collect()
    assert sum(r.n for r in found) == 4000
    assert max(r.bytes for r in found) <= common.BATCH_BYTES + 20_000
    assert spark.conf.get(CONF) == before


@pytest.mark.parametrize("limit, expected", [("1048576", 1 << 20), ("1g", common.BATCH_BYTES), ("512k", 512 << 10)])
def test_a_smaller_limit_stays_and_comes_back_after_a_failure(spark, limit, expected):
    before = spark.conf.get(CONF)
    try:
        spark.conf.set(CONF, limit)
        with pytest.raises(ValueError), common.small_batches(spark):
            assert int(spark.conf.get(CONF).rstrip("b")) == expected
            raise ValueError
        assert spark.conf.get(CONF) == limit
    finally:
        spark.conf.set(CONF, before)
