from eventlake.plans.registry import _Tables
from eventlake.streaming import run


def test_each_micro_batch_is_one_whole_part(spark, tmp_path, request):
    """Files of very unequal ids, so that parts differ in how many splits have rows of theirs."""
    splits = [[*range(60), None], *([list(range(i, 20, 9)) for i in range(5)])]
    for ids in splits:
        rows = spark.createDataFrame([(i,) for i in ids], "event_id BIGINT").coalesce(1)
        rows.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    request.addfinalizer(lambda: spark.conf.set(size, before))
    spark.conf.set(size, "2000")  # a split is a file
    table = spark.read.parquet(f"{tmp_path}/events.parquet")
    assert table.rdd.getNumPartitions() > 3  # several files for each of three parts
    batches = []

    def keep(batch, batch_id):
        batches.append([r.event_id for r in batch.collect()])

    run.drain_batches(_Tables(spark, str(tmp_path)).in_batches("events", "event_id"), keep)
    found = [x for b in batches for x in b]
    assert sorted(found, key=str) == sorted((x for s in splits for x in s), key=str)
    assert len(batches) == 3 and None in batches[0]
    ranges = [[x for x in b if x is not None] for b in batches]
    assert all(max(a) < min(b) for a, b in zip(ranges, ranges[1:]))
