"""What a stage leaves on disk: no shuffle files of written tables, no whole texts or shingle sets as scratch tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlake.llm import common, language, simhash
from tests.llm.conftest import SCHEMA, SF

CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture()
def tables(monkeypatch):
    """(purpose, columns' types) of what the modules write."""
    told = []

    def telling(df, purpose):
        told.append((purpose, dict(df.dtypes)))
        return common.written(df, purpose)

    for module in (simhash, language):
        monkeypatch.setattr(module, "written", telling)
    return told


def shuffles(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(p) for d in manager.localDirs() for p in Path(d.toString()).rglob("shuffle_*.data")}


def test_shuffles_go_with_the_job_that_wrote_a_table(spark):
    before, conf = shuffles(spark), spark.conf.get(CONF, None)
    found = common.written(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "scratch-counts")
    assert shuffles(spark) <= before
    assert spark.conf.get(CONF, None) == conf
    assert found.agg(F.sum("count")).first()[0] == 1000


def test_sets_are_compared_without_a_table_of_sets(spark, tables, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(2000)]
    base = rng.sample(words, 200)
    rows = []
    for i in range(30):
        text = list(base)
        for _ in range(rng.randrange(24)):
            text[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(text), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = {i: simhash._sets([t.encode()], 5)[0] for i, t, *_ in rows}
    key = {i: simhash._set_key(s) for i, s in sets.items()}
    key = {i: k - (1 << 64) if k >> 63 else k for i, k in key.items()}
    reps = spark.createDataFrame([(k, i) for i, k in key.items()], "key BIGINT, rep BIGINT")
    both = [(a, b, 0.8 / 1.8 * (len(sets[a]) + len(sets[b]))) for a in range(5) for b in range(a + 1, 30)]
    pairs = spark.createDataFrame([(key[a], key[b], least) for a, b, least in both], "a BIGINT, b BIGINT, least DOUBLE")
    expected = {(key[a], key[b]) for a, b, least in both if len(set(sets[a]) & set(sets[b])) >= least}
    assert 0 < len(expected) < len(both)
    for block, sent in ((64, 10**6), (3, 10**6), (3, 0)):
        monkeypatch.setattr(simhash, "COMPARED_BLOCK", block)
        monkeypatch.setattr(simhash, "SENT_COMPARISONS", sent)
        found = simhash._Sets(docs, reps, 5, 0.8).verified(pairs)
        assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert tables and not any("array" in kind for _, columns in tables for kind in columns.values())


def test_language_stage_writes_no_texts(spark, tables):
    rows = [(1, "the cat sat on the mat", "en", "a", 0), (2, None, "en", "a", 0), (3, "12 34", None, "a", 0)]
    rows += [(None, "der hund lief", "de", "b", 0), (3, "der hund lief", None, "b", 0), (3, "12 34", "en", None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[3], rows[4]], key=repr)
    assert tables and not any("text" in columns for _, columns in tables)
