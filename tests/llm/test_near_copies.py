import random

import pytest

import corpus_pipeline
from eventlake.llm import simhash
from tests.llm.conftest import SCHEMA, SF


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain_kept(rows):
    """The doc_ids that stay, comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in sets:
        for b in sets:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and both * 5 >= either * 4:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i for i in parent if root(i) == i}


def kept(spark, docs):
    return {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}


def test_stage_drops_copies_with_edits(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for group in range(8):
        base = rng.sample(words, 20 + 60 * group)
        for copy in range(4):
            text = list(base)
            for _ in range(copy * len(base) // 120):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((10 * group + copy, " ".join(text), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = plain_kept([(r[0], r[1]) for r in rows])
    assert len(expected) <= len(rows) // 2
    assert kept(spark, docs) == expected
    assert kept(spark, docs.limit(0)) == set()


def test_border_is_included(spark):
    nine = [f"w{i}" for i in range(9)]  # five shingles; the same with one word less has four
    rows = [(1, " ".join(nine), "en", "a", 0), (2, " ".join(nine[:8]), "en", "a", 0)]
    rows += [(3, " ".join(nine[1:8]), "en", "a", 0)]  # three of four
    assert kept(spark, spark.createDataFrame(rows, SCHEMA)) == plain_kept([(r[0], r[1]) for r in rows]) == {1, 3}


def test_groups_that_share_a_passage(spark, monkeypatch):
    # Near copies in several groups, all with the same words for a third of their texts; texts of the
    # shared words alone; and chains whose ends are not alike. Buckets are compared in every way.
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    shared = rng.sample(words, 40)
    rows = []
    for group in range(9):
        base = shared + rng.sample(words, rng.choice([3, 6, 12, 60]))
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text), "en", "a", 0))
    for k in range(6):
        rows.append((len(rows), " ".join(shared[k:] + rng.sample(words, k)), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = plain_kept([(r[0], r[1]) for r in rows])
    for bucket in (1, 4, 10_000):
        monkeypatch.setattr(simhash, "PAIRED_BUCKET", bucket)
        assert kept(spark, docs) == expected


def test_a_large_group_takes_few_comparisons(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(text), "en", "a", 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    sets = simhash.near_duplicates_by_shingles(docs, 5, 0.8)
    assert {r.component_id for r in sets.collect()} == {0}
    compared = []
    whole = simhash._Sets.verified

    def counting(self, pairs):
        pairs = simhash.written(pairs, "counted")
        compared.append(pairs.count())
        return whole(self, pairs)

    simhash._Sets.verified = counting
    try:
        assert kept(spark, docs) == {0}
    finally:
        simhash._Sets.verified = whole
    assert sum(compared) < 4 * len(rows)  # all pairs are 79,800


@pytest.mark.parametrize("common", [(0, 1 << 17, 48), (1, 7, 2), (10**9, 1, 10_000)])
def test_table_against_all_pairs_whatever_is_common(spark, docs, monkeypatch, common):
    monkeypatch.setattr(simhash, "COMMON_FROM", common[0])
    monkeypatch.setattr(simhash, "COMMON_MOST", common[1])
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", common[2])
    assert kept(spark, docs) == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_simhashes_offer_links_that_are_verified(spark, monkeypatch):
    """The stage takes the SimHash step, and what it links is compared as whole sets."""
    told, probe = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda reps, *most: told.append(reps.count()) or probe(reps, *most))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    # A sentence said very often decides all bits; the sets are of other shingles.
    often = "the same sentence again and " * 400
    rows = [(i, often + " ".join(rng.sample(words, 40)), "en", "a", 0) for i in range(4)]
    # One word in 500: within two bits as a rule, and alike by far more than 0.8.
    base = [rng.choice(words) for _ in range(500)]
    for i in range(10, 14):
        text = list(base)
        text[rng.randrange(500)] = "changed"
        rows.append((i, " ".join(text), "en", "a", 0))
    rows += [(20, rows[-1][1], "en", "b", 0), (None, rows[-1][1], "en", "b", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    linked = simhash.near_duplicates(docs).where("doc_id < 4 AND component_id = 0").count()
    told.clear()
    assert linked == 4
    assert kept(spark, docs) == {0, 1, 2, 3, 10, None}
    assert len(told) == 1
