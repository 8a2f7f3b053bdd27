import random

import numpy as np
import pytest
import xxhash

from eventlake.llm import simhash
from eventlake.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(pairs):
    """pairs: (node, fingerprint); the smallest node reachable within two bits."""
    parent = {n: n for n, _ in pairs}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for i, (a, x) in enumerate(pairs):
        for b, y in pairs[:i]:
            if (x ^ y).bit_count() <= 2:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {n: root(n) for n, _ in pairs}


def test_against_all_pairs(docs):
    rows = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in found} == rows
    assert {r.doc_id: r.component_id for r in found} == plain_components(sorted(rows.items()))


def test_hash_is_the_engines_own(spark):
    from pyspark.sql import functions as F

    (row,) = spark.createDataFrame([("un êté ici",)], "s STRING").select(F.xxhash64("s").alias("h")).collect()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("un êté ici".encode(), 42)


@pytest.mark.parametrize("paired", [2, 10_000])
def test_links_join_the_same_groups_whatever_is_paired(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    rng = random.Random(paired)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            f = centre
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    pairs = list(enumerate(sorted(fps)))
    signed = [(f - 2**64 if f >> 63 else f, n) for n, f in pairs]
    reps = spark.createDataFrame(signed, "fp BIGINT, rep BIGINT")
    for parts in (None, [(list(range(32)), 1), (list(range(32, 64)), 0)]):
        if parts:
            monkeypatch.setattr(simhash, "choose_parts", lambda *_, p=parts: p)
        found = {n: n for n, _ in pairs}
        found |= {r.node: r.component for r in components(simhash.links(reps)).collect()}
        assert found == plain_components(pairs)


def test_allocation_is_the_cheapest():
    costs = [{-1: 0, 0: 10, 1: 40}, {-1: 0, 0: 3, 1: 9}, {-1: 0, 0: 20, 1: 90}]
    assert simhash.allocate(costs, 0) == (19, [0, 1, -1])


def test_correlated_bits_go_together():
    near = np.eye(64)
    near[3, 60] = near[60, 3] = near[3, 9] = near[9, 3] = 0.9
    groups = simhash.group_bits(near, 3)
    assert sorted(sum(groups, [])) == list(range(64)) and {3, 9, 60} <= set(groups[0])


def test_components_of_long_and_wide_graphs(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 40)] + [(5, 5), (200, 199), (199, 200)]
    found = components(spark.createDataFrame([*edges, (1, None)], "a BIGINT, b BIGINT")).collect()
    expected = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 40)} | {199: 199, 200: 199}
    assert {r.node: r.component for r in found} == expected


def test_odd_rows(odd, none):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found}
    assert {by_id[i].component_id for i in (2, 3, 4)} == {2} and by_id[2].fp == 0
    assert by_id[8].component_id == 1 and by_id[None].component_id is None
    kept = simhash.keep_one(odd)
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 2, 5, 6, 7] and kept.columns == odd.columns
    assert simhash.near_duplicates(none).collect() == []
