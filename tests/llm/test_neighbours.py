import numpy as np
import pytest

from eventlake.llm import neighbours
from tests.llm.conftest import SF


def plain(rows, threshold=0.9):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    unit = [v / np.linalg.norm(v) for _, v in good]
    parent = {i: i for i, _ in good}
    links = {i: 0 for i, _ in good}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(good)):
        for b in range(a):
            if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[good[a][0]] += 1
                links[good[b][0]] += 1
                low, high = sorted((root(good[a][0]), root(good[b][0])))
                parent[high] = low
    return {i: (links[i], root(i)) for i, _ in good}


def test_planted_groups(spark):
    rng = np.random.default_rng(3)
    vectors = list(rng.normal(size=(300, 24)))
    for size in (2, 5, 40, 300):  # the last is larger than a block
        centre = rng.normal(size=24)
        vectors += [centre + 0.12 * rng.normal(size=24) for _ in range(size)]
    vectors += [vectors[0]] * 30  # copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = neighbours.near_duplicates(df).collect()
    expected = plain(rows)
    assert {r.vec_id for r in found} == set(expected)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == expected
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def crowds(size, dims=16, spread=0.012, apart=0.355):
    """Two groups, each close together, all cosines between them a little above 0.9."""
    rng = np.random.default_rng(size)
    one, two = np.zeros(dims), np.zeros(dims)
    one[0], two[0], two[1] = 1, np.cos(apart), np.sin(apart)
    vectors = [c + spread * rng.normal(size=dims) for c in (one, two) for _ in range(size)]
    vectors += list(rng.normal(size=(20, dims)))
    return [(i, v.tolist()) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("size", [120, 1000])
def test_groups_whose_lists_are_full_of_their_own(spark, size):
    rows = crowds(size)
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, v in rows])
    near = unit @ unit.T >= 0.9
    assert near[: 2 * size, : 2 * size].all()
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert {i: n for i, (n, _) in found.items()} == dict(enumerate((near.sum(axis=1) - 1).tolist()))
    assert {found[i][1] for i in range(2 * size)} == {0}


def test_chain_of_groups_and_exhaustive_search(spark):
    # Groups in a ring, neighbours linked by some of their members only.
    rng = np.random.default_rng(9)
    rows, dims = [], 12
    for g in range(12):
        centre = np.zeros(dims)
        centre[0], centre[1] = np.cos(g * 0.47), np.sin(g * 0.47)
        rows += [(len(rows) + i, (centre + 0.02 * rng.normal(size=dims)).tolist()) for i in range(40)]
    expected = plain(rows)
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()} == expected
    # An audit that nothing satisfies ends in the search in blocks.
    found = neighbours.near_duplicates(df, rounds=1, least_recall=1.1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == expected


def test_given_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    expected = plain([(r.vec_id, r.embedding) for r in df.collect()])
    found = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    assert found == expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]),
        (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0]), (10, [1e-300, 0.0]), (None, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").selectExpr("*", "'x' AS links", "1 AS id")
    found = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(df).collect()]
    assert len(found) == len(rows)
    assert {f for f in found if f[0] in (1, 2, 10)} == {(1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False)}
    assert {f[1:] for f in found if f[0] in (3, 4, 5, 6, 7, 8, 9)} == {(0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)}
    assert (None, 0, None, True) in found
    assert neighbours.near_duplicates(df.limit(0)).collect() == []
