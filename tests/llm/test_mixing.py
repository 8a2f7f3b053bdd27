import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from eventlake.llm import mixing
from eventlake.llm.common import written


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped = set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / total for s in names}
        above = {s for s in names if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


def check(found, slack=1.0):
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    target = plain_targets(sizes)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source], rel=1e-9)
    for source in sizes:
        assert abs(taken[source] - target[source]) <= slack


def test_targets_and_what_is_taken(docs):
    found = mixing.mix(docs).collect()
    check(found)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    counts = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.size for r in found} == counts


@pytest.mark.parametrize("slices", [1, 3, 4096])
def test_number_of_slices(docs, slices):
    check(mixing.mix(docs, slices=slices).collect())


def test_many_sources_keep_their_weights(spark):
    names = spark.range(50).select(F.concat(F.lit("é\U0001f600"), F.col("id").cast("string")).alias("source"))
    found = mixing.cyclic_weights(names.union(spark.createDataFrame([(None,)], "source STRING"))).collect()
    order = sorted((r.source for r in found if r.source), key=lambda s: s.encode()) + [None]
    assert {r.source: r.weight for r in found} == {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}


def test_odd_rows(odd, none):
    found = mixing.mix(odd).collect()
    assert len(found) == odd.count()
    check(found)
    assert mixing.mix(none).collect() == []
    assert mixing.repeated(none).collect() == []


def test_repeated_rows_hold_the_words_taken(docs):
    mixed = written(mixing.mix(docs), "test-mixed")
    rows = mixing.repeated(docs)
    assert rows.columns == docs.columns
    words = rows.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n"))
    expected = {r.doc_id: r.taken for r in mixed.collect() if r.taken}
    assert {r.doc_id: r.n for r in words.collect()} == expected
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert all(whole[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in rows.collect())


def test_rows_without_or_with_the_same_doc_id_are_taken_each_by_itself(spark):
    rows = [(None, f"n{i} " * (i + 1), "a") for i in range(8)] + [(7, f"s{i} " * (i + 2), "a") for i in range(5)]
    rows += [(7, "same words here", "b")] * 6 + [(None, "same words here", "b")] * 6
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").withColumn("size", F.lit("x"))
    mixed = mixing.mix(docs).collect()
    check(mixed)
    out = mixing.repeated(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in out.collect():
        taken[r.source, r.text.split()[0]] += len(r.text.split())
        assert r.size == "x"
    by_source = Counter()
    for r in mixed:
        by_source[r.source] += r.taken
    for source in "ab":
        assert sum(n for (s, _), n in taken.items() if s == source) == by_source[source]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source, text.split()[0]] += len(text.split())
    assert all(n <= 2 * sizes[k] for k, n in taken.items())


def test_unsettled_targets_are_an_error(spark):
    sources = spark.createDataFrame([(f"s{i:02d}", 4 ** i, 1.0) for i in range(12)], "source STRING, source_size BIGINT, weight DOUBLE")
    with pytest.raises(RuntimeError):
        mixing.water_fill(sources, rounds=2)
    assert mixing.water_fill(sources).where("target > 2 * source_size").isEmpty()
