"""Groups of near copies with texts beside them that are alike, but not by enough."""

import random

import pytest

import corpus_pipeline
from eventlake.llm import common, simhash
from tests.llm.conftest import SCHEMA, SF
from tests.llm.test_near_copies import kept, plain_kept


def group(rng, base, edits, words):
    text = list(base)
    for place in rng.sample(range(len(base)), edits):
        text[place] = rng.choice(words)
    return " ".join(text)


def test_texts_beside_a_large_group_meet_few_of_it(spark, monkeypatch):
    # Copies with up to one word changed link; those with five and more share two thirds and link with none.
    rng = random.Random(4)
    words = [f"w{i}" for i in range(50_000)]
    base = rng.sample(words, 120)
    rows = [(i, group(rng, base, i % 2, words), "en", "a", 0) for i in range(100)]
    rows += [(i, group(rng, base, 5 + i % 3, words), "en", "a", 0) for i in range(100, 180)]
    docs = spark.createDataFrame(rows, SCHEMA)
    compared = []

    def counting(df, purpose):
        out = common.written(df, purpose)
        if purpose == "simhash-candidates":
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "written", counting)
    expected = plain_kept([(r[0], r[1]) for r in rows])
    assert 60 < len(expected) < 100
    assert kept(spark, docs) == expected
    assert sum(compared) < 6 * len(rows)  # 1,366 when the large bucket was split by a second shingle


@pytest.mark.parametrize("paired", [1, 6, 48])
def test_parts_of_texts_and_rows_with_equal_or_no_ids(spark, monkeypatch, paired):
    # Texts, and the same with words cut off their ends, up to the border; some edited; all share a passage.
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    rng = random.Random(paired)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.sample(words, 30)
    rows = []
    for _ in range(8):
        base = passage + rng.sample(words, rng.choice([4, 9, 40]))
        for cut in (0, 0, 1, 3, 6, 9):
            rows.append((len(rows), group(rng, base, rng.choice([0, 0, 1, 2]), words)[: -6 * cut or None], "en", "a", 0))
    expected = plain_kept([(r[0], r[1]) for r in rows])
    again = [rows[3], rows[10], (None, rows[5][1], "en", "a", 0)]
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows + again, SCHEMA), SF).collect()
    ids = [r.doc_id for r in found]
    assert set(ids) - {None} == expected
    assert ids.count(None) == 1 and ids.count(3) == 2 * (3 in expected)


def test_a_text_without_id_is_no_link(spark):
    # Held by a row without doc_id only: it stays and names no group.
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:k] + ["x", *base[k + 1 :]]) for k in (0, 30, 60)]
    for order in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        rows = [(i, texts[k], "en", "a", 0) for i, k in zip((None, 1, 2), order)]
        assert kept(spark, spark.createDataFrame(rows, SCHEMA)) == {None, 1}
