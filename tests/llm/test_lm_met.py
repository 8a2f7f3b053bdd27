import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.llm import lm


def test_symbols_met_again_in_the_same_contexts_are_not_computed_again(monkeypatch):
    code = lm.Code.of(np.ones(lm.END + 1))
    rng = np.random.default_rng(2)
    tables = [rng.integers(0, 32, 1 << b).astype(np.uint8) for b in lm.TABLE_BITS]
    spread, sizes = lm.spread, []
    monkeypatch.setattr(lm, "spread", lambda c, symbols, *more: sizes.append(len(symbols)) or spread(c, symbols, *more))
    priced = lm.Costs(code, tables, lm.Mixer.new())
    texts = [b"one text and another one", None, b"more of it " * 30_000, b"\xff\x00 odd"]
    first = priced.of_texts(texts)
    computed = sum(sizes)
    assert priced.of_texts(texts) == pytest.approx(first, rel=1e-12)
    assert sum(sizes) - computed <= 10  # what shares its place with another
    # A table of two places forgets nearly all, and the costs stay.
    monkeypatch.setattr(lm, "MET_BITS", 1)
    assert lm.Costs(code, tables, lm.Mixer.new()).of_texts(texts) == pytest.approx(first, rel=1e-12)


def test_contexts_met_again_are_counted_as_often(docs):
    texts = [None if r.text is None else r.text.encode() for r in docs.select("text").collect()]
    code = lm.Code.of(np.ones(lm.END + 1))
    expected = [np.zeros((1 << b, 2), dtype=np.int64) for b in lm.TABLE_BITS]
    n = 0
    for symbols, starts, _ in lm._chunks(texts):
        _, bit, slots, length = lm.decisions(code, symbols, starts)
        n += int(length.sum())
        for table, slot in zip(expected, slots):
            np.add.at(table, (slot, bit), 1)
    expected = np.concatenate(expected)
    found = np.zeros((len(expected) + lm.GROUPS * lm.CELLS + (lm.END + 1) * lm.BINS, 2), dtype=np.int64)
    rows = lm.bit_counts(docs, F.lit(True), code).toArrow()
    found[rows.column("slot").to_numpy()] = np.stack([rows.column(c).to_numpy() for c in ("zeros", "ones")], 1)
    assert np.array_equal(found[: len(expected)], expected)
    joint, by_node = np.split(found[len(expected) :], [lm.GROUPS * lm.CELLS])
    assert joint.sum() == by_node.sum() == n
