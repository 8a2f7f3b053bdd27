import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.llm import lm
from eventlake.llm.common import crc_of_id


def trained():
    return F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 1, F.lit(True))


def plain_scores(rows):
    """rows: (doc_id, text); (tokens, known, base score) by doc_id, and the training tokens."""
    bags = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    counts = Counter()
    for i, bag in bags:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(bag)
    total, distinct = sum(counts.values()), len(counts)
    below = total + 0.5 * (distinct + 1)
    return total, {
        i: (len(b), sum(w in counts for w in b), sum(math.log10((counts[w] + 0.5) / below) for w in b))
        for i, b in bags
    }


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 3])
def test_counts_and_scores(docs, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    total, expected = plain_scores([(r.doc_id, r.text) for r in docs.collect()])
    found = lm.score(docs, trained()).collect()
    for r in found:
        tokens, known, base = expected[r.doc_id]
        assert (r.train_tokens, r.n_tokens, r.n_known) == (total, tokens, known)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
    held = [r for r in found if not r.trained and r.n_tokens > 50]
    assert np.mean([r.bits_per_byte for r in held]) < 3.2  # learned; a byte holds eight


def test_probabilities_of_all_next_symbols_add_up_to_one():
    counts = np.ones(lm.END + 1)
    counts[ord("a") : ord("z")] = 50
    code = lm.Code.of(counts)
    assert sum(2.0 ** -int(n) for n in code.length) == pytest.approx(1)
    rng = np.random.default_rng(0)
    tables = [rng.integers(-3000, 3000, 1 << b).astype(np.int16) for b in lm.TABLE_BITS]
    mixer = lm.Mixer.new()
    # P(text, then x) summed over x is P(text): the end is one x, other bytes go on.
    text = b"abc ab"
    stem = np.array([*text], dtype=np.uint32)
    total = 0.0
    for symbol in range(lm.END + 1):
        symbols = np.append(stem, np.uint32(symbol))
        node, bit, slots, length = lm.decisions(code, symbols, np.array([0]))
        cost = lm.costs(mixer.cost_table(), node, bit, mixer.mixed(*mixer.inputs(tables, slots)))
        total += math.exp(-cost[-int(length[-1]) :].sum(dtype=np.float64))
    assert total == pytest.approx(1, rel=1e-3)


def test_scores_do_not_depend_on_company_and_long_texts_are_whole():
    code = lm.Code.of(np.ones(lm.END + 1))
    rng = np.random.default_rng(1)
    tables = [rng.integers(-3000, 3000, 1 << b).astype(np.int16) for b in lm.TABLE_BITS]
    mixer = lm.Mixer.new()
    long = b"word so far, " * 20_000
    texts = [b"one", long, b"", None, b"two words", b"one"]
    together = lm.text_costs(texts, code, tables, mixer)
    assert together[0] == together[5] and together[2] == together[3]
    for text, cost in zip(texts, together):
        assert lm.text_costs([text], code, tables, mixer)[0] == pytest.approx(cost, rel=1e-6)
    assert together[1] > 19_000 * together[4] / 2


def test_odd_rows(odd, odd_rows, none):
    found = lm.score(odd, trained()).collect()
    assert len(found) == len(odd_rows)
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].n_tokens == by_id[3].n_tokens == by_id[4].n_tokens == 1
    assert by_id[2].score == by_id[3].score and by_id[2].bits_per_byte is None
    untrained = lm.score(odd, F.lit(False)).collect()
    assert all(r.train_tokens == r.n_known == 0 and r.base_score == 0 for r in untrained)
    assert lm.score(none, trained()).collect() == []


def test_contexts_of_bytes_are_found_once(monkeypatch):
    """The contexts of fewer bytes are those of more, cut; powers kept from other texts change no hash."""
    calls, found = [], lm._before
    monkeypatch.setattr(lm, "_before", lambda *given: calls.append(given[2]) or found(*given))
    code = lm.Code.of(np.ones(lm.END + 1))
    symbols, starts = lm._symbols([b"ab cd", b"", b"x", b"long " * 9])
    first = lm.decisions(code, symbols, starts)
    assert calls == [4]
    lm.decisions(code, *lm._symbols([b"word " * 40_000]))
    again = lm.decisions(code, symbols, starts)
    for order, slots, more in zip(lm.ORDERS, first[2], again[2]):
        assert np.array_equal(slots, more)
        if order:  # equal contexts have equal slots for the same decision
            context = np.repeat(found(symbols, starts, order), first[3])
            at = {}
            for c, n, s in zip(context.tolist(), first[0].tolist(), slots.tolist()):
                assert at.setdefault((c, n), s) == s
