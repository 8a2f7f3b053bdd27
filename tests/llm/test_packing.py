import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from eventlake.llm import packing


def check(found, docs, window=packing.WINDOW_TOKENS):
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    expected = {}
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected.setdefault(r.doc_id, []).append(np.asarray(ids, dtype="<u4"))
    sequences, pieces = {}, {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    assert set(pieces) == set(expected)
    for doc_id, arrays in expected.items():
        if len(arrays) == 1:
            (ids,) = arrays
            rows = sorted(pieces[doc_id], key=lambda r: r.start)
            assert [r.start for r in rows] == [sum(q.length for q in rows[:k]) for k in range(len(rows))]
            assert sum(r.length for r in rows) == len(ids) == rows[0].doc_tokens
            for r in rows:
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        else:
            assert sum(r.length for r in pieces[doc_id]) == sum(map(len, arrays))
    used = [sum(r.length for r in rows) for rows in sequences.values()]
    padded = [n if n & (n - 1) == 0 else window for n in used]
    return 1 - sum(used) / max(1, sum(padded))


def test_pieces_and_padding(docs):
    assert check(packing.pack(docs).collect(), docs) < 0.03


def test_odd_rows(odd, none):
    check(packing.pack(odd).collect(), odd)
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_up_the_histogram(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(1024, dtype=np.int64)
    chosen = rng.integers(1, 1024, 300 if seed else 3)
    np.add.at(histogram, chosen, rng.integers(1, 2000, len(chosen)))
    used = np.zeros_like(histogram)
    for repeats, filling in packing.patterns(histogram):
        assert repeats > 0 and sum(a * t for a, t in filling.items()) <= 2048
        for a, t in filling.items():
            used[a] += repeats * t
    assert (used == histogram).all()


def test_least_squares_fits_what_combinations_can_make():
    combos = [{600: 2, 848: 1}, {1000: 2, 48: 1}]
    histogram = np.zeros(1024)
    histogram[[600, 848, 1000, 48]] = [200, 100, 40, 20]
    assert np.allclose(packing.repeat_counts(combos, histogram), [100, 20], atol=1e-3)


def test_words_as_in_whole_texts():
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.WordTokens(packing.tokenizer_path(), most=10)
    texts = [
        "Hello, WORLD. it's 7.5, x7. don't.. <|endoftext|> a<|ENDOFTEXT|>b", "é É. é. \xa0 İI 'S. ...,. 77, a, .",
        "ΣΑΣ ΣΑΣ. \x1ca\x85b ́x, ﬁ. 3, 中文。, 1́. ​. 😀. 😀a. 7", "á b", "",
    ]
    for _ in range(2):
        found = encode([t.encode() for t in texts] + [None])
        assert [np.frombuffer(f, "<u4").tolist() for f in found] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in texts
        ] + [[]]
