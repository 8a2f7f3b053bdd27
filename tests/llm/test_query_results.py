"""The registered queries' own columns, each against plain code, on the smallest tables."""

import hashlib
import re
import zlib

import pytest
import xxhash

from eventlake.llm import queries
from tests.llm import test_lm, test_mixing, test_neighbours, test_private
from tests.llm.conftest import SF


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def by_id(df, *columns):
    assert set(columns) <= set(df.columns)
    df = df.select(columns[0], *[c for c in df.columns if c != columns[0]])
    rows = df.collect()
    found = {r[0]: r for r in rows}
    assert len(found) == len(rows)
    return found


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, texts):
    found = by_id(queries.op1_document_fingerprints(spark, SF), "doc_id", "n_chars", "edited_sha256", "fingerprint")
    ids = sorted(texts)
    assert sorted(found) == ids
    prints = {}
    for doc, following in zip(ids, ids[1:] + ids[:1]):
        text, other, r = texts[doc] or "", texts[following] or "", found[doc]
        gone = len(text) // 2
        edited = text[: len(text) - gone] + other[:gone]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        for whole, fingerprint in ((text, r.fingerprint), (edited, r.edited_fingerprint)):
            assert prints.setdefault(whole, fingerprint) == fingerprint
        if edited == text:
            assert r.near_edited == 1
        if other == text:
            assert r.near_next == 1
    # Half of the text is as it was, and little of the next document is in it.
    long = [found[d] for d in ids if len(texts[d] or "") > 400]
    assert sum(r.near_edited for r in long) > 3 * sum(r.near_next for r in long)


def test_op2(spark, texts):
    found = by_id(queries.op2_personal_data(spark, SF), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert sorted(found) == sorted(texts)
    for doc, text in texts.items():
        base, r = test_private.brute(text or ""), found[doc]
        assert r.base_sha256 == sha(base)
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert {s for s in base.split(",") if s} <= set(r.spans.split(","))


def simhash(text):
    words = text.translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", words) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op5(spark, texts):
    found = by_id(queries.op5_simhash(spark, SF), "doc_id", "fingerprint", "component_id")
    values = {d: simhash(t or "") for d, t in texts.items()}
    assert {d: r.fingerprint for d, r in found.items()} == {d: f"{v:016x}" for d, v in values.items()}
    smallest = {d: d for d in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin(values[a] ^ values[b]).count("1") <= 2 and smallest[b] < smallest[a]:
                    smallest[a], changed = smallest[b], True
    assert {d: r.component_id for d, r in found.items()} == smallest


def test_op6(spark, texts):
    found = by_id(queries.op6_lm_scores(spark, SF), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    total, expected = test_lm.plain_scores(list(texts.items()))
    for doc, (tokens, known, base) in expected.items():
        r = found[doc]
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_op8(spark):
    found = by_id(queries.op8_embedding_near_duplicates(spark, SF), "vec_id", "n_links", "component_id", "kept")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    expected = test_neighbours.plain([(r.vec_id, r.embedding) for r in vectors])
    assert {i: (r.n_links, r.component_id) for i, r in found.items()} == expected
    assert all(r.kept == (i == r.component_id) for i, r in found.items())


def test_op9(spark, docs, texts):
    found = by_id(queries.op9_language(spark, SF), "doc_id", "held_out", "lang_pred", "score")
    langs = {r.doc_id: r.lang for r in docs.collect()}
    known = {v for d, v in langs.items() if v is not None}
    right = asked = 0
    for doc, text in texts.items():
        r = found[doc]
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= r.score <= 1
        lettered = any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == (not lettered) and (r.lang_pred in known) == lettered
        if r.held_out and lettered and len(text) > 100 and langs[doc] is not None:
            asked += 1
            right += r.lang_pred == langs[doc]
    assert right >= 0.8 * asked > 0


def test_op10(spark, docs, texts):
    out = queries.op10_mixing(spark, SF)
    found = by_id(out, "doc_id", "size", "source_size", "target", "taken")
    sources = {r.doc_id: r.source for r in docs.collect()}
    count = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts.items()}
    assert {d: r.size for d, r in found.items()} == count
    rows = spark.createDataFrame(
        [(sources[d], *r) for d, r in found.items()], f"source STRING, {', '.join(f'{c} {t}' for c, t in out.dtypes)}"
    )
    test_mixing.check(rows.collect())
