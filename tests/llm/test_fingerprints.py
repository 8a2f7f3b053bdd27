import hashlib

from eventlake.llm import parsing


def edited(texts):
    nexts = texts[1:] + texts[:1]
    return [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, nexts)]


def test_edited_texts_and_fingerprints(spark, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    texts = [t for _, t in rows]
    found = sorted(parsing.with_edited(docs, blocks=7).collect())
    changed = edited(texts)
    assert [r.doc_id for r in found] == [i for i, _ in rows]
    assert [r.n_chars for r in found] == list(map(len, texts))
    assert [r.edited_sha256 for r in found] == [hashlib.sha256(t.encode()).hexdigest() for t in changed]
    own = [parsing.to_text(s) for s in parsing.signatures(texts)]
    assert [r.fingerprint for r in found] == own
    assert [r.edited_fingerprint for r in found] == [parsing.to_text(s) for s in parsing.signatures(changed)]
    assert sum(r.near_edited > r.near_next for r in found) > 0.95 * len(found)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_number_of_blocks_does_not_matter(docs):
    assert sorted(parsing.with_edited(docs, blocks=1).collect()) == sorted(
        parsing.with_edited(docs, blocks=50).collect()
    )


def test_phrases_do_not_depend_on_where_a_stretch_lies(docs):
    text = max((r.text for r in docs.limit(50).collect()), key=len)[:6000]
    plain, moved = parsing.signatures([text, "Something before. " + text], most=10**6)
    assert len(set(plain) & set(moved)) > 0.95 * len(plain)
    other = parsing.signatures([text[::-1]], most=10**6)[0]
    assert len(set(plain) & set(other)) < 0.05 * len(plain)


def test_odd_rows(odd, none):
    found = parsing.with_edited(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found}
    assert by_id[2].fingerprint == by_id[3].fingerprint == "" and by_id[2].near_next == 1.0
    assert by_id[None].n_chars == 18  # sorts first, so its next is document 1
    assert len({r.fingerprint for r in found if r.doc_id == 1}) == 1
    assert parsing.with_edited(none).collect() == []


def test_one_document_is_its_own_next(docs):
    (row,) = parsing.with_edited(docs.where("doc_id = 0")).collect()
    assert row.near_next == 1.0
