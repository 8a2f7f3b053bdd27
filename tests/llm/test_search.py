import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlake.llm import queries, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, most=50):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, ts) for d, ts in held if ts]
    total, length = len(held), sum(len(ts) for _, ts in held)
    df = {}
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for d, ts in held:
            m = 50 + 50 * len(ts) * total // length
            score = 0
            for t in set(terms(text)) & set(ts):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                tf = ts.count(t)
                score += w * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, d is not None, d))
        scored.sort()
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:most], 1)]
    return sorted(out, key=repr)


def found(docs, items, **kwargs):
    return sorted(map(tuple, search.ranked(docs, items, **kwargs).collect()), key=repr)


def test_query(spark, docs):
    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = queries.op11_lexical_search(spark, sf)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, out.collect()), key=repr) == expected


@pytest.mark.parametrize("limits", [{}, {"shard_entries": 60}, {"most": 3}, {"most": 3, "shard_entries": 100, "block_bytes": 40}])
def test_ties_shards_and_blocks(spark, limits):
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma9", "ÉTÉ", "été", "d-e", "zz"]
    docs = [(i, " ".join(rng.choices(words, [8, 4, 3, 2, 2, 1, 1], k=rng.randrange(0, 12)))) for i in range(120)]
    docs += [(200 + i, "beta gamma9") for i in range(80)] + [(None, "beta gamma9"), (None, None), (5, "alpha alpha"), (5, "alpha alpha")]
    items = [(1, "alpha BETA beta"), (2, "ÉTÉ d,e"), (2, "zz gamma9 alpha"), (3, None), (4, "..."), (5, "unknown"), (None, "beta")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    asked = spark.createDataFrame(items, "item_id BIGINT, text STRING")
    assert found(df, asked, **limits) == brute(docs, items, limits.get("most", 50))


def test_odd_rows(spark, odd, odd_rows, none):
    items = spark.createDataFrame([(1, "word epsilon one")], "item_id BIGINT, text STRING").select("*", F.lit(1).alias("place"))
    clashing = odd.select("*", *(F.lit(1).alias(c) for c in ("n", "ids", "shard", "deal", "query", "rank")))
    assert found(clashing, items) == brute([r[:2] for r in odd_rows], [(1, "word epsilon one")])
    assert found(none, items) == []
    assert found(odd, items.limit(0)) == []


def test_pieces_join_up():
    text = ("Ab é-" * 500_000).encode()
    assert sum(len(p) for p in search.terms(text)) == 1_000_000


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    docs = np.arange(20_000)
    one, two = rng.pareto(2, 20_000) * 1000, rng.pareto(2, 20_000) * 1000
    impacts = np.concatenate([one, two]).astype(np.int64) + 1
    shard = search.Shard(docs, np.concatenate([docs, docs]), np.repeat([0, 1], 20_000), impacts)
    rows, scores, read = shard.best([0, 1], 10)
    whole = impacts[:20_000] + impacts[20_000:]
    assert sorted(scores, reverse=True) == sorted(whole, reverse=True)[:10] and list(whole[rows]) == list(scores)
    assert read < 10_000
    # A floor above all scores ends it after the first look.
    assert len(shard.best([0, 1], 10, int(whole.max()) + 1)[0]) == 0
