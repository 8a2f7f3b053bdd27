import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from eventlake.llm import queries, trie

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[k] for k in below)
    out = []
    for node, some in members.items():
        ends = ",".join(str(c) for c in sorted(some) if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(some), len(node), parent, len(some), len(children.get(node, ())), leaves[node], saved[node], sha))
    return sorted(out, key=repr)


def found(df, **kwargs):
    return sorted(map(tuple, trie.trie(df, **kwargs).collect()), key=repr)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = list(map(tuple, spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    out = queries.op12_conversation_trie(spark, sf)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def random_rows(seed, convs=150, words=3):
    rng = random.Random(seed)
    return [
        (rng.randrange(convs) * 7, turn, rng.choice(["user", "assistant"]), rng.choice(["", "a", "bé", "long text"][:words]))
        for _ in range(convs)
        for turn in range(rng.randrange(1, 6))
    ]


@pytest.mark.parametrize("limits", [{}, {"most_sequences": 1}, {"most_sequences": 4}, {"most_turns": 30}])
def test_any_container_size(spark, limits):
    rows = random_rows(3)
    rows += [(c, t, "user", "the same") for c in range(1000, 1300) for t in range(4)]  # a large group of copies
    rows += [(90_000, t, "user", str(t)) for t in range(500)] + [(90_100, t, "user", str(t)) for t in range(499)]
    assert found(spark.createDataFrame(rows, SCHEMA), **limits) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None),
        (1, 0, "user", None),
        (1, 0, "user", ""),
        (1, 0, None, "user"),
        (None, 0, "user", "no conversation"),
        (2, 0, "user", "x" * 100_000),
        (2, 0, "user", "x" * 100_000),
        (100, 3, "a", "b"),
        (105, 1, "a", "b"),
        (-105, 1, "a", "b"),
    ]
    rows = [r for r in rows if r[0] is None or r[0] >= 0]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("conv", "t", "head", "n", "turns", "sha")))
    assert found(df) == brute(rows) == found(df, most_sequences=1)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_copies_are_spread_by_blocks(spark):
    rows = [(c, 0, "user", "same") for c in range(3000) if c % 100]
    blocks = trie.sequences(trie.conversation_turns(spark.createDataFrame(rows, SCHEMA)), block=100).collect()
    ids = ",".join(str(r[0]) for r in rows)
    assert [(r.conv, r.n, r.sha) for r in blocks] == [(1, len(rows), hashlib.sha256(ids.encode()).hexdigest())]
