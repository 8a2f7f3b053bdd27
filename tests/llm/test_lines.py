import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventlake.llm import lines, queries
from tests.llm.conftest import SCHEMA

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least_chars=40, least_documents=5):
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(BLANK).translate(LOWER)
            if len(key) >= least_chars:
                holders.setdefault(key, set()).add(-(1 << 63) if doc is None else doc)
    out = []
    for doc, text in rows:
        kept, all_lines = [], (text or "").split("\n")
        for line in all_lines:
            found = holders.get(line.strip(BLANK).translate(LOWER), ())
            if len(found) < least_documents or max(found) == (-(1 << 63) if doc is None else doc):
                kept.append(line)
        out.append((doc, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return sorted(out, key=repr)


def found(df, **kwargs):
    return sorted(map(tuple, lines.without_repeated_lines(df, **kwargs).collect()), key=repr)


def test_whole_table(spark, docs):
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_query_columns(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, g in brute(rows))
    out = queries.op13_line_dedup(spark, sf)
    assert out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(tuple, out.collect())) == expected


def test_many_lines_case_blanks_and_repeats(spark):
    rng = random.Random(1)
    pool = [f"  Line number {i} of a passage that is É long enough " for i in range(12)] + ["short", "", "\t"]
    rows = [(d, "\n".join(rng.choice(pool).swapcase() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randrange(0, 300)))) for d in range(30)]
    # Rows without and with the same doc_id keep their own lines.
    rows += [(None, "\n".join(pool)), (None, pool[0]), (7, "\n".join(pool[:3])), (7, "\n".join(pool[:3]))]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert found(df) == brute(rows)
    assert found(df, least_chars=1, least_documents=2) == brute(rows, 1, 2)


def test_threshold_is_exact(spark):
    key = "x" * 40
    rows = [(d, key) for d in range(5)] + [(d, key[1:]) for d in range(9)] + [(d, "a\n" + key[1:] + "y\n") for d in range(4)]
    rows = [(d, "\n".join(t for e, t in rows if e == d)) for d in range(9)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert found(df) == brute(rows)


def test_odd_rows(odd, odd_rows, none):
    assert found(odd, least_chars=1, least_documents=1) == brute([r[:2] for r in odd_rows], 1, 1)
    clashing = odd.select("*", *(F.lit(1).alias(c) for c in ("doc", "of", "words", "lines", "at", "high", "line")))
    assert found(clashing) == brute([r[:2] for r in odd_rows])
    assert found(none) == []


def test_plan_has_no_python(spark, docs):
    plan = lines.without_repeated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
