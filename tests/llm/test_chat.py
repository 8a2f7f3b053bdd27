import json

import duckdb
import pytest

from eventlake.llm import chat, queries
from tests.llm.conftest import SF

CALLS = "conv_id BIGINT, call_id STRING, turn BIGINT, name STRING, arguments STRING, after STRING"
RESULTS = "conv_id BIGINT, call_id STRING, turn BIGINT, content STRING"
SCHEMAS = {"add": {"x": ("integer", True), "y": ("number", False), "tags": ("array", False)}}


def linked(spark, calls, results):
    found = chat.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in found.collect()}


def test_links_checks_and_order(spark):
    calls = [
        (1, "a", 0, "add", '{"y": 2.5, "x": 1}', None),
        (1, "b", 2, "add", '{"x": "1"}', "a"),
        (1, "c", 4, "add", '{"z": {"b": 1, "a": [2, 1]}, "x": 3}', "b"),
        (1, "d", 6, "sub", "{}", "gone"),
        (1, "e", 8, "add", "not json", "c"),
        (1, "f", 9, "add", None, None),
        (2, "a", 0, "add", '{"x": 1}', "b"),
        (2, "b", 1, "add", '{"x": 1}', "a"),
        (2, "c", 2, "add", '{"x": 1}', "c"),
        (3, "a", 0, "add", '{"x": 1}', None),
        (3, "a", 0, "add", '{"x": 1}', None),
        (4, "a", 0, "add", '{"x": 1}', None),
        (4, "a", 5, "add", '{"x": 2}', None),
        (5, None, 0, "add", '{"x": 1}', None),
        (None, "a", 0, "add", '{"x": 1}', None),
    ]
    results = [(1, "a", 1, "3"), (1, "z", 3, "?"), (3, "a", 2, "later"), (3, "a", 1, None), (4, "a", 6, "r")]
    found = linked(spark, calls, results)
    assert found[1, "a"].status == "ok" and found[1, "a"].level == 0
    assert found[1, "a"].canonical == '{"arguments":{"x":1,"y":2.5},"call_id":"a","name":"add","result":"3"}'
    assert found[1, "b"].status == "x not integer" and found[1, "b"].level == 1
    assert found[1, "c"].status == "z unknown" and found[1, "c"].level == 2
    assert '"arguments":{"x":3,"z":{"a":[2,1],"b":1}}' in found[1, "c"].canonical
    assert found[1, "d"].status == "unknown tool" and found[1, "d"].level == 0
    assert found[1, "e"].status == "not an object" and found[1, "e"].canonical is None
    assert found[1, "f"].status == "not an object"
    assert found[1, "z"].status == "no call" and found[1, "z"].n_calls == 0
    assert {found[2, c].status for c in "abc"} == {"cycle"}
    assert (found[3, "a"].n_calls, found[3, "a"].n_results, found[3, "a"].status) == (2, 2, "ok")
    assert found[4, "a"].status == "conflict" and found[4, "a"].turn == 0
    assert not [k for k in found if None in k]


def test_long_chains(spark):
    calls = [(1, str(i), i, "add", json.dumps({"x": i}), str(i - 1) if i else None) for i in range(70)]
    found = linked(spark, calls, [])
    assert [found[1, str(i)].level for i in range(70)] == list(range(70))


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", None), (1, 1, "assistant", "hi"), (None, 0, "user", "x")]])
def test_odd_conversations(spark, rows):
    talks = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    found = chat.link(*chat.calls_and_results(talks), chat.REPLY_SCHEMA).collect()
    assert [r.status for r in found] == (["text missing"] if rows else [])


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = queries.op3_tool_calls(spark, SF)
    expected = con.execute(queries.oracle_sql()["op3_tool_calls"]).df()[df.columns]
    rows = [tuple(None if x != x else x for x in r) for r in expected.itertuples(index=False)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted(rows, key=key)
