"""Tool calls in chats: calls meet their results, are ordered, checked, and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import written

# What the arguments of a tool must be: field -> (type, whether it is needed).
Schema = dict[str, tuple[str, bool]]
REPLY_SCHEMA: dict[str, Schema] = {
    "reply": {"after": ("string", False), "text": ("string", True), "turn": ("integer", True)}
}
_TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
}


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def problems(name: Column, arguments: Column, schemas: dict[str, Schema]) -> Column:
    """What is wrong with ``arguments`` (JSON text) for the tool, comma-joined; empty if nothing is."""
    parsed = F.try_parse_json(arguments)
    outcome = F.lit("unknown tool")
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (kind, needed) in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            absent = value.isNull() | F.is_variant_null(value)
            wrong = ~_kind(value).isin(*_TYPES[kind])
            found.append(
                F.when(absent, F.lit(f"{field} missing") if needed else F.lit(None)).when(
                    wrong, F.lit(f"{field} not {kind}")
                )
            )
        keys = F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>"))
        more = F.transform(
            F.array_sort(F.array_except(keys, F.array(*(F.lit(f) for f in sorted(fields))))),
            lambda k: F.concat(k, F.lit(" unknown")),
        )
        said = F.concat_ws(",", *found, more)
        outcome = F.when(
            name == tool, F.when(parsed.isNull() | (_kind(parsed) != "OBJECT"), F.lit("not an object")).otherwise(said)
        ).otherwise(outcome)
    return outcome


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of (conv_id, call_id, after): 0 without a call before, else one more than it.

    A call names at most one call of its conversation that it comes after; one that is not there
    counts as none. Chains are followed by pointer jumping, so their length costs its logarithm in joins.
    Calls on a cycle, or after one, get null.
    """
    keys = ["conv_id", "call_id"]
    there = calls.select("conv_id", F.col("call_id").alias("after"), F.lit(0).alias("one"))
    now = written(
        calls.join(there, ["conv_id", "after"], "left").select(
            *keys, F.when(F.col("one").isNotNull(), F.col("after")).alias("to"),
            F.when(F.col("one").isNotNull(), 1).otherwise(0).cast("bigint").alias("steps"),
        ),
        "chat-levels",
    )
    unresolved = None
    while True:
        left = now.where("to IS NOT NULL").count()
        if not left or left == unresolved:
            break
        unresolved = left
        over = now.select(
            "conv_id",
            F.col("call_id").alias("to"),
            F.col("to").alias("next"),
            F.col("steps").alias("more"),
        )
        now = written(
            now.join(over, ["conv_id", "to"], "left").select(
                *keys, F.col("next").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")
            ),
            "chat-levels",
        )
    return now.select(*keys, F.when(F.col("to").isNull(), F.col("steps")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row for each call identifier of a conversation, with its result.

    ``calls``: (conv_id, call_id, turn, name, arguments, after), arguments as JSON text, after the
    identifier of a call it needs, or null. ``results``: (conv_id, call_id, turn, content). Out:
    conv_id, call_id, turn, level (see ``levels``; sorting by level, turn and call_id is a topological
    order), n_calls, n_results, status, canonical.

    Calls that repeat an identifier count in n_calls and the first by turn and arguments is the
    call; so for results. Both sides are reduced to one row for each identifier before they meet, so
    repeats cost nothing. Status is the first that holds of: no call, conflict (calls of one
    identifier differ in name or arguments), cycle, what is wrong with the arguments, no result, ok.
    ``canonical`` is the call and its result as JSON with sorted keys and no white space, null if
    the arguments are not JSON. Rows without conv_id or call_id go nowhere and are left out.
    """
    keys = ["conv_id", "call_id"]
    keyed = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.struct("turn", "name", "arguments", "after")
    what = F.struct("name", "arguments")
    called = (
        calls.where(keyed)
        .groupBy(*keys)
        .agg(
            F.min(first).alias("call"),
            F.count(F.lit(1)).alias("n_calls"),
            (F.min(what) != F.max(what)).alias("conflict"),
        )
        .select(*keys, "call.*", "n_calls", "conflict")
    )
    called = written(called, "chat-calls")
    answered = (
        results.where(keyed)
        .groupBy(*keys)
        .agg(F.min(F.struct("turn", "content")).alias("result"), F.count(F.lit(1)).alias("n_results"))
    )
    found = called.join(levels(called.select(*keys, "after")), keys).join(answered, keys, "full_outer")
    wrong = problems(F.col("name"), F.col("arguments"), schemas)
    status = (
        F.when(F.col("n_calls").isNull(), "no call")
        .when(F.col("conflict"), "conflict")
        .when(F.col("level").isNull(), "cycle")
        .when(wrong != "", wrong)
        .when(F.col("n_results").isNull(), "no result")
        .otherwise("ok")
    )
    canonical = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"),
            F.col("call_id").alias("call_id"),
            F.col("name").alias("name"),
            F.col("result.content").alias("result"),
        )
    )
    return found.select(
        *keys,
        F.coalesce("turn", F.col("result.turn")).alias("turn"),
        "level",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        status.alias("status"),
        F.when(F.try_parse_json("arguments").isNotNull(), canonical).alias("canonical"),
    )


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A conversation's user turns as calls of the tool ``reply``, and assistant turns as results.

    The identifier of a turn is its number. A user turn comes after the one two turns earlier. An
    assistant turn is the result of the turn before it. Other roles are left out. ``conversations``:
    (conv_id, turn, role, text); a null text gives arguments without text, or a null result.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        "text",
    ).where("turn IS NOT NULL")
    after = F.when(F.col("turn") >= 2, (F.col("turn") - 2).cast("string"))
    calls = rows.where("role = 'user'").select(
        "conv_id",
        F.col("turn").cast("string").alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        F.to_json(F.struct(after.alias("after"), "text", "turn")).alias("arguments"),
        after.alias("after"),
    )
    results = rows.where("role = 'assistant'").select(
        "conv_id",
        (F.col("turn") - 1).cast("string").alias("call_id"),
        "turn",
        F.col("text").alias("content"),
    )
    return calls, results
