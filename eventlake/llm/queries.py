"""The operators of this subpackage applied to their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import (
    chat,
    language,
    lines,
    lm,
    mixing,
    neighbours,
    packing,
    parsing,
    private,
    search,
    secrets,
    simhash,
    trie,
)
from eventlake.llm.common import crc_of_id, documents


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.with_edited(documents(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = private.find(docs, private.train(docs))
    counts = [
        F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{kind}")
        for k, kind in enumerate(private.KINDS)
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(private.listed(F.col("base")), 256).alias("base_sha256"),
        private.listed(F.col("spans")).alias("spans"),
    )


def _of_kind(k: int) -> Callable:
    return lambda span: span["kind"] == k


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.link(*chat.calls_and_results(conversations), chat.REPLY_SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) == 1
    scored = lm.score(documents(spark, sf_dir), ~F.coalesce(held_out, F.lit(False)))
    return scored.select(
        "doc_id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return secrets.scan(docs, secrets.train(docs))


def op8_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    found = language.predict(docs, language.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_repeated_lines(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_document_fingerprints,
        op2_personal_data,
        op3_tool_calls,
        op4_packing,
        op5_simhash,
        op6_lm_scores,
        op7_secrets,
        op8_embedding_near_duplicates,
        op9_language,
        op10_mixing,
        op11_lexical_search,
        op12_conversation_trie,
        op13_line_dedup,
    )
    return {f.__name__: f for f in found}


# The turns of a conversation two apart follow each other: runs of them count the level.
_TOOL_CALLS = """
WITH users AS (
  SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS nth
  FROM conversations WHERE role = 'user'
), called AS (
  SELECT conv_id, CAST(turn AS VARCHAR) AS call_id, turn, text,
         row_number() OVER (PARTITION BY conv_id, turn % 2, turn - 2 * nth ORDER BY turn) - 1 AS level
  FROM users
), answered AS (
  SELECT conv_id, CAST(turn - 1 AS VARCHAR) AS call_id, turn AS result_turn, text AS content
  FROM conversations WHERE role = 'assistant'
)
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id,
       coalesce(c.turn, a.result_turn) AS turn, c.level,
       CAST(CASE WHEN c.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_calls,
       CAST(CASE WHEN a.call_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
       CASE WHEN c.call_id IS NULL THEN 'no call' WHEN c.text IS NULL THEN 'text missing'
            WHEN a.call_id IS NULL THEN 'no result' ELSE 'ok' END AS status,
       CASE WHEN c.call_id IS NOT NULL THEN
         '{"arguments":{' || CASE WHEN c.turn >= 2 THEN '"after":"' || (c.turn - 2) || '",' ELSE '' END
         || CASE WHEN c.text IS NOT NULL THEN '"text":' || CAST(to_json(c.text) AS VARCHAR) || ',' ELSE '' END
         || '"turn":' || c.turn || '},"call_id":"' || c.call_id || '","name":"reply"'
         || CASE WHEN a.content IS NOT NULL THEN ',"result":' || CAST(to_json(a.content) AS VARCHAR) ELSE '' END
         || '}' END AS canonical
FROM called c FULL JOIN answered a ON c.conv_id = a.conv_id AND c.call_id = a.call_id
"""


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = (
    f"regexp_extract_all(translate(text, {_LOWER}), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

_SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
asked AS (SELECT item_id, unnest(list_distinct(t)) AS term FROM (SELECT item_id, {_TERMS} AS t FROM benchmark)),
sizes AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
corpus AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sizes),
tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INT) AS rank, doc_id, score FROM ranked WHERE r <= 50
"""

# The turn's digest and its text's length; the digest also orders turns of equal number.
_DIGEST = "md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
# CRC-32 of the decimal digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(unicode(ch) AS BIGINT))),
  lambda crc, ch: list_reduce(list_prepend(xor(crc, ch), CAST([0, 1, 2, 3, 4, 5, 6, 7] AS BIGINT[])),
    lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"""

_TRIE = f"""
WITH own AS (
  SELECT conv_id AS c,
         list({_DIGEST} || ':' || length(coalesce(text, '')) ORDER BY turn NULLS FIRST, {_DIGEST}) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT c, {_CRC} % 6 AS h, turns FROM own),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM hashed a LEFT JOIN own b ON b.c = a.c - a.c % 100),
prefixes AS (
  SELECT c, d, len(turns) AS n, md5(array_to_string(turns[1:d], '/')) AS id,
         CASE WHEN d > 0 THEN md5(array_to_string(turns[1:d - 1], '/')) END AS up,
         CASE WHEN d > 0 THEN CAST(split_part(turns[d], ':', 2) AS BIGINT) ELSE 0 END AS chars
  FROM rebuilt, unnest(range(0, len(turns) + 1)) r(d)),
nodes AS (
  SELECT d, id, any_value(up) AS up, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY d, id),
children AS (SELECT d - 1 AS d, up AS id, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k USING (d, id)),
above AS (
  SELECT p.d, p.id, n.n_children = 0 AS leaf, (n.n_convs - 1) * n.chars AS saved
  FROM counted n JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.d),
below AS (
  SELECT d, id, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM above GROUP BY d, id)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves,
       b.saved_tokens, n.ends_sha256
FROM counted n JOIN below b USING (d, id) LEFT JOIN nodes u ON u.d = n.d - 1 AND u.id = n.up
"""

_LINES = f"""
WITH cut AS (
  SELECT doc_id, generate_subscripts(l, 1) AS nr, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM cut),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT doc_id, nr, line, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_tool_calls": _TOOL_CALLS,
        "op11_lexical_search": _SEARCH,
        "op12_conversation_trie": _TRIE,
        "op13_line_dedup": _LINES,
    }
