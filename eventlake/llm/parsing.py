"""Document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL = 3
SIGNATURES = 64
_DIGITS = 8  # hexadecimal digits of a signature


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: twice the lowest bit that differs on the left, plus that bit."""
    differ = np.empty_like(labels)
    differ[0] = 1
    np.bitwise_xor(labels[1:], labels[:-1], out=differ[1:])
    differ[first] = 1
    low = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
    bit = (labels >> low.astype(labels.dtype)) & labels.dtype.type(1)
    return (low << np.uint8(1)) | bit.astype(np.uint8)


def _level(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level's phrases, and where each text starts among them."""
    n = len(names)
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    # A run of one symbol is one symbol, named after its length too.
    keep = first.copy()
    keep[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(keep)
    if len(at) < n:
        lengths = np.diff(at, append=n)
        names = names[at]
        runs = lengths > 1
        names[runs] = _mix(names[runs] ^ (lengths[runs].astype(np.uint64) << np.uint64(40)))
        first = first[at]
        n = len(at)
    begin = np.flatnonzero(first)
    labels = _toss(names, begin)
    for _ in range(3):  # 128, then 14, 8 and 6 labels
        labels = _toss(labels, begin)
    # A phrase begins at every text's start and at every local maximum of the labels.
    cut = first.copy()
    top = np.zeros(n, dtype=bool)
    if n > 2:
        top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    top[np.minimum(begin + 1, n - 1)] = False
    top[begin[1:] - 1] = False
    cut |= top
    phrases = np.flatnonzero(cut)
    place = np.arange(n, dtype=np.int64)
    place -= np.repeat(phrases, np.diff(phrases, append=n))
    sums = np.add.reduceat(
        _mix(names + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)),
        phrases,
    )
    return _mix(sums), np.searchsorted(phrases, begin)


def signatures(
    texts: list[str], level: int = LEVEL, most: int = SIGNATURES
) -> list[np.ndarray]:
    """For each text the ``most`` smallest distinct 32-bit names of its phrases of one level, sorted.

    A phrase's name depends on its characters alone, and where phrases begin depends on a few
    neighbours, so equal stretches of text have equal phrases but at their edges. An empty text
    has none; any other has one at least. All texts of a call are parsed in the same arrays.
    """
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = [np.empty(0, dtype=np.uint32)] * len(texts)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    names = np.frombuffer(joined, dtype="<u4").astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
    for _ in range(level):
        names, starts = _level(names, starts)
    owner = np.repeat(np.arange(len(some)), np.diff(starts, append=len(names)))
    keys = np.unique((owner.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
    ends = np.searchsorted(keys >> np.uint64(32), np.arange(len(some) + 1))
    values = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for k, i in enumerate(some):
        out[i] = values[ends[k] : min(ends[k + 1], ends[k] + most)]
    return out


def to_text(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, most: int = SIGNATURES) -> float:
    """Estimated share of phrases in common, 0 to 1; two empty texts are alike, one is not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    left, right = set(a.tolist()), set(b.tolist())
    pooled = sorted(left | right)[:most]
    both = left & right
    return sum(x in both for x in pooled) / len(pooled)


def with_edited(
    docs: DataFrame,
    blocks: int | None = None,
    level: int = LEVEL,
    most: int = SIGNATURES,
    block_chars: int = 1 << 18,
) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document's, by ascending doc_id; the last document's next is the
    first. Only doc_id and text are read. A null text is empty. Rows that repeat a doc_id follow
    each other by text; a null doc_id sorts first. A document alone is its own next.

    Documents are cut into ``blocks`` (default four for each shuffle partition) at quantiles of
    doc_id. Texts are shuffled once, to their block, with one row more for each block: the next
    block's first document. A block is parsed as a sorted stream.
    """
    spark = docs.sparkSession
    if blocks is None:
        blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint")).alias("k"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
    ).withColumn("at", F.col("k").cast("double"))
    shares = [i / blocks for i in range(1, blocks)]
    cuts = ids.approxQuantile("at", shares, 0.25 / blocks) if shares else []
    splits = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    blocked = (
        Bucketizer(splits=splits, inputCol="at", outputCol="block")
        .transform(ids)
        .select(F.col("block").cast("int").alias("block"), "k", "doc_id", "text")
    )
    firsts = sorted(
        (r["block"], r["k"]) for r in blocked.groupBy("block").agg(F.min("k").alias("k")).collect()
    )  # one row for each block
    ahead = spark.createDataFrame(
        [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)], "k BIGINT, before INT"
    )
    placed = (
        blocked.join(F.broadcast(ahead), "k", "left")
        .withColumn(
            "to",
            F.when(F.col("before").isNull(), F.array(F.struct("block", F.lit(0).alias("ahead"))))
            .otherwise(
                F.array(
                    F.struct("block", F.lit(0).alias("ahead")),
                    F.struct(F.col("before").alias("block"), F.lit(1).alias("ahead")),
                )
            ),
        )
        .select(F.explode("to").alias("to"), "k", "doc_id", "text")
        .select("to.block", "to.ahead", "k", "doc_id", "text")
    )

    def parse(rows: list[tuple], following: tuple) -> pd.DataFrame:
        ids_, texts = [r[0] for r in rows], [r[1] for r in rows]
        nexts = [*texts[1:], following[1]]
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + n[:h] for t, h, n in zip(texts, halves, nexts)]
        found = signatures([*texts, following[1], *edited], level, most)
        own, new = found[: len(texts) + 1], found[len(texts) + 1 :]
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids_, dtype="Int64"),
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [
                    hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited
                ],
                "fingerprint": list(map(to_text, own[:-1])),
                "edited_fingerprint": list(map(to_text, new)),
                "near_edited": [likeness(a, b, most) for a, b in zip(own, new)],
                "near_next": [likeness(a, b, most) for a, b in zip(own, own[1:])],
            }
        )

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, waiting, size, closed = None, [], 0, False
        for batch in batches:
            for b, is_ahead, missing, doc_id, text in zip(
                batch["block"], batch["ahead"], batch["k"] == -(1 << 63), batch["doc_id"], batch["text"]
            ):
                if b != block:
                    block, waiting, size, closed = b, [], 0, False
                if closed:  # a repeated doc_id sent more than one row ahead
                    continue
                row = (None if missing else int(doc_id), text)
                if is_ahead:
                    if waiting:
                        yield parse(waiting, row)
                    waiting, closed = [], True
                    continue
                if size >= block_chars:
                    yield parse(waiting, row)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(text)

    return (
        placed.repartition("block")
        .sortWithinPartitions("block", "ahead", "k", "text")
        .mapInPandas(
            stream,
            "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, "
            "edited_fingerprint STRING, near_edited DOUBLE, near_next DOUBLE",
        )
    )
