"""Ranked lexical search by the best position algorithm over shards of impact-sorted lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import over_texts, written

MOST = 50
# Entries of impact lists that a shard is meant to hold (some 60 bytes each while it is searched).
SHARD_ENTRIES = 1 << 20
# Bytes of queries that are broadcast at once; more queries go in several blocks.
BLOCK_BYTES = 8 << 20
# Depth read from every list before the first test for the end; it doubles from there.
FIRST_DEPTH = 64
PIECE_BYTES = 1 << 20
UNIT = 1_000_000_000

# Bytes of a term: digits, letters and all that is not ASCII. Others become blanks, A-Z become a-z.
_BLANK = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in UTF-8, in pieces of about ``PIECE_BYTES``."""
    plain = text.translate(_BLANK)
    start = 0
    while start < len(plain):
        end = plain.find(b" ", min(len(plain), start + PIECE_BYTES))
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def query_blocks(queries: DataFrame, most_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The queries (item_id, text) as lists of (item_id, distinct terms), each of bounded size.

    Queries are dealt to blocks by hash; a block is halved until its texts fit (a single longer query stands alone).
    """
    rows = written(
        queries.select(
            F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
        ).withColumn("place", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 << 40))),
        "search-queries",
    )
    waiting = [(0, 1 << 40)]
    while waiting:
        low, high = waiting.pop()
        some = rows.where((F.col("place") >= low) & (F.col("place") < high))
        size, n = some.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
        if not n:
            continue
        if size > most_bytes and high - low > 1 and n > 1:
            middle = (low + high) // 2
            waiting += [(middle, high), (low, middle)]
            continue
        block = []
        for row in some.orderBy("item_id", "text").collect():  # at most most_bytes, or one place
            found = {t for piece in terms(row["text"].encode()) for t in piece}
            block.append((row["item_id"], sorted(found)))
        yield block


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, counts): of every whole text its number of terms, and the terms of ``vocabulary`` in it."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for block in blocks:
            sizes, ends, ids, counts = [], [0], [], []
            for text in block.column("text").to_pylist():
                found: Counter = Counter()
                n = 0
                for piece in terms(text) if text else ():
                    n += len(piece)
                    found.update(map(number, piece))
                found.pop(None, None)
                some = sorted(found.items())
                ids.extend(k for k, _ in some)
                counts.extend(c for _, c in some)
                sizes.append(n)
                ends.append(len(ids))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(at, pa.array(counts, pa.int64())),
                ],
                ["doc_id", "n", "ids", "counts"],
            )

    columns = [F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")]
    return over_texts(docs, columns, work, "doc_id BIGINT, n BIGINT, ids ARRAY<INT>, counts ARRAY<BIGINT>")


class Shard:
    """Impact-sorted lists of one shard's documents, with direct accesses to any (document, term)."""

    def __init__(self, doc_ids: np.ndarray, docs: np.ndarray, ids: np.ndarray, impacts: np.ndarray):
        """``docs``, ``ids``, ``impacts``: one entry for each document (by its row) and term, impacts above 0."""
        self.doc_ids, self.width = doc_ids, int(ids.max(initial=0)) + 1
        order = np.lexsort((docs, -impacts, ids))
        self.docs, self.impacts = docs[order], impacts[order]
        terms_in_order = ids[order]
        self.starts = np.searchsorted(terms_in_order, np.arange(self.width + 1))
        position = np.arange(len(order)) - self.starts[terms_in_order]
        keys = self.docs * self.width + terms_in_order
        by_key = np.argsort(keys)
        self.keys, self.places, self.positions = keys[by_key], by_key, position[by_key]

    def direct(self, docs: np.ndarray, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(impact, position in the term's list) of documents; 0 and -1 where the list lacks them."""
        keys = docs * self.width + term
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.impacts[self.places[at]], 0), np.where(hit, self.positions[at], -1)

    def best(self, query: list[int], most: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, entries read) of the ``most`` best documents with a score above 0 and not below ``floor``.

        Lists are read side by side. Every new document is looked up in all lists, which marks its positions there
        as seen. A list's best position is the last of its unbroken run of seen positions; no unseen
        document has more than the sum of the impacts there. Reading stops when that sum is strictly below the
        score of the last place (or the floor), since equal scores go by doc_id.
        """
        lists = [t for t in query if t < self.width and self.starts[t] < self.starts[t + 1]]
        sizes = [int(self.starts[t + 1] - self.starts[t]) for t in lists]
        seen = [np.zeros(s + 1, dtype=bool) for s in sizes]
        rows, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, read = FIRST_DEPTH, 0
        done = 0
        while lists:
            fresh = [self.docs[self.starts[t] + done : self.starts[t] + min(depth, s)] for t, s in zip(lists, sizes)]
            read += sum(map(len, fresh))
            new = np.setdiff1d(np.concatenate(fresh), rows)
            total = np.zeros(len(new), dtype=np.int64)
            for k, t in enumerate(lists):
                impact, position = self.direct(new, t)
                total += impact
                seen[k][position[position >= 0]] = True
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, total])
            threshold = 0
            for k, t in enumerate(lists):
                run = int(np.argmin(seen[k]))  # the entry after the list's end is never seen
                threshold += int(self.impacts[self.starts[t] + run - 1]) if run < sizes[k] else 0
            done = depth
            last = int(np.partition(scores, len(scores) - most)[len(scores) - most]) if len(scores) >= most else 0
            if threshold < max(last, floor) or threshold == 0:
                break
            depth *= 2
        good = (scores > 0) & (scores >= floor)
        rows, scores = rows[good], scores[good]
        if len(rows) > most:
            order = np.lexsort((self.doc_ids[rows], -scores))[:most]
            rows, scores = rows[order], scores[order]
        return rows, scores, read


def _search(
    held: DataFrame, weights: np.ndarray, total: int, length: int, queries: list[list[int]], most: int,
    floors: np.ndarray,
) -> DataFrame:
    """(query, doc_id, score, present) of each query's best documents in each shard of ``held``."""
    shared = held.sparkSession.sparkContext.broadcast((weights, queries, floors))

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        weight, wanted, floor = shared.value
        present = shard["doc_id"].notna().to_numpy()
        # A row without doc_id comes before all others of its score.
        doc_ids = shard["doc_id"].fillna(-(1 << 63)).to_numpy(np.int64)
        sizes = shard["ids"].map(len).to_numpy(np.int64)
        docs = np.repeat(np.arange(len(shard), dtype=np.int64), sizes)
        ids = np.concatenate([np.empty(0, np.int64), *shard["ids"]]).astype(np.int64)
        counts = np.concatenate([np.empty(0, np.int64), *shard["counts"]]).astype(np.int64)
        # Python integers: the product of two counts over the whole corpus may pass 64 bits.
        norm = np.array([50 + 50 * int(n) * total // length for n in shard["n"]], dtype=np.int64)
        impacts = weight[ids] * ((UNIT * counts) // (1000 * counts + 20 * norm[docs]))
        some = impacts > 0
        lists = Shard(doc_ids, docs[some], ids[some], impacts[some])
        out = []
        for k, query in enumerate(wanted):
            rows, scores, _ = lists.best(query, most, int(floor[k]))
            out.append((np.full(len(rows), k, np.int64), doc_ids[rows], scores, present[rows]))
        return pd.DataFrame(
            {c: np.concatenate(v) for c, v in zip(("query", "doc_id", "score", "present"), zip(*out))}
        )

    return held.groupBy("shard").applyInPandas(
        search, "query BIGINT, doc_id BIGINT, score BIGINT, present BOOLEAN"
    )


def _leaders(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def ranked(
    docs: DataFrame, queries: DataFrame, most: int = MOST, shard_entries: int = SHARD_ENTRIES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best rows of ``docs`` (doc_id, text) for each row of ``queries`` (item_id, text).

    Terms are runs of digits, letters and non-ASCII characters, only A-Z lower-cased. A term's weight is
    floor(1000 * ln((2N + 2) / (2df + 1))), and a document's score the sum over the query's distinct terms of weight *
    (10^9 * tf div (1000 * tf + 20 * m)), with m = 50 + (50 * n * N) div L. Only scores above 0 count; equal ones
    go by doc_id.

    Statistics cover all documents. Documents are dealt to shards whose number grows with the
    lists, so that a shard's lists fit a task; each is searched by the best position algorithm. The first shard's last places are floors
    for the others, which then read little. At most ``most`` rows for each query leave a shard. Queries are
    broadcast in blocks of bounded size.

    A null or empty text has no terms: as a document it is never found, as a query it gives no rows. Rows that repeat
    a doc_id are found each by itself; one without doc_id comes first among equal scores. Every row of queries is a
    query of its own, also if item_id repeats or is null. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    result = spark.createDataFrame([], "item_id BIGINT, rank INT, doc_id BIGINT, score BIGINT")
    for block in query_blocks(queries, block_bytes):
        vocabulary = {t: k for k, t in enumerate(sorted({t for _, some in block for t in some}))}
        if not vocabulary:
            continue
        # Every row is dealt by itself, so rows that share a doc_id or lack it are spread as well.
        deal = F.xxhash64(F.monotonically_increasing_id()).alias("deal")
        counted = written(term_counts(docs, vocabulary).select("*", deal), "search-terms")
        total, length, entries = counted.where(F.col("n") > 0).agg(
            F.count(F.lit(1)), F.sum("n"), F.sum(F.size("ids"))
        ).first()
        if not entries:
            continue
        held_by = np.zeros(len(vocabulary))
        for row in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # the block's terms
            held_by[row["id"]] = row["count"]
        weights = np.floor(1000 * np.log((2 * total + 2) / (2 * held_by + 1))).astype(np.int64)
        shards = -(-entries // shard_entries)
        dealt = counted.where(F.size("ids") > 0).withColumn("shard", F.pmod("deal", F.lit(shards)))
        wanted = [[vocabulary[t] for t in some] for _, some in block]
        floors = np.zeros(len(block), dtype=np.int64)

        def search(part: DataFrame) -> DataFrame:
            return _search(part, weights, total, length, wanted, most, floors)

        if shards == 1:
            found = search(dealt)
        else:
            first = written(_leaders(search(dealt.where("shard = 0")), most), "search-first").drop("rank")
            lasts = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last"))
            for row in lasts.where(F.col("n") >= most).collect():  # one row for each query of the block
                floors[row["query"]] = row["last"]
            found = first.unionByName(search(dealt.where("shard > 0")))
        items = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "query BIGINT, item_id BIGINT")
        best = _leaders(found, most).join(items, "query")
        doc_id = F.when(F.col("present"), F.col("doc_id"))
        result = result.unionByName(
            written(best.select("item_id", "rank", doc_id.alias("doc_id"), "score"), "search-best")
        )
    return result
