"""Near duplicates by 64-bit SimHash, or by shared shingles, and the general pigeonhole principle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import among, over_texts, seeded_unit, written
from eventlake.llm.components import components

BITS = 64
SHINGLE_WORDS = 3
MOST_DIFFERING = 2
HASH_SEED = 42
# Buckets of at most so many fingerprints, or shingle sets, are compared pair by pair.
PAIRED_BUCKET = 48
# Shingles of more than COMMON_FROM documents of a seeded share come last in the order of prefixes, so
# many of them at most. Links depend on none of the three, only the number of candidates does.
COMMON_SHARE = 0.125
COMMON_FROM = 1
COMMON_MOST = 1 << 17
SET_BLOCK_BYTES = 1 << 20
# Comparisons with the same set go to a task in blocks of about so many.
COMPARED_BLOCK = 64
# Comparisons (some 40 bytes each, and as much again for the set compared with) that are broadcast to the sets.
SENT_COMPARISONS = 250_000


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp BIGINT): SimHash of every whole text.

    A-Z are lower-cased; words are cut at ASCII white space; shingles count as often as they
    occur. A text of fewer words is one shingle; a null, empty or blank text has fingerprint 0.
    A bit is 1 where more than half of the shingle hashes (XXH64) have it.
    """

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for block in blocks:
            found = np.zeros(block.num_rows, dtype=np.uint64)
            for i, text in enumerate(block.column("text").to_pylist()):
                tokens = text.lower().split() if text else []
                if not tokens:
                    continue
                if len(tokens) < words:
                    shingles = [b" ".join(tokens)]
                else:
                    shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
                hashes = np.fromiter((digest(s, HASH_SEED) for s in shingles), dtype=np.uint64)
                found[i] = _majority(hashes)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"]
            )

    columns = [F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")]
    return over_texts(docs, columns, work, "doc_id BIGINT, fp BIGINT")


def _majority(hashes: np.ndarray) -> np.uint64:
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")[0]


def bit_products(fps: DataFrame) -> np.ndarray:
    """64 x 64 sums of products of bits (as -1 and 1) over all fingerprints."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), dtype=np.float64)
        for batch in batches:
            values = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
            bits = np.unpackbits(
                values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
            ).astype(np.float32)
            signs = 2 * bits - 1
            total += signs.T @ signs
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i * BITS + j), pa.array(total[i, j])], ["cell", "total"]
        )

    sums = fps.select("fp").mapInArrow(work, "cell BIGINT, total DOUBLE")
    out = np.zeros(BITS * BITS)
    for row in sums.groupBy("cell").agg(F.sum("total").alias("total")).collect():  # 2080 rows
        out[row["cell"]] = row["total"]
    out = out.reshape(BITS, BITS)
    return out + np.triu(out, 1).T


def group_bits(products: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width, correlated bits together.

    Each group starts with the two free bits that go together most and takes in, one at a time,
    the free bit most correlated with it.
    """
    near = np.abs(products)
    np.fill_diagonal(near, 0)
    free, groups = set(range(BITS)), []
    for part in range(parts):
        width = BITS // parts + (part < BITS % parts)
        left = sorted(free)
        at = np.unravel_index(np.argmax(near[np.ix_(left, left)]), (len(left), len(left)))
        first = at if at[0] != at[1] else (0, min(1, len(left) - 1))
        group = sorted({left[k] for k in first})
        while len(group) < width:
            left = sorted(free - set(group))
            group.append(left[int(np.argmax(near[np.ix_(group, left)].sum(axis=0)))])
        groups.append(sorted(group[:width]))
        free -= set(groups[-1])
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds that add up to ``total`` at the least cost, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        following: dict[int, tuple[float, list[int]]] = {}
        for reached, (spent, chosen) in best.items():
            for threshold, price in cost.items():
                option = (spent + price, [*chosen, threshold])
                key = reached + threshold
                if key not in following or option < following[key]:
                    following[key] = option
        best = following
    return best[total]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << BITS) if value >> (BITS - 1) else value


def choose_parts(
    fps: DataFrame, most: int = MOST_DIFFERING, part_counts: tuple[int, ...] = (2, 3, 4)
) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the parts to probe.

    By the general pigeonhole principle, two fingerprints within ``most`` bits lie within some
    part's threshold if the thresholds add up to ``most - parts + 1``; -1 leaves a part out. The
    pairs that share a part's value are counted over all fingerprints; a threshold of one
    multiplies both probes and candidates by one more than the part's width.
    """
    products = bit_products(fps)
    layouts = {m: group_bits(products, m) for m in part_counts}
    named = [(m, k, _mask(bits)) for m, groups in layouts.items() for k, bits in enumerate(groups)]
    values = F.array(
        *(
            F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), _and(mask).alias("value"))
            for m, k, mask in named
        )
    )
    shared = (
        fps.select(F.explode(values).alias("p"))
        .groupBy("p.m", "p.k", "p.value")
        .count()
        .groupBy("m", "k")
        .agg(
            F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs"),
            F.sum("count").alias("rows"),
        )
        .collect()  # one row for each part
    )
    counted = {(r["m"], r["k"]): (r["pairs"], r["rows"]) for r in shared}
    best = None
    for m, groups in layouts.items():
        costs = []
        for k, bits in enumerate(groups):
            pairs, rows = counted.get((m, k), (0.0, 0))
            cost = {-1: 0.0}
            balls = 1.0
            for threshold in range(most + 1):
                cost[threshold] = balls * (rows * 8.0 + pairs)
                balls *= len(bits) + 1
            costs.append(cost)
        price, thresholds = allocate(costs, most - m + 1)
        if best is None or price < best[0]:
            best = (price, [(g, t) for g, t in zip(groups, thresholds) if t >= 0])
    return best[1]


def _and(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(mask).cast("bigint"))


def _near_values(mask: int, bits: list[int], threshold: int) -> Column:
    """All values of a part within ``threshold`` bits of the fingerprint's own."""
    flips = [0]
    for _ in range(threshold):
        flips = sorted({f ^ (1 << b) for f in flips for b in bits} | set(flips))
    signed = [f - (1 << BITS) if f >> (BITS - 1) else f for f in flips]
    return F.transform(
        F.array(*(F.lit(f).cast("bigint") for f in signed)), lambda f: _and(mask).bitwiseXOR(f)
    )


def links(reps: DataFrame, most: int = MOST_DIFFERING) -> DataFrame:
    """(a, b) of representatives of distinct fingerprints such that linked ones are connected.

    ``reps``: (fp, rep), each fingerprint once. Probes meet the index on (part, value); pairs are
    verified on all 64 bits. A bucket above ``PAIRED_BUCKET`` fingerprints isn't paired: its members
    and whoever probes it are linked through midpoints instead. Two fingerprints within two bits
    have a point within one bit of both, and no point has more than 65 fingerprints around it, so
    linking those with the smallest of them joins the same documents without quadratic work.
    """
    if most != MOST_DIFFERING:
        raise ValueError("midpoints hold for two differing bits")
    parts = choose_parts(reps, most)
    index = reps.select(
        "fp",
        "rep",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(k).alias("part"), _and(_mask(bits)).alias("value"))
                    for k, (bits, _) in enumerate(parts)
                )
            )
        ).alias("key"),
    ).select("fp", "rep", "key.*")
    if all(threshold == 0 for _, threshold in parts):
        probes = index
    else:
        probes = None
        for k, (bits, threshold) in enumerate(parts):
            near = F.explode(_near_values(_mask(bits), bits, threshold)).alias("value")
            one = reps.select("fp", "rep", F.lit(k).alias("part"), near)
            probes = one if probes is None else probes.union(one)
    sizes = written(
        index.groupBy("part", "value").count().where("count > 1"), "simhash-buckets"
    )
    large = sizes.where(F.col("count") > PAIRED_BUCKET).select("part", "value")
    small = sizes.where(F.col("count") <= PAIRED_BUCKET).select("part", "value")
    if any(threshold for _, threshold in parts):  # a probe also meets buckets of one
        small = (
            index.groupBy("part", "value")
            .count()
            .where(F.col("count") <= PAIRED_BUCKET)
            .select("part", "value")
        )
    left = probes.join(small, ["part", "value"]).select(
        "part", "value", F.col("fp").alias("fp_a"), F.col("rep").alias("a")
    )
    right = index.select("part", "value", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    differing = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    paired = left.join(
        right,
        (left["part"] == right["part"])
        & (left["value"] == right["value"])
        & (F.col("fp_a") != F.col("fp_b"))
        & (differing <= most),
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crowded = probes.join(large, ["part", "value"], "left_semi").select("fp", "rep").distinct()
    flips = F.array(
        F.lit(0).cast("bigint"),
        *(F.lit((1 << b) - (1 << BITS) if b == BITS - 1 else 1 << b).cast("bigint") for b in range(BITS)),
    )
    around = (
        crowded.select("rep", "fp", F.explode(flips).alias("flip"))
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
        .agg(F.collect_set("rep").alias("near"))  # at most 65
        .where(F.size("near") > 1)
    )
    joined = around.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where(
        F.col("a") != F.col("b")
    )
    return paired.union(joined).distinct()


def _sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each whole text's shingles; none of a text without words.

    Words are as for the fingerprints; a text of fewer words is one shingle.
    """
    known: dict[bytes, int] = {}
    tokens = [text.lower().split() if text else [] for text in texts]
    for word in {w for some in tokens for w in some}:
        known[word] = xxhash.xxh64_intdigest(word, HASH_SEED)
    out = []
    for some in tokens:
        hashes = np.fromiter(map(known.__getitem__, some), dtype=np.uint64, count=len(some))
        width = min(words, len(some))
        found = np.full(max(0, len(some) - width + 1) if width else 0, width, dtype=np.uint64)
        for k in range(width):
            found *= np.uint64(0x9E3779B97F4A7C15)
            found += hashes[k : len(some) - width + 1 + k]
            found ^= found >> np.uint64(32)
            found *= np.uint64(0xD6E8FEB86659FD93)
        out.append(np.unique(found))
    return out


def _set_key(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), HASH_SEED) if len(shingles) else 0


def _set_keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([_set_key(s) for s in sets], dtype=np.uint64).view(np.int64)


def _text_sets(docs: DataFrame, words: int, work: Callable, schema: str, *columns: Column) -> DataFrame:
    """``work`` on (block, sets) of every block of ``docs``."""

    def each(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            yield work(block, _sets(block.column("text").to_pylist(), words))

    return over_texts(docs, [*columns, F.col("text").cast("binary").alias("text")], each, schema, SET_BLOCK_BYTES)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(low 32 bits of the hash, ascending, and rank) of the commonest shingles, the commonest last.

    Counted over ``COMMON_SHARE`` of the documents. Shingles that share the 32 bits share a rank.
    """

    def work(block: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate([np.empty(0, np.uint64), *sets])
        low, n = np.unique(every.astype(np.uint32), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(low.view(np.int32)), pa.array(n.astype(np.int32))], ["low", "n"])

    some = docs.where(seeded_unit(HASH_SEED, F.col("doc_id")) < COMMON_SHARE)
    counts = _text_sets(some, words, work, "low INT, n INT").groupBy("low").agg(F.sum("n").alias("n"))
    top = (
        counts.where(F.col("n") > COMMON_FROM)
        .orderBy(F.desc("n"), "low")
        .limit(COMMON_MOST)
        .select("low")
        .toArrow()
    )  # at most COMMON_MOST rows
    low = top.column("low").to_numpy().astype(np.int32).view(np.uint32)
    rank = np.arange(len(low), 0, -1, dtype=np.int64)
    order = np.argsort(low)
    return low[order], rank[order]


def prefixes(docs: DataFrame, words: int, similarity: float, common: Broadcast) -> DataFrame:
    """(shingle, key, n, at): the first shingles of each document's set of ``n``, and their places.

    Sets of Jaccard similarity ``similarity`` share one of their first ``n - ceil(similarity * n) + 1``
    shingles in any order common to all sets; here the commonest come last.
    """

    def work(block: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        often, rank = common.value
        shingles, rows = [np.empty(0, np.uint64)], []
        keys = _set_keys(sets)
        for i, found in enumerate(sets):
            if not len(found):
                continue
            most = len(found) - int(np.ceil(similarity * len(found) - 1e-9)) + 1
            ranks = np.zeros(len(found), dtype=np.int64)
            if len(often):
                low = found.astype(np.uint32)
                place = np.minimum(np.searchsorted(often, low), len(often) - 1)
                ranks = np.where(often[place] == low, rank[place], 0)
            first = np.lexsort((found, ranks))[:most]
            shingles.append(found[first])
            rows.append((keys[i], len(found), len(first)))
        lengths = [r[2] for r in rows]
        at = [np.arange(k, dtype=np.int32) for k in lengths]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(shingles).view(np.int64)),
                pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), lengths)),
                pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), lengths)),
                pa.array(np.concatenate([np.empty(0, np.int32), *at])),
            ],
            ["shingle", "key", "n", "at"],
        )

    return _text_sets(docs, words, work, "shingle BIGINT, key BIGINT, n INT, at INT")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the rows (a, block, member, least, key, shingles) that share at least ``least`` shingles with their a.

    Rows of a block follow each other, the set of a itself before the others.
    """
    whole, held = np.empty(0, np.uint64), None
    for batch in batches:
        a, block, least, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "block", "least", "key"))
        member = batch.column("member").to_numpy(zero_copy_only=False)
        shingles = batch.column("shingles")
        values, ends = shingles.flatten().to_numpy().view(np.uint64), shingles.offsets.to_numpy()
        ends = ends - ends[0]
        found = []
        for i in range(batch.num_rows):
            own = values[ends[i] : ends[i + 1]]
            if not member[i]:
                whole, held = own, (a[i], block[i])
                continue
            if held != (a[i], block[i]):
                raise RuntimeError("a set came before the one that it is compared with")
            at = np.searchsorted(whole, own)
            at[at == len(whole)] = 0
            if len(whole) and np.count_nonzero(whole[at] == own) >= least[i]:
                found.append(i)
        whole = whole.copy()  # the batch goes
        yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(key[found])], ["a", "b"])


class _Sets:
    """Comparisons of whole shingle sets, each held by the document ``rep`` of ``reps`` (key, rep)."""

    def __init__(self, docs: DataFrame, reps: DataFrame, words: int, similarity: float):
        self.docs, self.reps, self.words, self.similarity = docs, reps, words, similarity

    def needed(self, m: Column, n: Column) -> Column:
        """How large the intersection of sets of sizes m and n has to be."""
        return (m + n) * F.lit(self.similarity / (1 + self.similarity)) - F.lit(1e-9)

    def holders(self, keys: DataFrame) -> DataFrame:
        """The documents that hold the sets named in ``keys`` (key)."""
        ids = written(self.reps.join(keys, "key", "left_semi").select(F.col("rep").alias("doc_id")), "simhash-holders")
        return among(self.docs, ids)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the pairs (a, b, least) those whose sets share at least ``least`` shingles.

        Each set goes from its text to where it is compared, once for each pair it is the b of and once for each
        block of pairs it is the a of; blocks are of about ``COMPARED_BLOCK`` pairs, so no task gets all of an a.
        """

        def work(block: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
            values = np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(_set_keys(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                ["key", "shingles"],
            )

        pairs = written(pairs, "simhash-candidates")
        blocks = F.ceil(F.col("count") / COMPARED_BLOCK)
        dealt = pairs.join(pairs.groupBy("a").count(), "a").withColumn("block", F.pmod(F.xxhash64("b"), blocks).cast("int"))
        members = dealt.select(F.col("b").alias("key"), "a", "block", F.lit(True).alias("member"), F.col("least").cast("double"))
        others = dealt.select(F.col("a").alias("key"), "a", "block", F.lit(False), F.lit(0.0)).distinct()
        roles = written(members.union(others), "simhash-compared")
        holders = self.holders(roles.select("key").distinct())
        held = _text_sets(holders, self.words, work, "key BIGINT, shingles ARRAY<BIGINT>")
        met = among(held, roles, "inner", SENT_COMPARISONS).select("a", "block", "member", "least", "key", "shingles")
        found = (
            met.repartition("a", "block").sortWithinPartitions("a", "block", "member").mapInArrow(_compared, "a BIGINT, b BIGINT")
        )
        # Rows that share a doc_id may hold a set twice.
        return written(found.distinct(), "simhash-verified")

    def offered(self, keys: DataFrame) -> DataFrame:
        """Links (a, b) between sets whose documents the SimHashes link, verified on whole sets.

        ``keys``: (doc_id, key, n) of all documents. Every member is compared with the document its component is
        named after, once.
        """
        found = near_duplicates(self.docs).where(F.col("doc_id") != F.col("component_id"))
        links = written(found.select("doc_id", "component_id").distinct(), "simhash-offered")
        ids = links.select("doc_id").union(links.select("component_id")).distinct()
        held = written(among(keys.distinct(), ids), "simhash-offered-keys")
        a = held.toDF("component_id", "a", "m")
        pairs = links.join(held.withColumnRenamed("key", "b"), "doc_id").join(a, "component_id")
        least = self.needed(F.col("m"), F.col("n"))
        return self.verified(
            pairs.where((F.col("a") != F.col("b")) & (F.least("m", "n") >= least))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), least.alias("least"))
            .distinct()
        )

    def stars(self, rows: DataFrame, known: DataFrame, first: tuple[str, ...] = ("key",)) -> tuple[DataFrame, DataFrame]:
        """(rows in shared buckets with their pivot, links to pivots) of ``rows`` (bucket, key, n, at).

        ``known`` (node, component) names sets that are linked already and need no comparison.

        The pivot of a bucket is its least set by the columns ``first``, which are a set's own. Every other set is
        compared with it, once whatever buckets they share: as many comparisons as rows, whatever the size of a
        bucket. What is left before and after the shared places has to allow the similarity.
        """
        ends = rows.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        # Most shingles stand in one set only.
        several = written(ends.where("low < high").select("bucket"), "simhash-several")
        shared = written(among(rows, several), "simhash-shared")
        pivots = written(
            shared.groupBy("bucket").agg(
                F.min(F.struct(*first, "n", "at")).alias("pivot"), F.count(F.lit(1)).alias("held")
            ),
            "simhash-pivots",
        )
        met = written(shared.join(pivots, "bucket"), "simhash-buckets")
        least = self.needed(F.col("pivot.n"), F.col("n"))
        room = F.least("pivot.at", "at") + F.least(F.col("pivot.n") - F.col("pivot.at"), F.col("n") - F.col("at"))
        pairs = (
            met.where((F.col("key") != F.col("pivot.key")) & (F.least("pivot.n", "n") >= least))
            .groupBy(F.col("pivot.key").alias("a"), F.col("key").alias("b"))
            .agg(F.first(least).alias("least"), F.min(room).alias("room"))
            .where("room >= least")
            .drop("room")
        )
        of_a, of_b = known.toDF("a", "of_a"), known.toDF("b", "of_b")
        pairs = (
            pairs.join(of_a, "a", "left").join(of_b, "b", "left")
            .where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
            .select("a", "b", "least")
        )
        return met, self.verified(pairs)

    def mixed(self, met: DataFrame, forest: DataFrame) -> DataFrame:
        """The rows of buckets whose sets are not yet one component, with their components."""
        named = met.join(forest.toDF("key", "component"), "key", "left").withColumn(
            "component", F.coalesce("component", "key")
        )
        several = (
            named.groupBy("bucket")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .where("low < high")
        )
        # Copies have the same rows.
        return written(named.join(several, "bucket", "left_semi").distinct(), "simhash-mixed")

    def across(self, rows: DataFrame) -> DataFrame:
        """Links between sets of different components that share a bucket, but for those with its pivot.

        Two such sets are not both of the bucket's largest component, so only the sets of the others look for
        partners. Places count what comes after the first shared shingle; before it none is shared.
        """
        largest = (
            rows.groupBy("bucket", "component")
            .count()
            .groupBy("bucket")
            .agg(F.max(F.struct("count", "component")).alias("largest"))
            .select("bucket", F.col("largest.component").alias("largest"))
        )
        # Both the others and all rows are dealt by bucket.
        marked = written(rows.where(F.col("key") != F.col("pivot.key")).join(largest, "bucket"), "simhash-marked")
        x, y = marked.where("component != largest").alias("x"), marked.alias("y")
        least = self.needed(F.col("x.n"), F.col("y.n"))
        pairs = (
            x.join(
                y,
                (F.col("x.bucket") == F.col("y.bucket"))
                & (F.col("x.component") != F.col("y.component"))
                & ((F.col("y.component") == F.col("y.largest")) | (F.col("x.key") < F.col("y.key")))
                & (F.least("x.n", "y.n") >= least)
                & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= least),
            )
            .groupBy(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
            .agg(F.first(least).alias("least"))
        )
        return self.verified(pairs)

    def rarest(self, keys: DataFrame) -> DataFrame:
        """(bucket, key, n, at, rare): prefixes of the sets named in ``keys`` (key), their rarest shingles first.

        Shingles are counted over these sets, all of each. One that stands in a single set takes a place and makes no row,
        and neither does one after which too little is left even for the smallest set that has it. ``rare`` is
        least of the set that has most in common with others.
        """

        def work(block: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
            lengths = [len(s) for s in sets]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)),
                    pa.array(np.repeat(_set_keys(sets), lengths)),
                    pa.array(np.repeat(np.array(lengths, np.int32), lengths)),
                ],
                ["bucket", "key", "n"],
            )

        keys = written(keys, "simhash-crowded")
        every = _text_sets(self.holders(keys), self.words, work, "bucket BIGINT, key BIGINT, n INT")
        # Rows that share a doc_id may hold a set twice, or another one.
        every = written(among(every, keys).distinct(), "simhash-shingles")
        counts = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("sets"), F.min("n").alias("least_n"))
        of_set = Window.partitionBy("key")
        placed = every.join(counts, "bucket").select(
            "bucket",
            "key",
            "n",
            "sets",
            "least_n",
            (F.row_number().over(of_set.orderBy("sets", "bucket")) - 1).alias("at"),
            F.sum(F.floor(F.lit(1000) / F.col("sets"))).over(of_set).alias("rare"),
        )
        smallest = F.greatest(F.col("least_n"), F.ceil(F.lit(self.similarity) * F.col("n") - F.lit(1e-9)))
        return placed.where((F.col("sets") > 1) & (F.col("n") - F.col("at") >= self.needed(F.col("n"), smallest))).select(
            "bucket", "key", "n", "at", "rare"
        )


def linked_sets(docs: DataFrame, reps: DataFrame, keys: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, component): the keys of shingle sets that link with others, and the smallest key reachable.

    ``reps``: (key, rep), a document for each set; ``keys``: (doc_id, key, n), the set of each document and its
    size. Links come from the SimHashes first, as far as they reach: what they link is verified on whole sets and not
    compared again. The rest comes from prefixes: sets that link share a shingle of their prefixes. In each shingle's bucket all sets are first compared with one, which makes a group of near
    copies one component by as many comparisons as it has members. Only sets of different components
    that share a bucket are compared after that: pair by pair in small buckets. The sets of larger ones get prefixes
    of their own, rarest first by the counts of all their shingles; there each is compared with the one that has
    most in common with others before the pairs. All comparisons are of whole sets, and no pair that may link is left out.
    """
    doc_id = F.col("doc_id").cast("bigint")
    docs = docs.select(doc_id.alias("doc_id"), "text").where("doc_id IS NOT NULL")  # as the sets of ``reps``
    sets = _Sets(docs, reps, words, similarity)
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
    # Copies give the same rows again, which costs less than to leave them out by a join of all texts.
    first = written(prefixes(docs, words, similarity, common), "simhash-prefixes")
    offered = sets.offered(keys)
    known = written(components(offered), "simhash-known")
    met, links = sets.stars(first.withColumnRenamed("shingle", "bucket"), known)
    forest = written(components(offered.unionByName(links)), "simhash-forest")
    mixed = sets.mixed(met, forest)
    edges = forest.toDF("a", "b").unionByName(sets.across(mixed.where(F.col("held") <= PAIRED_BUCKET)))
    large = mixed.where(F.col("held") > PAIRED_BUCKET).select("key").distinct()
    if not large.isEmpty():
        forest = written(components(edges), "simhash-forest")
        met, links = sets.stars(written(sets.rarest(large), "simhash-second"), forest, ("rare", "key"))
        edges = forest.toDF("a", "b").unionByName(links)
        forest = written(components(edges), "simhash-forest")
        edges = forest.toDF("a", "b").unionByName(sets.across(sets.mixed(met, forest)))
    return components(edges)


def near_duplicates_by_shingles(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``, as `near_duplicates` but by shingle sets.

    Documents link whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity``
    or more. No link is lost: SimHashes that differ in at most two bits (`near_duplicates`) offer links, which are
    verified; at 0.8 those of short texts differ in up to 17 of 64 bits and more, where no part of them
    selects, so the other candidates come from the pigeonhole on shingles (`linked_sets`).
    Shingles and sets are told apart by 64-bit hashes. Texts without words are alike.
    """

    def work(block: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = pa.array([len(s) for s in sets], pa.int32())
        return pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(_set_keys(sets)), sizes], ["doc_id", "key", "n"])

    doc_id = F.col("doc_id").cast("bigint")
    keys = written(_text_sets(docs, words, work, "doc_id BIGINT, key BIGINT, n INT", doc_id), "simhash-keys")
    reps = written(
        keys.groupBy("key").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "simhash-reps"
    )
    # Components are named by key; the group's name is the smallest document of its sets.
    found = written(linked_sets(docs, reps, keys, words, similarity).toDF("key", "group"), "simhash-links")
    named = reps.join(found, "key", "left").withColumn("group", F.coalesce("group", "key"))
    smallest = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    member = named.join(smallest, "group").select("key", "component_id")
    return keys.join(written(member, "simhash-members"), "key", "left").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Fingerprints that differ in at most two bits link; the component is the smallest doc_id
    reachable. Documents with equal fingerprints, copies above all, are one representative until
    the end. A row without doc_id gets its group's component; a group of such rows only gets null.
    An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, words), "simhash-fingerprints")
    reps = written(
        fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL"), "simhash-reps"
    )
    found = components(links(reps))
    member = written(
        reps.join(found, reps["rep"] == found["node"], "left").select(
            "fp", F.coalesce("component", "rep").alias("component_id")
        ),
        "simhash-members",
    )
    return fps.join(member, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame,
    found: DataFrame | None = None,
    words: int = SHINGLE_WORDS,
    similarity: float | None = None,
) -> DataFrame:
    """``docs`` without the near duplicates: of each component the document it is named after stays.

    With ``similarity`` documents link by their sets of ``words``-word shingles, otherwise by
    SimHashes. Rows without doc_id stay; of rows that repeat the same doc_id all stay or none.
    """
    if found is not None:
        member = found
    elif similarity is not None:
        member = near_duplicates_by_shingles(docs, words, similarity)
    else:
        member = near_duplicates(docs, words)
    gone = written(member.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "simhash-gone")
    return among(docs, gone, "left_anti").select(docs.columns)
