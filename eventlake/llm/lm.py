"""Language-model scoring: online logistic mixing of hashed-context bit predictors, and word counts."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import over_texts, written

END = 256  # the symbol after a text's last byte
HEAD_WORDS = 1 << 16  # most frequent words that every task gets; the others are joined
KEPT_WORDS = 500_000  # words a task counts before it hands them on
# Contexts: so many bytes before, or (0) the word up to here; and the bits of their tables.
WORD_SO_FAR = 0
ORDERS = (2, 4, WORD_SO_FAR)
TABLE_BITS = (18, 20, 20)
LEVELS = 4  # of how often a context was seen
# A predictor's log odds, told apart by 32 codes: never seen, then so many steps of each level.
CENTRES = (
    (0.0,),
    (-1.8, -1.25, 0.0, 1.25, 1.8),
    (-4.0, -3.0, -2.1, -1.0, 0.0, 1.0, 2.1, 3.0, 4.0),
    (-8.5, -6.0, -4.4, -3.2, -2.3, -1.6, -1.0, -0.5, 0.0, 0.5, 1.0, 1.6, 2.3, 3.2, 4.4, 6.0, 8.5),
)
SEEN = (1, 3, 30)  # decisions from which on a context is of the next level
CODE_BITS = 5
CELLS = 1 << CODE_BITS * len(ORDERS)  # joint codes of the predictors
START_WEIGHT = 0.4  # of each predictor
GROUPS = 4  # of decisions counted at once: the weights step after each group
PASSES = 8
RIDGE = 20.0  # decisions' worth of trust in the weights at the start
FIRST_CODED = 1 << 16  # decisions a task counts before it predicts; it codes its counts anew whenever they doubled
BINS = 33  # of the refinement
LIMIT = 12.0  # of log odds
CHUNK_BYTES = 1 << 14
COUNTED_AT_ONCE = 1 << 21  # decisions of a group
MET_BITS = 20  # of a task's table of symbols met in their contexts
FINE = 2048  # steps of the final log odds whose costs are looked up
OVERLAP = 256

_ODD = 0x01000193  # odd, so it has an inverse modulo 2**32
_INVERSE = pow(_ODD, -1, 1 << 32)
_POWERS: list[np.ndarray] = []  # of the two, as many as a task has needed


# ---------------------------------------------------------------- words


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


# The end of a text is a token of its own; no word has this spelling, as words hold no space.
END_TOKEN = b" end"
END_HASH = _word_hash(END_TOKEN)


class _Numbers(dict):
    """Words numbered as they come up."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def training_counts(texts: DataFrame, trained: Column) -> DataFrame:
    """(kind, key, n) summed over training texts: kind 0 words by hash, kind 1 bytes by value."""

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        letters = np.zeros(END + 1, dtype=np.int64)
        ends = 0

        def handed_on() -> pa.RecordBatch:
            keys = np.fromiter((_word_hash(w) for w in words), np.int64, len(words))
            counts = np.fromiter(words.values(), np.int64, len(words))
            seen = np.flatnonzero(letters)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([0, 1], [len(keys) + 1, len(seen)]).astype(np.int32)),
                    pa.array(np.concatenate([keys, [END_HASH], seen])),
                    pa.array(np.concatenate([counts, [ends], letters[seen]])),
                ],
                ["kind", "key", "n"],
            )
            words.clear()
            letters[:] = 0
            return out

        for block in blocks:
            for text in block.column("text").to_pylist():
                lowered = (text or b"").lower()
                words.update(lowered.split())
                letters[:END] += np.bincount(np.frombuffer(lowered, np.uint8), minlength=END)
                letters[END] += 1
                ends += 1
            if len(words) > KEPT_WORDS:
                yield handed_on()
                ends = 0
        if ends or words:
            yield handed_on()

    rows = over_texts(
        texts.where(trained),
        [F.col("text").cast("binary").alias("text")],
        work,
        "kind INT, key BIGINT, n BIGINT",
    )
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n")).where("n > 0")


# ---------------------------------------------------------------- bits


@dataclass
class Code:
    """A Huffman code of bytes and the end: for each symbol its decisions, as tree nodes and bits."""

    first: np.ndarray  # where a symbol's decisions begin
    length: np.ndarray
    # A hash of the node's group (up to five levels of the tree below one node), its place in there
    # (1 to 31), the node and the bit, in 32, 5, 9 and 1 bits.
    packed: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> Code:
        heap = [(float(n) + 0.01, s, s) for s, n in enumerate(counts)]
        heapq.heapify(heap)
        children, following = {}, END + 1
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            children[following] = (a[2], b[2])
            heapq.heappush(heap, (a[0] + b[0], following, following))
            following += 1
        root = heap[0][2]
        paths: dict[int, list[tuple[int, int, int, int]]] = {}
        stack: list = [(root, root, 1, [])]
        while stack:
            at, group, index, path = stack.pop()
            if at <= END:
                paths[at] = path
                continue
            if index > 31:
                group, index = at, 1
            for bit, child in enumerate(children[at]):
                stack.append(
                    (child, group, 2 * index + bit, [*path, (at - END - 1, bit, group, index)])
                )
        length = np.array([len(paths[s]) for s in range(END + 1)], dtype=np.int32)
        flat = [d for s in range(END + 1) for d in paths[s]]
        return cls(
            (np.cumsum(length) - length).astype(np.int32),
            length,
            np.array(
                [(g * 0x9E3779B1 % (1 << 32)) << 15 | i << 10 | n << 1 | b for n, b, g, i in flat],
                dtype=np.int64,
            ),
        )


def decisions(
    code: Code, symbols: np.ndarray, starts: np.ndarray
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Nodes, bits, a slot in each order's table, and the number of decisions of each symbol.

    ``symbols`` are several texts, each with its end; contexts don't reach before a text's start.
    """
    return spread(code, symbols, *contexts(symbols, starts))


def contexts(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes before each place, as many as the longest order has, and a hash of the word up to here."""
    return _before(symbols, starts, max(ORDERS)), _word_so_far(symbols, starts)


def spread(
    code: Code, symbols: np.ndarray, before: np.ndarray, word: np.ndarray
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """The `decisions` of symbols in their contexts, which need not follow each other."""
    n = len(symbols)
    length = code.length.take(symbols)
    ends = np.cumsum(length, dtype=np.int64)
    # What a symbol's decisions share is a row, handed to all of them at once: the contexts, and where they begin.
    rows = np.empty((n, len(ORDERS) + 1), dtype=np.uint32)
    for k, order in enumerate(ORDERS):
        context = word.copy() if order == WORD_SO_FAR else before & np.uint32((1 << 8 * order) - 1)
        context *= np.uint32(0x85EBCA6B)
        context ^= context >> np.uint32(13)
        rows[:, k] = context
    rows[:, -1] = (code.first.take(symbols) - (ends - length).astype(np.int32)).view(np.uint32)
    rows = np.repeat(rows, length, axis=0)
    step = np.arange(ends[-1] if n else 0)
    step += rows.view(np.int32)[:, -1]
    packed = code.packed.take(step)
    bit = (packed & 1).astype(np.uint8)
    node = (packed >> 1).astype(np.int32) & np.int32(511)
    index = (packed >> 10).astype(np.uint32)
    group = (packed >> 15).astype(np.uint32)
    slots = []
    for k, bits in enumerate(TABLE_BITS):
        slot = rows[:, k] ^ group
        slot *= np.uint32(0x2C1B3C6D)
        # The decisions of a context and group lie side by side in memory.
        turned = (slot + index) & np.uint32(31)
        slot >>= np.uint32(32 - bits)
        slot &= np.uint32((1 << 32) - 32)
        slot |= turned
        slots.append(slot)
    return node, bit, slots, length


def _before(symbols: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes (4 at most) at each place, none from before a text's start."""
    bytes_ = symbols & np.uint32(255)
    context = np.zeros(len(symbols), dtype=np.uint32)
    for k in range(order):
        context[k + 1 :] |= bytes_[: -k - 1] << np.uint32(8 * k)
    ends = np.append(starts[1:], len(symbols))
    for k in range(order):
        at = (starts + k)[starts + k < ends]
        context[at] &= np.uint32((1 << 8 * k) - 1)
    return context


def _powers_of(odd: int, n: int) -> np.ndarray:
    powers = np.full(n, odd, dtype=np.uint32)
    powers[0] = 1
    return np.cumprod(powers, out=powers)


def _word_so_far(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the bytes since the last white space: sums of bytes times powers of an odd number."""
    n = len(symbols)
    if len(_POWERS) == 0 or len(_POWERS[0]) <= n:
        _POWERS[:] = (_powers_of(odd, max(n + 1, 8 * CHUNK_BYTES)) for odd in (_ODD, _INVERSE))
    powers, back = _POWERS
    sums = np.zeros(n + 1, dtype=np.uint32)
    np.cumsum((symbols + np.uint32(1)) * powers[:n], out=sums[1:])
    blank = np.zeros(n, dtype=bool)
    blank[1:] = symbols[:-1] <= 32
    blank[starts] = True
    begin = np.flatnonzero(blank)
    context = sums[:n] - np.repeat(sums[begin], np.diff(begin, append=n))
    context *= np.repeat(back[begin], np.diff(begin, append=n))
    context ^= context >> np.uint32(15)
    return context


def _met_as(symbols: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each symbol in its contexts, never 0, and its place in a table of 2**MET_BITS.

    All that a symbol's decisions depend on is the symbol and these contexts; 63 bits tell them apart.
    """
    key = before.astype(np.uint64)
    key <<= np.uint64(32)
    key |= word
    key *= np.uint64(0x9E3779B97F4A7C15)
    key += symbols * np.uint64(0xD6E8FEB86659FD93)
    at = (key >> np.uint64(64 - MET_BITS)).astype(np.int64)
    key |= np.uint64(1)
    return key, at


def _symbols(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [(t or b"").lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1
    starts = np.cumsum(sizes) - sizes
    symbols = np.empty(int(sizes.sum()), dtype=np.uint32)
    joined = np.frombuffer(b"\0".join(lowered) + b"\0", dtype=np.uint8)
    symbols[:] = joined
    symbols[starts + sizes - 1] = END
    return symbols, starts


def _chunks(texts: list[bytes | None], most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, starts, which text) of groups of whole texts; a text longer than that is a group."""
    group: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if group and size + len(text or b"") > most:
            yield *_symbols([texts[k] for k in group]), np.array(group)
            group, size = [], 0
        group.append(i)
        size += len(text or b"")
    if group:
        yield *_symbols([texts[k] for k in group]), np.array(group)


def codes(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The codes of contexts that saw so many zeros and ones."""
    seen = zeros + ones
    odds = np.log((ones + 0.4) / (zeros + 0.4))
    out, before = np.zeros(len(odds), dtype=np.uint8), 1
    for centres, low, high in zip(CENTRES[1:], SEEN, (*SEEN[1:], np.inf)):
        at = np.flatnonzero((seen >= low) & (seen < high))
        middles = (np.array(centres[1:]) + centres[:-1]) / 2
        out[at] = before + np.searchsorted(middles, odds[at])
        before += len(centres)
    return out


def cells() -> tuple[np.ndarray, np.ndarray]:
    """(gate, inputs) of all joint codes: how often the contexts were seen; log odds of each predictor, and a one."""
    level = np.repeat(np.arange(LEVELS), [len(c) for c in CENTRES])
    centre = np.concatenate(CENTRES)
    every = np.arange(CELLS)
    gate, inputs = np.zeros(CELLS, dtype=np.int64), [np.ones(CELLS)]
    for k in range(len(ORDERS)):
        code = every >> CODE_BITS * k & (1 << CODE_BITS) - 1
        gate += level[code] * LEVELS**k
        inputs.insert(0, centre[code])
    return gate, np.stack(inputs, axis=1)


def plain_bins(inputs: np.ndarray) -> np.ndarray:
    """The bin that the plain mix of each joint code falls into."""
    plain = np.clip(START_WEIGHT * inputs[:, :-1].sum(axis=1), -8, 8)
    return ((plain + 8) * (BINS - 1) / 16 + 0.5).astype(np.int16)


def bit_counts(texts: DataFrame, trained: Column, code: Code) -> DataFrame:
    """(slot, zeros, ones) summed over training texts; the tables of all orders lie one after another.

    After them come the decisions by joint code, for each of ``GROUPS``, and those by node and bin of the plain
    mix (`learn`). A decision's codes are of what its task had counted before, its text not included,
    or rare contexts would look surer than they are. Nothing grows with the input.
    """
    sizes = [1 << b for b in TABLE_BITS]
    bins = plain_bins(cells()[1])

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * size, dtype=np.int32) for size in sizes]
        joint = np.zeros(GROUPS * 2 * CELLS, dtype=np.int64)
        by_node = np.zeros(2 * (END + 1) * BINS, dtype=np.int64)
        coded = [np.zeros(size, dtype=np.uint8) for size in sizes]
        # What is met again in the same contexts is only counted, by group, until the codes change.
        keys = np.zeros(1 << MET_BITS, dtype=np.uint64)
        met = [np.zeros(1 << MET_BITS, dtype=t) for t in (np.uint16, np.uint32, np.uint32)]
        times = np.zeros((GROUPS, 1 << MET_BITS), dtype=np.int32)
        gathered = counted = turn = 0
        due = FIRST_CODED

        def add_up(
            symbols: np.ndarray, before: np.ndarray, word: np.ndarray, n: np.ndarray, cut: int | None = None
        ) -> None:
            """Adds the decisions of symbols that came n (groups, symbols) times, those from ``cut`` on to the next group."""
            node, bit, slots, length = spread(code, symbols, before, word)
            cell = joint_codes(coded, slots)
            node *= np.int32(BINS)
            node += bins.take(cell)
            every = np.repeat(n.sum(axis=0, dtype=np.int32), length)
            for table, keys_ in zip((*tables, by_node), (*slots, node)):
                np.add.at(table, (keys_.astype(np.int64) << 1) | bit, every.astype(table.dtype, copy=False))
            for g in np.flatnonzero(n.any(axis=1)):
                own = (cell.astype(np.int64) + g * CELLS << 1) | bit
                if cut is not None:
                    own[cut:] = (own[cut:] + 2 * CELLS) % len(joint)
                np.add.at(joint, own, np.repeat(n[g], length).astype(joint.dtype))

        def hand_over() -> None:
            held = np.flatnonzero(keys)
            for start in range(0, len(held), CHUNK_BYTES):
                part = held[start : start + CHUNK_BYTES]
                add_up(*(column[part] for column in met), times[:, part])
            keys[:] = 0
            times[:] = 0

        def count(symbols: np.ndarray, before: np.ndarray, word: np.ndarray) -> None:
            key, at = _met_as(symbols, before, word)
            free = np.flatnonzero(keys[at] == 0)
            keys[at[free]] = key[free]
            same = keys[at] == key
            free = free[same[free]]
            for column, values in zip(met, (symbols, before, word)):
                column[at[free]] = values[free]
            np.add.at(times[turn % GROUPS], at[same], np.int32(1))
            others = np.flatnonzero(~same)
            add_up(symbols[others], before[others], word[others], once(len(others)))

        def once(n: int) -> np.ndarray:
            out = np.zeros((GROUPS, n), dtype=np.int32)
            out[turn % GROUPS] = 1
            return out

        for block in blocks:
            for symbols, starts, _ in _chunks(block.column("text").to_pylist()):
                every = (symbols, *contexts(symbols, starts))
                ends = np.cumsum(code.length.take(symbols), dtype=np.int64)
                done = reached = 0
                while done < len(symbols):
                    # A group may end amid a symbol's decisions; long texts are counted in parts.
                    room = COUNTED_AT_ONCE - gathered
                    whole = int(np.searchsorted(ends, reached + room, side="right"))
                    upto = min(len(symbols), done + 4 * CHUNK_BYTES, max(whole, done + 1))
                    part = [column[done:upto] for column in every]
                    if whole > done:
                        count(*part)
                    else:
                        add_up(*part, once(1), room)
                    gathered += int(ends[upto - 1]) - reached
                    done, reached = upto, int(ends[upto - 1])
                    if gathered >= COUNTED_AT_ONCE:
                        gathered, turn = gathered - COUNTED_AT_ONCE, turn + 1
                counted += reached
                if counted >= due:
                    hand_over()
                    gathered, turn, due = 0, turn + 1, 2 * counted
                    for table, some in zip(tables, coded):
                        seen = np.flatnonzero(table.view(np.int64))  # zeros and ones of a slot at once
                        some[seen] = codes(table[2 * seen], table[2 * seen + 1])
        hand_over()
        offset = 0
        for table in (*tables, joint, by_node):
            pairs = table.reshape(-1, 2)
            seen = np.flatnonzero(pairs.any(axis=1))
            for start in range(0, len(seen), 1 << 18):
                part = seen[start : start + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part + offset).astype(np.int32)), *(pa.array(pairs[part, k].astype(np.int64)) for k in (0, 1))],
                    ["slot", "zeros", "ones"],
                )
            offset += len(pairs)

    # Each task hands on a table, so there are few: two for each core.
    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism
    rows = over_texts(
        texts.where(trained).coalesce(tasks),
        [F.col("text").cast("binary").alias("text")],
        work,
        "slot INT, zeros BIGINT, ones BIGINT",
    )
    return rows.groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))


def coded_tables(counts: DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The predictors, as the code of each slot; the decisions by joint code, and those by node and bin.

    All have a fixed size (``TABLE_BITS``, 2.4 MB, and 2.4 MB), and so has what the driver gets.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = codes(batch.column("zeros").to_numpy(), batch.column("ones").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(coded.view(np.int8))], ["slot", "code"])

    sizes = [1 << b for b in TABLE_BITS]
    table = np.zeros(sum(sizes), dtype=np.uint8)
    rows = counts.where(F.col("slot") < sum(sizes)).mapInArrow(work, "slot INT, code TINYINT").toArrow()
    table[rows.column("slot").to_numpy()] = rows.column("code").to_numpy()
    rest = np.zeros((GROUPS * CELLS + (END + 1) * BINS, 2), dtype=np.int64)
    rows = counts.where(F.col("slot") >= sum(sizes)).toArrow()
    rest[rows.column("slot").to_numpy() - sum(sizes)] = np.stack([rows.column(c).to_numpy() for c in ("zeros", "ones")], 1)
    joint, by_node = np.split(rest, [GROUPS * CELLS])
    return (
        np.split(table, np.cumsum(sizes)[:-1]),
        joint.reshape(GROUPS, CELLS, 2),
        by_node.reshape(END + 1, BINS, 2),
    )


def joint_codes(tables: list[np.ndarray], slots: list[np.ndarray]) -> np.ndarray:
    cell = None
    for table, slot in zip(tables, slots):
        code = table.take(slot)
        code &= (1 << CODE_BITS) - 1
        if cell is None:
            cell = code.astype(np.int32)
        else:
            cell <<= np.int32(CODE_BITS)
            cell |= code
    return cell


@dataclass
class Mixer:
    """Weights of the predictors, by gate, and what their plain mix turned out to mean, by node and bin."""

    weights: np.ndarray  # (gates, orders + 1)
    refined: np.ndarray  # (nodes, BINS)

    @classmethod
    def new(cls) -> Mixer:
        gates = LEVELS ** len(ORDERS)
        bins = np.linspace(-8, 8, BINS, dtype=np.float32)
        return cls(
            np.full((gates, len(ORDERS) + 1), [START_WEIGHT] * len(ORDERS) + [0.0], dtype=np.float32),
            np.tile(bins, (END + 1, 1)),
        )

    def __post_init__(self) -> None:
        gate, inputs = cells()
        mixed = np.clip((self.weights[gate] * inputs).sum(axis=1), -LIMIT, LIMIT)
        # Half the mixed log odds, in steps of the final ones, and the bin of the plain mix, by joint code.
        self.steps = (mixed * ((FINE - 1) / (4 * LIMIT))).astype(np.float32)
        self.bins = plain_bins(inputs)

    def inputs(self, tables: list[np.ndarray], slots: list[np.ndarray]) -> tuple[np.ndarray]:
        return (joint_codes(tables, slots),)

    def mixed(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.steps.take(cell), self.bins.take(cell)

    def cost_table(self) -> tuple[np.ndarray, np.ndarray]:
        """What the refinement adds to the step of the final log odds, by node and bin; the cost by step and bit.

        A cost is the natural logarithm of one over the probability. The final log odds are half the
        mixed ones and half what the plain mix turned out to mean at this node.
        """
        steps = (self.refined.astype(np.float64) / 2 + LIMIT) * ((FINE - 1) / (2 * LIMIT)) + 0.5
        final = (np.arange(FINE) / (FINE - 1) * 2 - 1) * LIMIT
        both = np.stack([np.logaddexp(0, final), np.logaddexp(0, -final)], axis=1)
        return steps.astype(np.float32).ravel(), both.astype(np.float32).ravel()


def costs(
    table: tuple[np.ndarray, np.ndarray], node: np.ndarray, bit: np.ndarray, mixed: tuple[np.ndarray, np.ndarray]
) -> np.ndarray:
    refined, both = table
    steps, bins = mixed
    at = node * np.int32(BINS)
    at += bins
    steps += refined.take(at)
    cell = steps.astype(np.int32)
    cell <<= np.int32(1)
    cell |= bit
    return both.take(cell)


def learn(joint: np.ndarray, by_node: np.ndarray) -> Mixer:
    """A mixer that has learned online: the weights of all gates step after each group of decisions.

    ``joint``: (groups, CELLS, 2) and ``by_node``: (nodes, BINS, 2), zeros and ones (`bit_counts`). Steps are
    Newton's, by the curvature of the groups met so far; gates of few decisions stay near their first weights.
    """
    mixer = Mixer.new()
    gate, inputs = cells()
    gates, width = mixer.weights.shape
    weights = start = mixer.weights.astype(np.float64)
    curves = np.zeros((len(joint), gates, width, width))
    for _ in range(PASSES):
        for g, (zeros, ones) in enumerate(joint.transpose(0, 2, 1).astype(np.float64)):
            n = zeros + ones
            share = 1 / (1 + np.exp(-np.clip((weights[gate] * inputs).sum(axis=1), -LIMIT, LIMIT)))
            slope, curves[g] = np.zeros((gates, width)), 0
            np.add.at(slope, gate, (ones - n * share)[:, None] * inputs)
            np.add.at(curves[g], gate, (n * share * (1 - share))[:, None, None] * inputs[:, :, None] * inputs[:, None])
            slope -= RIDGE / len(joint) * (weights - start)
            step = np.linalg.solve(curves.sum(axis=0) + RIDGE * np.eye(width), slope[:, :, None])[:, :, 0]
            weights = weights + np.clip(step, -0.5, 0.5)
    # Refinement counts begin as if each bin had been right a few times.
    ones = by_node[:, :, 1] + 4.0 / (1 + np.exp(-mixer.refined.astype(np.float64)))
    share = np.clip(ones / (by_node.sum(axis=2) + 4.0), 1e-5, 1 - 1e-5)
    return Mixer(weights.astype(np.float32), np.log(share / (1 - share)).astype(np.float32))


class Costs:
    """Costs of whole texts under one model.

    A task remembers what symbols cost in the contexts it met them in, as many as a table of fixed size holds.
    """

    def __init__(self, code: Code, tables: list[np.ndarray], mixer: Mixer):
        self.code, self.tables, self.mixer, self.table = code, tables, mixer, mixer.cost_table()
        self.keys = np.zeros(1 << MET_BITS, dtype=np.uint64)
        self.known = np.zeros(1 << MET_BITS)

    def of_symbols(self, symbols: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        key, at = _met_as(symbols, before, word)
        out = self.known[at]
        new = np.flatnonzero(self.keys[at] != key)
        if len(new):
            node, bit, slots, length = spread(self.code, symbols[new], before[new], word[new])
            cost = costs(self.table, node, bit, self.mixer.mixed(*self.mixer.inputs(self.tables, slots)))
            out[new] = np.add.reduceat(cost.astype(np.float64), np.cumsum(length) - length)
            self.keys[at[new]] = key[new]
            self.known[at[new]] = out[new]
        return out

    def of_texts(self, texts: list[bytes | None]) -> np.ndarray:
        """Natural logarithm of one over the probability of each whole text, its end included."""
        out = np.zeros(len(texts))
        for symbols, starts, which in _chunks(texts):
            sums = np.zeros(len(which))
            # A very long text is scored in stretches that overlap; a context reaches no further back.
            for begin in range(0, len(symbols), 4 * CHUNK_BYTES):
                low = max(0, begin - OVERLAP)
                part = symbols[low : begin + 4 * CHUNK_BYTES]
                own = np.array([0]) if low else starts[starts < len(part)]
                cost = self.of_symbols(*(c[begin - low :] for c in (part, *contexts(part, own))))
                if low:
                    sums[0] += cost.sum()
                else:
                    sums[: len(own)] += np.add.reduceat(cost, own)
            out[which] = sums
        return out


def text_costs(texts: list[bytes | None], code: Code, tables: list[np.ndarray], mixer: Mixer) -> np.ndarray:
    return Costs(code, tables, mixer).of_texts(texts)


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, trained: Column) -> DataFrame:
    """Scores of every whole text, by word counts and by the mixing model, learned from ``trained`` rows.

    (doc_id, trained, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row
    of ``docs`` (doc_id, text; other columns are read by ``trained`` only). A-Z are lower-cased; a text's tokens are
    its words and one end. ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over tokens;
    ``score`` is the model's log10 probability of the text's bytes and its end. A null text is empty.
    Without training rows every count is 0 and the model knows nothing but its start.

    Word and byte counts, bit predictors, gated weights and refinement are learned from all training texts,
    whole. A task that counts for the predictors first predicts what it is going to count, by what it has counted;
    the weights and the refinement are learned online from how often that came true, so they depend a little on how
    texts are dealt out to tasks. Words are told apart by a 64-bit hash. Scoring reads texts once: frequent words are
    looked up in a table of bounded size, the others meet the counts in a join.
    """
    spark = docs.sparkSession
    counts = written(training_counts(docs, trained), "lm-counts")
    words = counts.where("kind = 0")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    all_tokens, distinct = int(totals[0]), int(totals[1])
    letters = np.zeros(END + 1)
    for r in counts.where("kind = 1").collect():  # at most 257 rows
        letters[r["key"]] = r["n"]
    code = Code.of(letters)
    tables, joint, by_node = coded_tables(written(bit_counts(docs, trained, code), "lm-bits"))
    mixer = learn(joint, by_node)
    head = (
        words.orderBy(F.desc("n"), "key").limit(HEAD_WORDS).select("key", "n").toArrow()
    )  # HEAD_WORDS rows
    head_keys, head_counts = head.column("key").to_numpy(), head.column("n").to_numpy()
    order = np.argsort(head_keys)
    shared = spark.sparkContext.broadcast(
        (tables, mixer.weights, mixer.refined, head_keys[order], head_counts[order])
    )
    below = np.log10(all_tokens + 0.5 * (distinct + 1))

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables_, weights, refined, keys, key_counts = shared.value
        priced = Costs(code, tables_, Mixer(weights, refined))
        logs = np.log10(key_counts + 0.5) - below
        numbers = _Numbers()
        known_keys, known_logs = np.empty(0, np.int64), np.empty(0)
        for block in blocks:
            texts = block.column("text").to_pylist()
            cost = priced.of_texts(texts)
            if len(numbers) > KEPT_WORDS:
                numbers.clear()
                known_keys, known_logs = np.empty(0, np.int64), np.empty(0)
            found, tokens = [], []
            for text in texts:
                words_ = text.lower().split() if text else []
                words_.append(END_TOKEN)
                found += map(numbers.__getitem__, words_)
                tokens.append(len(words_))
            fresh = list(islice(numbers, len(known_keys), None))
            if fresh:
                new = np.fromiter(map(_word_hash, fresh), np.int64, len(fresh))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, new), len(keys) - 1)
                    new_logs = np.where(keys[at] == new, logs[at], np.nan)
                else:
                    new_logs = np.full(len(new), np.nan)
                known_keys = np.concatenate([known_keys, new])
                known_logs = np.concatenate([known_logs, new_logs])
            number = np.array(found, dtype=np.int64)
            first = np.cumsum(tokens) - np.array(tokens)
            own_logs = known_logs[number]
            frequent = ~np.isnan(own_logs)
            own_logs[~frequent] = 0
            rare = np.flatnonzero(~frequent)
            ends = np.searchsorted(rare, np.append(first, len(number)))
            offsets = pa.array(ends.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    block.column("trained"),
                    block.column("row"),
                    pa.array(tokens, pa.int64()),
                    pa.array(np.add.reduceat(frequent.astype(np.int64), first)),
                    pa.array(np.add.reduceat(own_logs, first)),
                    pa.array(-cost / np.log(10)),
                    pa.array(np.array([len(t or b"") for t in texts], dtype=np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(known_keys[number[rare]])),
                ],
                ["doc_id", "trained", "row", "n_tokens", "head_known", "head_score", "score", "n_bytes", "keys"],
            )

    scored = written(
        over_texts(
            docs,
            [
                F.col("doc_id").cast("bigint"),
                F.col("text").cast("binary").alias("text"),
                trained.alias("trained"),
                F.monotonically_increasing_id().alias("row"),
            ],
            work,
            "doc_id BIGINT, trained BOOLEAN, row BIGINT, n_tokens BIGINT, head_known BIGINT, head_score DOUBLE, "
            "score DOUBLE, n_bytes BIGINT, keys ARRAY<BIGINT>",
            2 << 20,
        ),
        "lm-scores",
    )
    unknown = float(np.log10(0.5) - below)
    if all_tokens:
        rare = scored.select("row", F.explode("keys").alias("key"))
        met = rare.join(words.select("key", "n"), "key", "left")
        seen = met.groupBy("row").agg(
            F.count("n").alias("tail_known"),
            F.sum(
                F.coalesce(F.log10(F.col("n") + 0.5) - F.lit(float(below)), F.lit(unknown))
            ).alias("tail_score"),
        )
        joined = scored.drop("keys").join(seen, "row", "left")
    else:
        joined = scored.withColumn("tail_known", F.lit(0)).withColumn(
            "tail_score", F.col("n_tokens") * F.lit(unknown) - F.col("head_score")
        )
    return joined.select(
        "doc_id",
        "trained",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(all_tokens).cast("bigint").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"),
        "score",
        F.when(F.col("n_bytes") > 0, -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias(
            "bits_per_byte"
        ),
    )
