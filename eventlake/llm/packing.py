"""Packing token sequences into fixed windows by non-negative least squares over lengths."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import over_texts, written

WINDOW_TOKENS = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
# Words whose ids a worker remembers; it starts anew when there are more.
REMEMBERED_WORDS = 500_000
# For each length, how many partner lengths are tried in combinations of three.
PARTNERS = 8
_SINGLES = 40  # bits for the sequences of one piece that a task numbers


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Ids of texts, word by word: no token of this kind of tokenizer spans white space.

    New words are encoded many at a time: words of letters end in a token that ends a word, and between
    others stands a digit that is a token of its own. A
    full stop or comma after a letter or digit is a token too, so a word before it is encoded once.
    The tokenizer lower-cases, so words are remembered in lower case (but where a text may hold the
    name of a special token, which is told from other text by its case).
    """

    SEPARATOR = b"7"

    def __init__(self, path: str, most: int = REMEMBERED_WORDS) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.most = most
        (self.separator,) = self._encode([self.SEPARATOR])[0].tolist()
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.lowers = self._same(b"Aa", b"aa")
        self.stops = {
            stop: self._encode([stop])[0].tobytes()
            for stop in (b".", b",")
            if self._same(b"a" + stop, b"a " + stop) and self._same(b"7" + stop, b"7 " + stop)
        }

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        texts = [w.decode("utf-8", "replace") for w in words]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4") for e in found]

    def _same(self, a: bytes, b: bytes) -> bool:
        x, y = self._encode([a, b])
        return np.array_equal(x, y)

    def _learn(self, new: list[bytes]) -> None:
        # Words of letters end in a token that ends a word, and hold no other.
        lettered, others = [], []
        for w in new:
            (lettered if w.decode("utf-8", "replace").isalpha() else others).append(w)
        for start in range(0, len(lettered), 256):
            self._cut(lettered[start : start + 256], b" ", lambda ids: np.flatnonzero(self.ending[ids]) + 1)
        between = b" " + self.SEPARATOR + b" "
        together = [w for w in others if self.SEPARATOR not in w]
        for start in range(0, len(together), 256):
            self._cut(together[start : start + 256], between, None)
        alone = [w for w in others if self.SEPARATOR in w]
        self.known.update((w, i.tobytes()) for w, i in zip(alone, self._encode(alone)))

    def _cut(self, words: list[bytes], between: bytes, ends: Callable | None) -> None:
        """Encodes the words as one text and cuts its ids; one by one if they can't be told apart."""
        (ids,) = self._encode([between.join(words)])
        if ends is not None:
            high = ends(ids)
            low = np.concatenate([[0], high[:-1]])
        else:
            cuts = np.flatnonzero(ids == self.separator)
            low, high = np.append(0, cuts + 1), np.append(cuts, len(ids))
        if len(high) != len(words):
            self.known.update((w, i.tobytes()) for w, i in zip(words, self._encode(words)))
            return
        data = ids.tobytes()
        self.known.update(
            (w, data[a:b]) for w, a, b in zip(words, (low * 4).tolist(), (high * 4).tolist())
        )

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        numbers, found, sizes = _Numbers(), [], []
        for text in texts:
            if text:
                words = (text.lower() if self.lowers and b"<|" not in text else text).split()
                found += map(numbers.__getitem__, words)
                sizes.append(len(words))
            else:
                sizes.append(0)
        if len(self.known) > self.most:
            self.known.clear()
        new = numbers.keys() - self.known.keys()
        stopped = [w for w in new if w[-1:] in self.stops and w[-2:-1].isalnum()]
        new.difference_update(stopped)
        new.update(w[:-1] for w in stopped)
        self._learn(list(new.difference(self.known)))
        self.known.update((w, self.known[w[:-1]] + self.stops[w[-1:]]) for w in stopped)
        # Each word's ids are a stretch of ``flat``; the texts' words pick their stretches.
        encoded = list(map(self.known.__getitem__, numbers))
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), dtype="<u4")
        word = np.array(found, dtype=np.int64)
        length = lengths[word]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0)
        at += np.repeat((np.cumsum(lengths) - lengths)[word] - (ends - length), length)
        ids = flat[at]
        cuts = np.concatenate([[0], ends])[np.cumsum([0, *sizes])].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


class _Numbers(dict):
    """Words numbered as they come up."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def remembered(path: str) -> WordTokens:
    """The encoder of this process: tasks that run in one worker after another share its words."""
    import tokenizers

    encoders = tokenizers.__dict__.setdefault("_encoders_of_tasks", {})
    if path not in encoders:
        encoders[path] = WordTokens(path)
    return encoders[path]


def measure(docs: DataFrame, path: str, end_id: int = END_ID, window: int = WINDOW_TOKENS) -> DataFrame:
    """One row per document: its length in tokens and the check sums of its pieces.

    A document is cut at multiples of ``window``; of what is left, the first half a window stands
    alone if there is so much (a power of two needs no padding), and the ``tail`` is below that.
    ``rank`` numbers the tails of one length within the task's ``part`` of the table, ``single``
    the pieces that fill a sequence alone; both follow the order of the rows read.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    half = window // 2

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = remembered(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(half, dtype=np.int64)
        single = 0
        for block in blocks:
            sizes, sums, tails, ranks, singles = [], [], [], [], []
            for ids in encode(block.column("text").to_pylist()):
                ids += end
                n = len(ids) // 4
                cuts = list(range(0, n - n % window, window))
                rest = n - n % window
                if n % window >= half:
                    cuts.append(rest)
                    rest += half
                tail = n - rest
                view = memoryview(ids)
                bounds = [*cuts, rest] if tail else cuts
                sums.append([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds, [*bounds[1:], n])])
                sizes.append(n)
                tails.append(tail)
                singles.append(single)
                ranks.append(int(seen[tail]))
                single += len(cuts)
                seen[tail] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.list_(pa.int64())),
                    pa.array(tails, pa.int32()),
                    pa.array(ranks, pa.int64()),
                    pa.array(singles, pa.int64()),
                    pa.array([part] * len(sizes), pa.int64()),
                ],
                ["doc_id", "doc_tokens", "sums", "tail", "rank", "single", "part"],
            )

    columns = [F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")]
    return over_texts(
        docs,
        columns,
        work,
        "doc_id BIGINT, doc_tokens BIGINT, sums ARRAY<BIGINT>, tail INT, rank BIGINT, single BIGINT, "
        "part BIGINT",
    )


def combinations(lengths: np.ndarray, window: int, partners: int = PARTNERS) -> list[dict[int, int]]:
    """Shallow ways to fill a window exactly with the lengths there are: {length: how often}.

    Of one or two lengths (one of them repeated), and of three, with ``partners`` second lengths
    spread over those there are.
    """
    there = set(lengths.tolist())
    found: dict[tuple, dict[int, int]] = {}

    def add(*parts: tuple[int, int]) -> None:
        combo: dict[int, int] = {}
        for length, times in parts:
            combo[length] = combo.get(length, 0) + times
        found[tuple(sorted(combo.items()))] = combo

    for a in sorted(there):
        for times in range(1, min(window // a, 64) + 1):
            rest = window - times * a
            if rest == 0:
                add((a, times))
            elif rest in there:
                add((a, times), (rest, 1))
        fitting = [b for b in sorted(there) if b <= a and window - a - b in there and window - a - b <= b]
        for k in np.unique(np.linspace(0, len(fitting) - 1, min(partners, len(fitting))).astype(int)):
            add((a, 1), (fitting[k], 1), (window - a - fitting[k], 1))
    return list(found.values())


def repeat_counts(combos: list[dict[int, int]], histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """How often each combination is used: non-negative least squares against the histogram.

    Projected gradient steps with momentum; the matrix has a few entries for each combination.
    """
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.array([length for c in combos for length in c], dtype=np.int64)
    times = np.array([t for c in combos for t in c.values()], dtype=np.float64)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=times * x[column], minlength=len(histogram))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(column, weights=times * r[row], minlength=len(combos))

    # The largest eigenvalue bounds the step.
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(used(v))
        largest = np.linalg.norm(v)
        v /= largest
    x = np.zeros(len(combos))
    y, momentum = x.copy(), 1.0
    for _ in range(steps):
        following = np.maximum(0, y - back(used(y) - histogram) / (1.05 * largest))
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = following + (momentum - 1) / faster * (following - x)
        x, momentum = following, faster
    return x


def patterns(histogram: np.ndarray, window: int = WINDOW_TOKENS) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: how often}) such that every length of the histogram is used up exactly.

    ``histogram[l]`` counts the pieces of length l, all of at most half a window. Combinations
    solved for come first, rounded down; what is left is packed greedily: the longest that fits,
    as often as it fits, and so on, and such a filling is repeated while its pieces last.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[int, dict[int, int]]] = []
    combos = combinations(np.flatnonzero(left), window)
    if combos:
        counts = np.floor(repeat_counts(combos, left.astype(np.float64)) + 1e-6).astype(np.int64)
        for k in np.argsort(-counts, kind="stable"):
            combo = combos[k]
            repeats = min([int(counts[k]), *(int(left[a]) // t for a, t in combo.items())])
            if repeats > 0:
                out.append((repeats, combo))
                for a, t in combo.items():
                    left[a] -= repeats * t
    while left.any():
        space, filling = window, {}
        while space:
            fitting = np.flatnonzero(left[: space + 1])
            fitting = fitting[[a not in filling for a in fitting.tolist()]] if filling else fitting
            if not len(fitting):
                break
            a = int(fitting[-1])
            filling[a] = min(int(left[a]), space // a)
            space -= a * filling[a]
        repeats = min(int(left[a]) // t for a, t in filling.items())
        out.append((repeats, filling))
        for a, t in filling.items():
            left[a] -= repeats * t
    return out


def _places(plan: list[tuple[int, dict[int, int]]]) -> tuple[dict[str, np.ndarray], int]:
    """For every length, which ranks go to which pattern; and the number of sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, filling in plan:
        offset = 0
        for length in sorted(filling, reverse=True):
            times = filling[length]
            low = used.get(length, 0)
            rows.append((length, low, times, sequence, offset))
            used[length] = low + repeats * times
            offset += times * length
        sequence += repeats
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {
        "key": (table[:, 0] << 48) | table[:, 1],
        "low": table[:, 1],
        "times": table[:, 2],
        "sequence": table[:, 3],
        "offset": table[:, 4],
    }, sequence


def pack(
    docs: DataFrame, path: str | None = None, end_id: int = END_ID, window: int = WINDOW_TOKENS
) -> DataFrame:
    """Pieces of all documents (doc_id, text; other columns are not read) and where they lie.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): each id of a document,
    ``end_id`` at its end included, lies in exactly one piece; a sequence holds at most ``window``
    ids, without gaps. Null and empty texts are the end id alone. Rows that repeat a doc_id are
    documents of their own. ``window`` is a power of two.

    Texts are read once, by the task that scans them, and leave it as lengths and check sums.
    Only the histogram of tails (at most half a window of counts) and the plan made from it
    pass the driver; a tail's rank among those of its length gives its place.
    """
    path = path or tokenizer_path()
    half = window // 2
    measured = written(measure(docs, path, end_id, window), "packing-lengths")
    counts = measured.groupBy("tail", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(half, dtype=np.int64)
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n")).collect():  # at most half a window
        histogram[r["tail"]] = r["n"]
    places, planned = _places(patterns(histogram, window))
    shared = docs.sparkSession.sparkContext.broadcast(places)
    upto = Window.partitionBy("tail").orderBy("part")
    starts = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(name) for name in batch.schema.names}
            sums = col["sums"].flatten().to_numpy(zero_copy_only=False)
            pieces = col["sums"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            size, tail, rank, single, part = (
                col[c].to_numpy(zero_copy_only=False).astype(np.int64)
                for c in ("doc_tokens", "tail", "rank", "single", "part")
            )
            doc = np.repeat(np.arange(batch.num_rows), pieces)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            is_tail = (nth == pieces[doc] - 1) & (tail[doc] > 0)
            full = size[doc] // window
            start = np.where(nth <= full, nth * window, full * window + half)
            length = np.where(is_tail, tail[doc], np.where(nth < full, window, half))
            sequence = planned + ((part[doc] + 1) << _SINGLES) + single[doc] + nth
            offset = np.zeros(len(doc), dtype=np.int64)
            at = doc[is_tail]
            if len(at):
                k = np.searchsorted(table["key"], (tail[at] << 48) | rank[at], side="right") - 1
                within = rank[at] - table["low"][k]
                sequence[is_tail] = table["sequence"][k] + within // table["times"][k]
                offset[is_tail] = table["offset"][k] + within % table["times"][k] * tail[at]
            arrays = [
                col["doc_id"].take(pa.array(doc)),
                *(pa.array(a) for a in (start, length, sums, size[doc], sequence, offset)),
            ]
            yield pa.RecordBatch.from_arrays(
                arrays,
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = measured.join(starts, ["tail", "part"]).select(
        "doc_id",
        "doc_tokens",
        "sums",
        "tail",
        (F.col("before") + F.col("rank")).alias("rank"),
        "single",
        "part",
    )
    return ranked.mapInArrow(
        place,
        "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, "
        "sequence_id BIGINT, offset BIGINT",
    )
