"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import among, over_texts, seeded_unit, written

UNKNOWN = "und"
# Documents of each language the network is fitted on, at most: those first in a seeded order.
TRAIN_DOCUMENTS = 400
TRAIN_BYTES = 2048  # of each of these, from a seeded place
WINDOW = 64
HIDDEN = 8
STEPS = 500
BATCH = 192
SEED = 9

_LETTER_BYTES = np.zeros(256, dtype=np.float32)
_LETTER_BYTES[ord("A") : ord("Z") + 1] = 1
_LETTER_BYTES[ord("a") : ord("z") + 1] = 1
_LETTER_BYTES[128:] = 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Gated recurrent units read a window's bytes in both directions; each position is labelled.

    For a direction: ``inputs`` (256 x 3H) holds each byte's part of the update gate, reset gate
    and candidate, ``gates`` (H x 2H) and ``candidate`` (H x H) the state's part.
    """

    languages: list[str]
    inputs: list[np.ndarray]
    gates: list[np.ndarray]
    candidate: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def random(cls, languages: list[str], hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(
            languages,
            [normal(256, 3 * hidden, scale=0.3) for _ in range(2)],
            [normal(hidden, 2 * hidden, scale=0.3) for _ in range(2)],
            [normal(hidden, hidden, scale=0.3) for _ in range(2)],
            normal(2 * hidden, len(languages), scale=0.3),
            np.zeros(len(languages), dtype=np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.gates, *self.candidate, self.out, self.bias]

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(T, n, 2H) states of ``windows`` (n, T) of bytes; ``keep`` gets what a step back needs."""
        n, length = windows.shape
        hidden = len(self.candidate[0])
        columns = np.ascontiguousarray(windows.T)
        found = np.empty((length, n, 2 * hidden), dtype=np.float32)
        for way in range(2):
            state = np.zeros((n, hidden), dtype=np.float32)
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                x = self.inputs[way][columns[t]]
                gate = _sigmoid(x[:, : 2 * hidden] + state @ self.gates[way])
                update, reset = gate[:, :hidden], gate[:, hidden:]
                new = np.tanh(x[:, 2 * hidden :] + (reset * state) @ self.candidate[way])
                following = state + update * (new - state)
                if keep is not None:
                    keep.append((way, t, state, update, reset, new))
                found[t, :, way * hidden : (way + 1) * hidden] = following
                state = following
        return found

    def label(self, windows: np.ndarray) -> np.ndarray:
        """(T, n, languages): probabilities at every position."""
        scores = self.states(windows) @ self.out + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over letter positions, by backpropagation through time."""
        n, length = windows.shape
        hidden = len(self.candidate[0])
        kept: list = []
        states = self.states(windows, kept)
        scores = states @ self.out + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        scores[:, np.arange(n), labels] -= 1
        weight = _LETTER_BYTES[windows.T][:, :, None]
        scores *= weight / max(1.0, float(weight.sum()))
        d_out = np.einsum("tnh,tnl->hl", states, scores)
        d_bias = scores.sum(axis=(0, 1))
        d_states = scores @ self.out.T
        d_inputs = [np.zeros_like(a) for a in self.inputs]
        d_gates = [np.zeros_like(a) for a in self.gates]
        d_candidate = [np.zeros_like(a) for a in self.candidate]
        carried = [np.zeros((n, hidden), dtype=np.float32) for _ in range(2)]
        for way, t, state, update, reset, new in reversed(kept):
            d = d_states[t, :, way * hidden : (way + 1) * hidden] + carried[way]
            d_new = d * update * (1 - new * new)
            d_update = d * (new - state) * update * (1 - update)
            through = d_new @ self.candidate[way].T
            d_reset = through * state * reset * (1 - reset)
            d_gate = np.concatenate([d_update, d_reset], axis=1)
            carried[way] = d * (1 - update) + through * reset + d_gate @ self.gates[way].T
            d_gates[way] += state.T @ d_gate
            d_candidate[way] += (reset * state).T @ d_new
            np.add.at(d_inputs[way], windows[:, t], np.concatenate([d_gate, d_new], axis=1))
        return [*d_inputs, *d_gates, *d_candidate, d_out, d_bias]


def fit(
    texts: list[bytes],
    labels: list[int],
    languages: list[str],
    hidden: int = HIDDEN,
    window: int = WINDOW,
    steps: int = STEPS,
    batch: int = BATCH,
    seed: int = SEED,
) -> Network:
    """A network fitted with Adam on windows of the texts; languages are drawn equally often."""
    network = Network.random(languages, hidden, seed)
    windows, owner = _windows(texts, window)
    if not len(windows):
        return network
    classes = np.asarray(labels)[owner]
    pools = [np.flatnonzero(classes == k) for k in range(len(languages))]
    pools = [p for p in pools if len(p)]
    rng = np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(p, max(1, batch // len(pools))) for p in pools])
        rate = 0.02 * (1 - step / (steps + 1))
        grads = network.gradients(windows[chosen], classes[chosen])
        for value, grad, (first, second) in zip(network.parameters(), grads, moments):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            value -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
    return network


def _windows(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts cut into windows of bytes (the last of each filled with zeros), and their texts' places."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    counts = -(-sizes // window)
    starts = np.cumsum(counts) - counts
    cells = np.zeros(int(counts.sum()) * window, dtype=np.uint8)
    for text, start in zip(texts, starts.tolist()):
        cells[start * window : start * window + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return cells.reshape(-1, window), np.repeat(np.arange(len(texts)), counts)


def pooled(network: Network, texts: list[bytes], window: int = WINDOW, most: int = 4096) -> np.ndarray:
    """(texts, languages): mean of the positions' probabilities over the letters of every whole text."""
    windows, owner = _windows(texts, window)
    total = np.zeros((len(texts), len(network.languages)))
    letters = np.zeros(len(texts))
    for start in range(0, len(windows), most):
        part, of = windows[start : start + most], owner[start : start + most]
        weight = _LETTER_BYTES[part]
        sums = np.einsum("tnl,nt->nl", network.label(part), weight)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        total[of[first]] += np.add.reduceat(sums, first, axis=0)
        letters[of[first]] += np.add.reduceat(weight.sum(axis=1), first)
    return total / np.maximum(letters, 1)[:, None]


def train(
    labelled: DataFrame,
    documents: int = TRAIN_DOCUMENTS,
    most_bytes: int = TRAIN_BYTES,
    hidden: int = HIDDEN,
    steps: int = STEPS,
    seed: int = SEED,
) -> Network:
    """A network fitted on (doc_id, text, lang): ``documents`` of each language, ``most_bytes`` of each.

    This bound is on fitting only. Rows without lang or text are not used. Few languages are
    assumed: the sample, and so the driver, holds ``documents * most_bytes`` for each.
    """
    lower = F.col("text").cast("binary")
    place = F.floor(
        seeded_unit(seed + 1, F.col("doc_id"))
        * F.greatest(F.lit(1), F.octet_length("text") - F.lit(most_bytes))
    )
    rank = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Network.random([], hidden, seed)
    # Only rows that may be among the first go to the ranking: a few times the sample, whatever the input.
    shares = [F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, 4 * documents / n))]
    sample = (
        usable.where(seeded_unit(seed, F.col("doc_id")) < F.create_map(*shares)[F.col("lang")])
        .withColumn("text", F.substring(lower, (place + 1).cast("int"), F.lit(most_bytes)))
        .withColumn("u", seeded_unit(seed, F.col("doc_id")))
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= documents)
        .select("lang", "text", "u", "doc_id")
        .orderBy("lang", "u", "doc_id", "text")
        .collect()
    )
    languages = sorted({r["lang"] for r in sample})
    return fit(
        [bytes(r["text"]) for r in sample],
        [languages.index(r["lang"]) for r in sample],
        languages,
        hidden=hidden,
        steps=steps,
        seed=seed,
    )


def predict(
    docs: DataFrame, network: Network, keep: tuple[str, ...] = ("doc_id",), window: int = WINDOW
) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, for every row of ``docs``; only its text decides.

    Every whole text is labelled position by position and the positions' probabilities are
    averaged over its letters; ``score`` is the predicted language's average. A text that is null
    or has no letter is ``und`` with score 0, and so is all text if no language was learned.
    Copies get equal results. An empty table gives an empty result.
    """
    known = network  # a few tens of kilobytes, sent with the function
    columns = list(dict.fromkeys([*keep, "text"]))

    def work(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*known.languages, UNKNOWN], dtype=object)
        for block in blocks:
            texts = block.column("text").to_pylist()
            lettered = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)
            lettered &= bool(known.languages)
            best = np.full(len(texts), len(known.languages))
            score = np.zeros(len(texts))
            if lettered.any():
                chosen = np.flatnonzero(lettered)
                found = pooled(
                    known, [texts[i].encode("utf-8", "surrogatepass") for i in chosen], window
                )
                best[chosen] = found.argmax(axis=1)
                score[chosen] = found.max(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(block.column(c) for c in keep),
                    pa.array(names[best].tolist(), pa.string()),
                    pa.array(np.clip(score, 0, 1)),
                ],
                [*keep, "lang_pred", "score"],
            )

    fields = "".join(f"`{c}` {kind}, " for c, kind in docs.select(*keep).dtypes)
    return over_texts(
        docs, [F.col(c) for c in columns], work, f"{fields}lang_pred STRING, score DOUBLE"
    )


def _least(found: DataFrame) -> float | None:
    """The least score of a labelled row with letters of ``found`` (lang, lang_pred, score); none if nothing was learned."""
    least, rows = found.where(F.col("lang").isNotNull() & (F.col("lang_pred") != UNKNOWN)).agg(
        F.min("score"), F.count(F.lit(1))
    ).first()
    return least if rows else None


def told(found: DataFrame) -> DataFrame:
    """Rows of ``found`` (text, lang, lang_pred, score) whose language can be told.

    The least score of a labelled row with letters is the limit: rows below it go, and so do rows whose text is null or
    has no letter. If nothing was learned (no labelled row), all rows with letters stay.
    """
    least = _least(found)
    if least is None:
        return found.where(F.col("text").rlike(r"\p{L}"))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))


def keep_told(docs: DataFrame, network: Network) -> DataFrame:
    """The rows of ``docs`` (text, lang and other columns) whose language can be told.

    The least score of a labelled row whose language the network finds is the limit; a label that it does not find sets
    none, so labelled rows below the limit go too. Text that is null or has no letter goes. If the network finds no
    row's language, all rows with letters stay.

    Predictions are written without their texts, by 128 bits of the texts' hashes. Scores of copies may differ in their
    last digits, so the highest decides for all of them. What goes is filtered from ``docs`` in place if it is little.
    """
    text_key = [F.xxhash64("text").alias("of"), F.xxhash64(F.lit(9), F.col("text")).alias("of2")]
    found = written(predict(docs.select("text", "lang", *text_key), network, keep=("lang", "of", "of2")), "language-told")
    least = _least(found.where("lang = lang_pred"))
    if least is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    score = F.max(F.when(F.col("lang_pred") != UNKNOWN, F.col("score")))
    gone = found.groupBy("of", "of2").agg(score.alias("score")).where((F.col("score") < least) | F.isnull("score"))
    gone = written(gone.select("of", "of2"), "language-gone")
    return among(docs.select("*", *text_key), gone, "left_anti").select(docs.columns)
