"""Timed episodes: an opening row starts an interval, the next one opens after it has run out.

Three jobs share the shape: repeated login failures (2 s from the first failure), continuous
rises (10 s from the first rise) and click limits that reset 24 h after the first click. Which
row opens an episode depends on the previous opening, so a key is walked in order. A hot key is
walked chunk by chunk: each chunk is first reduced to a step function from the episode running
before it to the one running after it. These small functions are composed pairwise, each with the one 1, 2, 4, …
chunks before it, so that after as many rounds as the number of chunks has binary digits each tells what is running
at its end; no task sees all chunks of a key. Then every chunk is walked on its own from its known starting point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.operators.ordered import CHUNK, OrderedRows, written

_NONE = int(np.iinfo(np.int64).min)


def _last_openings(at: np.ndarray, window: int) -> np.ndarray:
    """For each position, the last opening reached when it is itself an opening."""
    following = np.searchsorted(at, at + window, side="right")
    last = np.arange(len(at))
    for i in range(len(at) - 1, -1, -1):
        if following[i] < len(at):
            last[i] = last[following[i]]
    return at[last]


def _summarise(keys: list[str], window: int) -> Callable:
    def chunk_step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n", kind="stable")
        opens = pdf["__opens"].to_numpy()
        resets = np.flatnonzero(~opens)
        at = pdf["__at"].to_numpy()
        tail = at[resets[-1] + 1 :] if len(resets) else at
        last = _last_openings(tail, window)
        entries, exits = np.array([], np.int64), np.array([], np.int64)
        if not len(resets):
            reach = int(np.searchsorted(at, at[0] + window, side="right")) + 1
            # keep the largest position of every run with the same result
            head, result = at[:reach], last[:reach]
            ends = np.append(result[1:] != result[:-1], True)
            entries, exits = head[ends], result[ends]
        row = {k: [pdf[k].iloc[0]] for k in keys}
        row |= {
            CHUNK: [pdf[CHUNK].iloc[0]],
            "__first": [at[0]],
            "__has_reset": [bool(len(resets))],
            "__fresh": [last[0] if len(last) else _NONE],
            "__entries": [entries],
            "__exits": [exits],
        }
        return pd.DataFrame(row)

    return chunk_step


def _applied(running: np.ndarray, step: tuple, window: int) -> np.ndarray:
    """What runs after a chunk, for each episode that may run before it."""
    _, has_reset, fresh, entries, exits = step
    if has_reset:
        return np.full(len(running), fresh)
    after = running.copy()
    if len(exits):
        i = np.searchsorted(entries, running + window, side="right")
        after = np.where(i < len(exits), exits[np.minimum(i, len(exits) - 1)], running)
    return np.where(running == _NONE, fresh, after)


def composed(earlier: tuple, later: tuple, window: int) -> tuple:
    """One step function for two neighbouring stretches; each is (first time, has a reset, fresh, entries, exits).

    An episode that runs before both can end at most one interval after their first time, so what
    is kept are the openings up to there: a composition is no larger than its parts.
    """
    first, has_reset, fresh, entries, exits = earlier
    (fresh,) = _applied(np.array([fresh]), later, window)
    if has_reset or later[1]:
        return first, True, fresh, entries[:0], exits[:0]
    entries = np.concatenate([entries, later[3]])
    exits = np.concatenate([_applied(exits, later, window), later[4]])
    reach = int(np.searchsorted(entries, first + window, side="right")) + 1
    entries, exits = entries[:reach], exits[:reach]
    ends = np.append(exits[1:] != exits[:-1], True)[: len(exits)]
    return first, False, fresh, entries[ends], exits[ends]


_STEP = ("__first", "__has_reset", "__fresh", "__entries", "__exits")
_STEP_DDL = "__first bigint, __has_reset boolean, __fresh bigint, __entries array<bigint>, __exits array<bigint>"


def _running_at_ends(steps: DataFrame, keys: list[str], window: int) -> DataFrame:
    """``steps`` (keys, chunk, __place from 0, step functions) with ``__fresh``: what runs at the end of each chunk."""
    types = dict(steps.dtypes)
    whole = [*keys, CHUNK, "__place"]
    ddl = ", ".join(f"`{c}` {types[c]}" for c in whole)

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *own, before in zip(*(pdf[c] for c in _STEP), pdf["__before"]):
                later = tuple(own)
                out.append(later if before is None else composed(_as_step(before), later, window))
            for c, values in zip(_STEP, zip(*out)):
                pdf[c] = values
            yield pdf.drop(columns="__before")

    chunks = steps.agg(F.max("__place")).first()[0] or 0
    distance = 1
    while distance <= chunks:
        before = steps.select(
            *[F.col(k).alias(f"__b_{k}") for k in keys],
            (F.col("__place") + distance).alias("__b_place"),
            F.struct(*_STEP).alias("__before"),
        )
        match = F.col("__place") == F.col("__b_place")
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"__b_{k}"))
        joined = steps.join(before, match, "left").select(*whole, *_STEP, "__before")
        steps = written(joined.mapInPandas(compose, f"{ddl}, {_STEP_DDL}"), "chunk-steps")
        distance *= 2
    return steps


def _as_step(row: dict) -> tuple:
    values = row if isinstance(row, dict) else row.asDict()
    return tuple(np.asarray(values[c], np.int64) if c in ("__entries", "__exits") else values[c] for c in _STEP)


def _walk(window: int) -> Callable:
    def partition_walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The running episode outlives a batch: a group may span several.
        running = _NONE
        for pdf in batches:
            episodes = []
            for n, at, opens, entry in zip(
                pdf["__n"].tolist(),
                pdf["__at"].tolist(),
                pdf["__opens"].tolist(),
                pdf["__entry"].tolist(),
                strict=True,
            ):
                if n == 1:
                    running = entry
                over = running == _NONE or at > running + window
                if opens:
                    running = at if over else running
                    episodes.append(running)
                else:
                    episodes.append(_NONE if over else running)
                    running = _NONE
            out = pdf.drop(columns=["__n", "__entry"])
            out["__episode"] = np.array(episodes, dtype=np.int64)
            yield out

    return partition_walk


def assign_episodes(rows: OrderedRows, window_us: int) -> OrderedRows:
    """Add ``__episode``, the time at which the episode a row belongs to was opened.

    The rows carry ``__at`` in microseconds and ``__opens``. A row that does not open is a reset:
    it ends any running episode and belongs to the one it cuts short; if there is none
    ``__episode`` is NULL.
    """
    types = dict(rows.df.dtypes)
    # The window clusters and sorts the rows and numbers them within a chunk; the broadcast
    # join and the walk keep that order within the task.
    numbered = rows.df.withColumn("__n", F.row_number().over(rows.window))
    if rows.cut:
        key_ddl = ", ".join(f"`{k}` {types[k]}" for k in rows.partition)
        steps = (
            numbered.where(F.col(CHUNK).isNotNull())
            .select(*rows.partition, "__n", "__at", "__opens")
            .groupBy(*rows.partition)
            .applyInPandas(_summarise(rows.keys, window_us), f"{key_ddl}, {_STEP_DDL}")
        )
        place = F.row_number().over(Window.partitionBy(*rows.keys).orderBy(CHUNK)) - 1
        steps = written(steps.withColumn("__place", place), "chunk-steps")
        ends = _running_at_ends(steps, rows.keys, window_us)
        # What runs at the end of a chunk runs at the start of the next.
        starts = F.lag("__fresh").over(Window.partitionBy(*rows.keys).orderBy("__place"))
        entries = written(ends.select(*rows.chunk_keys(), starts.alias("__entry")), "chunk-entries")
        entry = F.coalesce("__entry", F.lit(_NONE)).alias("__entry")
        prepared = rows.join_chunks(entries, numbered).select(*rows.df.columns, "__n", entry)
    else:
        prepared = numbered.withColumn("__entry", F.lit(_NONE))
    row_ddl = ", ".join(f"`{c}` {types[c]}" for c in rows.df.columns)
    walked = prepared.mapInPandas(_walk(window_us), f"{row_ddl}, __episode bigint")
    return rows.map(lambda _: walked.withColumn("__episode", F.nullif("__episode", F.lit(_NONE))))


def finished_episodes(
    rows: OrderedRows, opens: Column, resets: Column, window_us: int
) -> DataFrame:
    """Episodes that ran their full interval: (keys, ``opened_at``, ``last_at``, ``rows``).

    A row satisfying ``opens`` starts an episode unless one is running; later such rows within
    the interval, its end included, belong to it. A row satisfying ``resets`` within the
    interval, its end included, cancels it. Times are event times; the leading order column is a
    timestamp.
    """
    order = [o for o in rows.order if o not in rows.keys]
    marked = rows.map(
        lambda df: df.select(
            *rows.partition,
            *order,
            F.unix_micros(F.col(rows.order[0]).cast("timestamp")).alias("__at"),
            opens.alias("__opens"),
            resets.alias("__resets"),
        )
    )
    # Only the first of several resets in a row can end an episode. At the start of a chunk the
    # row before is unknown, and a reset there is kept.
    after_open = F.coalesce(F.lag("__opens").over(marked.window), F.lit(True))
    relevant = marked.map(
        lambda df: df.withColumn("__after_open", after_open)
        .where(F.col("__opens") | (F.col("__resets") & F.col("__after_open")))
        .drop("__resets", "__after_open")
    )
    return (
        assign_episodes(relevant, window_us)
        .df.where(F.col("__episode").isNotNull())
        .groupBy(*rows.keys, "__episode")
        .agg(
            F.max("__at").alias("__last"),
            F.count(F.lit(1)).alias("rows"),
            F.every("__opens").alias("__unbroken"),
        )
        .where("__unbroken")
        .select(
            *rows.keys,
            F.timestamp_micros("__episode").alias("opened_at"),
            F.timestamp_micros("__last").alias("last_at"),
            "rows",
        )
    )
