"""Keyed state on streams: one processor per operator that windows and joins cannot express.

Rows come as Arrow batches and are handled as columns, in arrival order (``seq``) or event-time
order (``at``, epoch micros). In arrival order the keys are dealt to buckets by hash: the rows of a bucket are handled
together, and the state of its keys is read and written once for each micro-batch. In event-time order that holds
for each key. State per key is a few values, the last few values, or the rows the watermark has not passed yet. A
micro-batch hands one key's rows to one task, so the trigger's batch size
(``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) bounds a hot key (some 24 bytes a row); the batch operators cut hot
keys into chunks instead.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Columns = dict[str, Any]

BUCKETS = 256  # of keys with one state; has to stay as it is while a checkpoint is in use
MOST_KEYS = 4  # columns of a key; their null bits come first
WHOLE_COLUMNS = ("seq", "at")
WHOLE_TYPES = ("tinyint", "smallint", "int", "bigint")


class _Groups:
    """Where each key's rows lie in sorted columns, and what is held of the keys (arrays, one entry a key)."""

    def __init__(self, starts: np.ndarray, n: int, known: np.ndarray, held: Columns):
        self.starts, self.known, self.held = starts, known, held
        self.sizes = np.diff(np.append(starts, n))
        self.ends = starts + self.sizes
        self.of = np.repeat(np.arange(len(starts)), self.sizes)
        self.rows = np.arange(n)
        self.place = self.rows - starts[self.of]


def _packed(columns: Columns) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({c: pa.array(v) for c, v in columns.items()})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> Columns:
    table = pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()
    return {c: table.column(c).to_numpy() for c in table.column_names}


def _codes(parts: list[np.ndarray]) -> np.ndarray:
    """Numbers of the distinct rows of some columns, in order of appearance."""
    codes = np.zeros(len(parts[0]), dtype=np.int64)
    for part in parts:
        found, names = pd.factorize(part, use_na_sentinel=False)
        codes = pd.factorize(codes * len(names) + found)[0]
    return codes


def _whole(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as such, 0 for null, and where they are null; pandas has them as doubles beside nulls."""
    if values.dtype.kind in "iu":
        return values, np.zeros(len(values), dtype=bool)
    null = np.asarray(pd.isna(values))
    return np.where(null, 0, values).astype(np.int64), null


def _with_nulls(values: np.ndarray, null: np.ndarray) -> Any:
    """Whole numbers or strings for output, null where ``null`` says so."""
    if not null.any():
        return values
    if values.dtype.kind in "iu":
        return pd.arrays.IntegerArray(values, null)
    return np.where(null, None, values)


class _InArrivalOrder(StatefulProcessor):
    """Handles the rows of a bucket of keys as columns sorted by key and ``seq``.

    All keys of a bucket have one state, a table of a row a key, read and written once a micro-batch. Rows
    bring their keys in the columns ``bucket_key0``, ``bucket_key1`` …; without these the group is one key.
    """

    columns = ("seq", "value")
    names = ("key",)  # the key's columns in the output
    inner = ()  # columns that are part of the key of the state only
    state: dict[str, Any] = {}  # what is held of a key, with the value of a key not met yet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.store = handle.getValueState("held", "data binary")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        frame = pd.concat(frames, ignore_index=True) if len(frames) > 1 else frames[0]
        outer = [c for c in frame.columns if c.startswith("bucket_key")]
        nulls = frame["null_bits"].to_numpy() if "null_bits" in frame.columns else np.zeros(len(frame), dtype=np.int64)
        arrays: Columns = {c: frame[c].to_numpy() for c in (*self.columns, *outer)}
        missing = {c: nulls >> i & 1 == 1 for i, c in enumerate(outer)}
        for i, c in enumerate(WHOLE_COLUMNS, MOST_KEYS):
            if c in arrays:
                arrays[c], null = _whole(arrays[c])
                missing[c] = null | (nulls >> i & 1 == 1)
        # Keys are told apart by their values and by which of them are null.
        parts = {c: arrays[c] for c in (*outer, *self.inner)}
        parts["null_bits"] = nulls & ((1 << len(outer)) - 1)
        held = self._held(timerValues)
        before = len(held["null_bits"]) if held else 0
        codes = _codes([np.concatenate([held[c], v]) if before else v for c, v in parts.items()])[before:]

        order = np.lexsort((arrays["seq"], missing["seq"], codes))
        codes = codes[order]
        arrays = {c: v[order] for c, v in arrays.items()}
        missing = {c: v[order] for c, v in missing.items()}
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        met = codes[starts]
        known = met < before
        groups = _Groups(starts, len(codes), known, {})
        for c, first in self.state.items():
            values = np.full(len(met), first)
            if before:
                values[known] = held[c][met[known]]
            groups.held[c] = values
        found, after = self.on_groups(groups, missing, *(arrays[c] for c in self.columns))

        fresh = order[starts[~known]]
        kept = {c: np.concatenate([held[c], v[fresh]]) if before else v[fresh] for c, v in parts.items()}
        for c, first in self.state.items():
            kept[c] = np.concatenate([held[c] if before else [], np.full(len(fresh), first)]).astype(after[c].dtype)
            kept[c][met] = after[c]
        self._keep(kept, timerValues)
        if found is not None:
            at = found.pop("rows")
            for i, name in enumerate(self.names):
                one = key[i] if not outer else None
                found[name] = [one] * len(at) if not outer else _with_nulls(arrays[outer[i]][at], missing[outer[i]][at])
            found["seq"] = _with_nulls(arrays["seq"][at], missing["seq"][at])
            rest = [c for c in found if c not in (*self.names, "seq")]
            yield pd.DataFrame({c: found[c] for c in (*self.names, "seq", *rest)})

    def _held(self, timerValues: Any) -> Columns | None:
        return _unpacked(self.store.get()[0]) if self.store.exists() else None

    def _keep(self, held: Columns, timerValues: Any) -> None:
        if len(held["null_bits"]):
            self.store.update((_packed(held),))
        else:
            self.store.clear()

    def on_groups(
        self, groups: _Groups, missing: Columns, *arrays: np.ndarray
    ) -> tuple[Columns | None, Columns]:
        """Output columns with ``rows``, the row each comes from, and what is held of every key afterwards."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class JumpAlert(_InArrivalOrder):
    """(key, seq, last, now) where consecutive values differ by at least the threshold; null differs by nothing."""

    state = {"last": np.nan}

    def __init__(self, threshold: float):
        self.threshold = threshold

    def on_groups(self, groups, missing, seq, value):
        value = value.astype(np.float64)
        before = np.append(np.nan, value[:-1])
        before[groups.starts] = groups.held["last"]
        far = np.flatnonzero(np.abs(before - value) >= self.threshold)
        found = {"rows": far, "last": before[far], "now": value[far]} if len(far) else None
        return found, {"last": value[groups.ends - 1]}


class RunningCount(_InArrivalOrder):
    """(key, seq, running_count)."""

    columns = ("seq",)
    state = {"n": 0}

    def on_groups(self, groups, missing, seq):
        n = groups.held["n"]
        return {"rows": groups.rows, "running_count": n[groups.of] + groups.place + 1}, {"n": n + groups.sizes}


class RollingReduce(_InArrivalOrder):
    """(key, seq, at, value): a user function folds each row into the (at, value) so far."""

    columns = ("seq", "at", "value")
    state = {"at": 0, "at_null": False, "value": np.nan}

    def __init__(self, reduce: Callable[[tuple, tuple], tuple]):
        self.reduce = reduce

    def on_groups(self, groups, missing, seq, at, value):
        # A null comes to the function as not a number.
        new = list(zip(_or_nan(at, missing["at"]), value.tolist()))
        before = list(zip(_or_nan(groups.held["at"], groups.held["at_null"]), groups.held["value"].tolist()))
        out = []
        for g, known in enumerate(groups.known.tolist()):
            so_far = before[g] if known else None
            for row in new[groups.starts[g] : groups.ends[g]]:
                so_far = row if so_far is None else self.reduce(so_far, row)
                out.append(so_far)
        ats, values = zip(*out)
        ats, null = _whole(np.array(ats))
        values = np.array(values, dtype=np.float64)
        ends = groups.ends - 1
        found = {"rows": groups.rows, "at": _with_nulls(ats, null), "value": values}
        return found, {"at": ats[ends], "at_null": null[ends], "value": values[ends]}


def _or_nan(whole: np.ndarray, null: np.ndarray) -> list:
    found = whole.tolist()
    for i in np.flatnonzero(null):
        found[i] = float("nan")
    return found


class Changelog(_InArrivalOrder):
    """(key, seq, op, count, sum): ``-`` the previous aggregate, then ``+`` the new one."""

    state = {"n": 0, "total": 0.0}

    def on_groups(self, groups, missing, seq, value):
        value = value.astype(np.float64)
        count = groups.held["n"][groups.of] + groups.place + 1
        total = np.empty(len(value))
        # Every key is added up by itself, so that neither rounding nor nulls pass from one to the next.
        for start, end, so_far in zip(groups.starts.tolist(), groups.ends.tolist(), groups.held["total"].tolist()):
            total[start:end] = value[start:end]
            total[start] += so_far
            np.cumsum(total[start:end], out=total[start:end])
        last = np.append(0.0, total[:-1])
        last[groups.starts] = groups.held["total"]
        # Each row takes back the aggregate before it, if there was one, and gives the one after it.
        each = np.repeat(groups.rows, 2)
        adds = np.tile([0, 1], len(value))
        keep = (adds == 1) | (count[each] > 1)
        each, adds = each[keep], adds[keep]
        found = {
            "rows": each,
            "op": np.where(adds == 1, "+", "-"),
            "count": count[each] - 1 + adds,
            "sum": np.where(adds == 1, total[each], last[each]),
        }
        return found, {"n": count[groups.ends - 1], "total": total[groups.ends - 1]}


class _RecentRows(_InArrivalOrder):
    """Keeps the last values of a key, one less than ``size``, and the number of rows seen."""

    size: int

    @property
    def state(self) -> dict[str, Any]:
        return {"n": 0} | {f"recent{i}": 0.0 for i in range(self.size - 1)}

    def framed(
        self, groups: _Groups, value: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, Columns]:
        """(number of the row, rows in the frame, their mean) for each new value, and what is held then."""
        lead = self.size - 1
        # The values held of a key stand before its new ones; 0 where there were fewer.
        values = np.empty(len(value) + lead * len(groups.starts))
        at = groups.rows + lead * (groups.of + 1)
        values[at] = value.astype(np.float64)
        first = groups.starts + lead * np.arange(len(groups.starts))
        for i in range(lead):
            values[first + i] = groups.held[f"recent{i}"]
        sums = np.lib.stride_tricks.sliding_window_view(values, self.size).sum(axis=1)[at - lead]
        n = groups.held["n"][groups.of] + groups.place + 1
        last = at[groups.ends - 1]
        after = {"n": n[groups.ends - 1]} | {f"recent{i}": values[last - lead + 1 + i] for i in range(lead)}
        held = np.minimum(n, self.size)
        return n, held, sums / held, after


class CountWindowAvg(_RecentRows):
    """(key, seq, n, avg): mean of the last ``size`` rows at every ``slide``-th row."""

    def __init__(self, size: int = 10, slide: int = 2):
        self.size, self.slide = size, slide

    def on_groups(self, groups, missing, seq, value):
        n, _, avg, after = self.framed(groups, value)
        fires = np.flatnonzero(n % self.slide == 0)
        return {"rows": fires, "n": n[fires], "avg": avg[fires]} if len(fires) else None, after


class OverRows(_RecentRows):
    """(key, seq, count, avg) over the current row and ``preceding`` rows before it."""

    def __init__(self, preceding: int = 2):
        self.size = preceding + 1

    def on_groups(self, groups, missing, seq, value):
        _, held, avg, after = self.framed(groups, value)
        return {"rows": groups.rows, "count": held, "avg": avg}, after


class ClickLimit(_InArrivalOrder):
    """(user, ad, seq, kind): ``pass`` for the first clicks, ``warn`` once, the rest dropped.

    Counting restarts on a new UTC day, or 24 h after the first counted click. With ``expires``
    (event time) pairs that are not clicked again are cleared at that point: when the bucket gets rows,
    and by the bucket's timer, which waits for the earliest of its pairs.
    """

    DAY_US = 86_400_000_000
    columns = ("seq", "at")
    names = ("user", "ad")
    state = {"first": 0, "n": 0}

    def __init__(self, limit: int = 100, reset: str = "calendar_day", expires: bool = False):
        if reset not in ("calendar_day", "rolling_24h"):
            raise ValueError(f"unknown reset {reset!r}")
        self.limit, self.reset, self.expires = limit, reset, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        if self.expires:
            self.wake = handle.getValueState("wake", "at_ms bigint")

    def _end_ms(self, first: np.ndarray) -> np.ndarray:
        """The first millisecond at which counting has restarted."""
        if self.reset == "calendar_day":
            return (first // self.DAY_US + 1) * self.DAY_US // 1000
        return (first + self.DAY_US) // 1000 + 1

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        self.wake.clear()
        held = self._held(timerValues)
        if held:
            self._keep(held, timerValues)
        return iter(())

    def _keep(self, held: Columns, timerValues: Any) -> None:
        if self.expires:
            ends = self._end_ms(held["first"])
            open_ = ends > timerValues.getCurrentWatermarkInMs()
            held, ends = {c: v[open_] for c, v in held.items()}, ends[open_]
            if len(ends):
                self._wake_by(int(ends.min()))
        super()._keep(held, timerValues)

    def _wake_by(self, at_ms: int) -> None:
        if self.wake.exists():
            pending = self.wake.get()[0]
            if pending <= at_ms:
                return
            self.handle.deleteTimer(pending)
        self.handle.registerTimer(at_ms)
        self.wake.update((at_ms,))

    def _restarts(self, groups: _Groups, at: np.ndarray) -> np.ndarray:
        """For each row whether counting restarts there."""
        first = groups.held["first"].copy()
        if self.reset == "calendar_day":
            days = at // self.DAY_US
            before = np.append(0, days[:-1])
            before[groups.starts] = first // self.DAY_US
            restarts = days != before
            restarts[groups.starts[~groups.known]] = True
            return restarts
        restarts = np.zeros(len(at), dtype=bool)
        restarts[groups.starts[~groups.known]] = True
        first[~groups.known] = at[groups.starts[~groups.known]]
        rows = groups.rows[~restarts]
        # Each round finds the next restart of every key that has one.
        while True:
            hits = rows[at[rows] > first[groups.of[rows]] + self.DAY_US]
            if not len(hits):
                return restarts
            again, earliest = np.unique(groups.of[hits], return_index=True)
            found = hits[earliest]
            restarts[found] = True
            first[again] = at[found]
            reached = np.full(len(first), len(at))
            reached[again] = found
            rows = rows[rows > reached[groups.of[rows]]]

    def on_groups(self, groups, missing, seq, at):
        restarts = self._restarts(groups, at)
        since = np.maximum.accumulate(np.where(restarts, groups.rows, -1))
        restarted = since >= groups.starts[groups.of]
        # How many clicks of its count come before a row.
        before = np.where(restarted, groups.rows - since, groups.held["n"][groups.of] + groups.place)
        last = groups.ends - 1
        first = np.where(restarted[last], at[since[last]], groups.held["first"])
        after = {"first": first, "n": np.minimum(before[last] + 1, self.limit + 1)}
        told = np.flatnonzero(before <= self.limit)
        if not len(told):
            return None, after
        return {"rows": told, "kind": np.where(before[told] < self.limit, "pass", "warn")}, after


class CountsByCategory(_InArrivalOrder):
    """(key, seq, category, count): how often the key has met the row's category.

    With ``ttl_ms`` (processing time) entries not touched for so long are forgotten.
    """

    columns = ("seq", "category")
    inner = ("category",)
    state = {"n": 0, "touched_ms": 0}

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def _held(self, timerValues: Any) -> Columns | None:
        held = super()._held(timerValues)
        self.now = 0 if self.ttl_ms is None else timerValues.getCurrentProcessingTimeInMs()
        if held and self.ttl_ms is not None:
            fresh = held["touched_ms"] + self.ttl_ms > self.now
            held = {c: v[fresh] for c, v in held.items()}
        return held

    def on_groups(self, groups, missing, seq, category):
        n = groups.held["n"]
        rows = np.lexsort((seq, missing["seq"]))
        count = n[groups.of] + groups.place + 1
        after = {"n": n + groups.sizes, "touched_ms": np.full(len(n), self.now)}
        return {"rows": rows, "category": category[rows], "count": count[rows]}, after


class KeyTimer(StatefulProcessor):
    """(key, kind, value): the key's length per row, and a row when the timer runs out.

    A processing-time timer is set ``delay_ms`` after each row that finds none running.
    """

    def __init__(self, delay_ms: int = 5000):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at_ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for _ in rows:
            yield Row(key=key[0], kind="length", value=len(str(key[0])))
            if not self.timer.exists():
                at = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms
                self.handle.registerTimer(at)
                self.timer.update((at,))

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[Row]:
        self.timer.clear()
        yield Row(
            key=key[0], kind="timer", value=expiredTimerInfo.getExpiryTimeInMs()
        )

    def close(self) -> None:
        pass


class _InEventOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then handles them in time order.

    Subclasses keep at most one running interval (``opened``, ``n``, ``last`` in micros).
    """

    def __init__(self, interval_us: int):
        self.interval_us = interval_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, seq bigint, value double")
        self.running = handle.getValueState("running", "opened bigint, last bigint, n bigint")
        self.last = handle.getValueState("last", "value double")
        self.wake = handle.getValueState("wake", "at_ms bigint")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            at = batch["at"].to_numpy()
            self.waiting.appendList(
                list(zip(at.tolist(), batch["seq"].tolist(), batch["value"].astype("float64").tolist()))
            )
            least = int(at.min())
            earliest = least if earliest is None else min(earliest, least)
        if earliest is not None:
            self._wake_by(earliest)
        return iter(())

    def _wake_by(self, at_us: int) -> None:
        """One timer at most is pending: the earliest time anything can be decided."""
        at_ms = -(-at_us // 1000)
        if self.wake.exists():
            pending = self.wake.get()[0]
            if pending <= at_ms:
                return
            self.handle.deleteTimer(pending)
        self.handle.registerTimer(at_ms)
        self.wake.update((at_ms,))

    def handleExpiredTimer(
        self, key: Any, timerValues: Any, expiredTimerInfo: Any
    ) -> Iterator[pd.DataFrame]:
        self.wake.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] <= passed]
        later = rows[len(ready) :]
        out = []
        running = tuple(self.running.get()) if self.running.exists() else None
        last = self.last.get()[0] if self.last.exists() else None
        for at, _, value in ready:
            if running and at > running[0] + self.interval_us:
                out += self.finished(key, *running)
                running = None
            running = self.step(running, last, at, value)
            last = value
        if running and running[0] + self.interval_us <= passed:
            out += self.finished(key, *running)
            running = None
        self._store(later, running, last)
        return iter([pd.DataFrame(out)] if out else [])

    def _store(self, later: list[tuple], running: tuple | None, last: float | None) -> None:
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        if running:
            self.running.update(running)
        else:
            self.running.clear()
        if last is not None:
            self.last.update((last,))
        times = [later[0][0]] if later else []
        if running:
            times.append(running[0] + self.interval_us)
        if times:
            self._wake_by(min(times))

    def step(
        self, running: tuple | None, last: float | None, at: int, value: float
    ) -> tuple | None:
        raise NotImplementedError

    def finished(self, key: Any, opened: int, last: int, n: int) -> list[Columns]:
        raise NotImplementedError

    def close(self) -> None:
        pass


class RiseAlert(_InEventOrder):
    """(key, rise_start, alert_time) in epoch micros."""

    def step(self, running, last, at, value):
        if last is None:
            return running
        if value > last:
            return running or (at, at, 1)
        return None

    def finished(self, key, opened, last, n):
        return [{"key": key[0], "rise_start": opened, "alert_time": opened + self.interval_us}]


class RepeatedFailures(_InEventOrder):
    """(key, first_fail, last_fail, fail_times) in epoch micros; ``value`` is 1 for a failure."""

    def __init__(self, interval_us: int, min_failures: int = 2):
        super().__init__(interval_us)
        self.min_failures = min_failures

    def step(self, running, last, at, value):
        if value != 1.0:
            return None
        if running:
            return (running[0], at, running[2] + 1)
        return (at, at, 1)

    def finished(self, key, opened, last, n):
        if n < self.min_failures:
            return []
        return [{"key": key[0], "first_fail": opened, "last_fail": last, "fail_times": n}]


def _transform(
    df: DataFrame,
    keys: list[str],
    processor: StatefulProcessor,
    schema: str,
    time_mode: str = "None",
) -> DataFrame:
    if isinstance(processor, _InArrivalOrder):
        df, keys = _bucketed(df, keys, processor)
    grouped = df.groupBy(*keys)
    # The timer's processor is the one that goes by rows.
    run = grouped.transformWithState if isinstance(processor, KeyTimer) else grouped.transformWithStateInPandas
    return run(
        statefulProcessor=processor,
        outputStructType=schema,
        outputMode="append",
        timeMode=time_mode,
    )


def _bucketed(df: DataFrame, keys: list[str], processor: _InArrivalOrder) -> tuple[DataFrame, list[str]]:
    """Rows with the bucket of their key, and what to group by.

    Whole numbers and strings are bucketed by hash, null being a key of its own. Keys of other types, which
    may change on their way through pandas, are groups by themselves.
    """
    kinds = dict(df.dtypes)
    if len(keys) > MOST_KEYS or any(kinds[k] not in (*WHOLE_TYPES, "string") for k in keys):
        return df, keys
    # Whole columns come without nulls, which would make doubles of them; bits tell where they were.
    bits = dict(enumerate(keys)) | {i: c for i, c in enumerate(WHOLE_COLUMNS, MOST_KEYS) if c in df.columns}
    nulls = [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in bits.items()]

    def filled(c: str) -> Column:
        empty = F.lit("") if kinds[c] == "string" else F.lit(0).cast(kinds[c])
        return F.coalesce(F.col(c), empty)

    # Every value is handed to Python by itself, so that times are left out that no watermark needs.
    watermarks = [f.name for f in df.schema if "spark.watermarkDelayMs" in (f.metadata or {})]
    rest = [c for c in (*processor.columns, *watermarks) if c not in WHOLE_COLUMNS]
    rows = df.select(
        F.pmod(F.hash(*keys), F.lit(BUCKETS)).alias("bucket"),
        *(filled(k).alias(f"bucket_key{i}") for i, k in enumerate(keys)),
        *(filled(c).alias(c) for c in WHOLE_COLUMNS if c in df.columns),
        *rest,
        reduce(operator.add, nulls).alias("null_bits"),
    )
    return rows, ["bucket"]


def _keyed(df: DataFrame, key: str, value: str, ts: str = "event_time") -> DataFrame:
    return df.select(
        key, "seq", ts, F.unix_micros(ts).alias("at"), F.col(value).cast("double").alias("value")
    )


def jump_alert_stream(df: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    kind = dict(df.dtypes)[key]
    return _transform(
        _keyed(df, key, value),
        [key],
        JumpAlert(threshold),
        f"key {kind}, seq bigint, last double, now double",
    ).withColumnRenamed("key", key)


def running_count_stream(df: DataFrame, key: str) -> DataFrame:
    kind = dict(df.dtypes)[key]
    return _transform(
        df.select(key, "seq"),
        [key],
        RunningCount(),
        f"key {kind}, seq bigint, running_count bigint",
    ).withColumnRenamed("key", key)


def category_counts_stream(df: DataFrame, key: str, category: str, ttl_ms: int | None = None) -> DataFrame:
    """(key, seq, category, count): the running count of a key's rows of the same category.

    With ``ttl_ms`` an ordinary trigger is needed: processing time keeps an availableNow run going.
    """
    kind = dict(df.dtypes)[key]
    counted = _transform(
        df.select(key, "seq", F.col(category).cast("string").alias("category")),
        [key],
        CountsByCategory(ttl_ms),
        f"key {kind}, seq bigint, category string, count bigint",
        "None" if ttl_ms is None else "ProcessingTime",
    )
    return counted.select(F.col("key").alias(key), "seq", F.col("category").alias(category), "count")


def rolling_reduce_stream(
    df: DataFrame, key: str, value: str, reduce: Callable[[tuple, tuple], tuple]
) -> DataFrame:
    kind = dict(df.dtypes)[key]
    return _transform(
        _keyed(df, key, value),
        [key],
        RollingReduce(reduce),
        f"key {kind}, seq bigint, at bigint, value double",
    ).withColumnRenamed("key", key)


def changelog_stream(df: DataFrame, key: str, value: str) -> DataFrame:
    kind = dict(df.dtypes)[key]
    return _transform(
        _keyed(df, key, value),
        [key],
        Changelog(),
        f"key {kind}, seq bigint, op string, count bigint, sum double",
    ).withColumnRenamed("key", key)


def count_window_avg_stream(
    df: DataFrame, key: str, value: str, size: int = 10, slide: int = 2
) -> DataFrame:
    kind = dict(df.dtypes)[key]
    return _transform(
        _keyed(df, key, value),
        [key],
        CountWindowAvg(size, slide),
        f"key {kind}, seq bigint, n bigint, avg double",
    ).withColumnRenamed("key", key)


def over_rows_stream(df: DataFrame, key: str, value: str, preceding: int = 2) -> DataFrame:
    kind = dict(df.dtypes)[key]
    return _transform(
        _keyed(df, key, value),
        [key],
        OverRows(preceding),
        f"key {kind}, seq bigint, count bigint, avg double",
    ).withColumnRenamed("key", key)


def click_limit_stream(
    clicks: DataFrame,
    limit: int = 100,
    reset: str = "calendar_day",
    out_of_orderness: str | None = "1 day",
) -> DataFrame:
    """Passing clicks and warnings in one output, told apart by ``kind``.

    Counts are cleared once the watermark, ``out_of_orderness`` behind the newest click, has passed
    their reset; clicks older than the watermark are dropped. With None nothing is dropped and
    counts stay.
    """
    rows = clicks.select(
        "userId", "adId", "seq", "event_time", F.unix_micros("event_time").alias("at")
    )
    expires = out_of_orderness is not None
    if expires:
        rows = rows.withWatermark("event_time", out_of_orderness)
    return _transform(
        rows,
        ["userId", "adId"],
        ClickLimit(limit, reset, expires),
        "user bigint, ad bigint, seq bigint, kind string",
        "EventTime" if expires else "None",
    ).select(F.col("user").alias("userId"), F.col("ad").alias("adId"), "seq", "kind")


def key_timer_stream(df: DataFrame, key: str, delay_ms: int = 5000) -> DataFrame:
    """Needs an ordinary trigger: a processing-time timer keeps an availableNow run going."""
    kind = dict(df.dtypes)[key]
    return _transform(
        df.select(key),
        [key],
        KeyTimer(delay_ms),
        f"key {kind}, kind string, value bigint",
        "ProcessingTime",
    ).withColumnRenamed("key", key)


def rise_alert_stream(df: DataFrame, key: str, value: str, interval_us: int) -> DataFrame:
    """Set the watermark on ``df`` first."""
    kind = dict(df.dtypes)[key]
    alerts = _transform(
        _keyed(df, key, value),
        [key],
        RiseAlert(interval_us),
        f"key {kind}, rise_start bigint, alert_time bigint",
        "EventTime",
    )
    return alerts.select(
        F.col("key").alias(key),
        F.timestamp_micros("rise_start").alias("rise_start"),
        F.timestamp_micros("alert_time").alias("alert_time"),
    )


def login_failures_stream(
    logins: DataFrame, interval_us: int, min_failures: int = 2
) -> DataFrame:
    """Set the watermark on ``logins`` first."""
    rows = logins.withColumn(
        "__failed", F.when(F.col("loginState") == "fail", 1.0).otherwise(0.0)
    )
    warnings = _transform(
        _keyed(rows, "userId", "__failed"),
        ["userId"],
        RepeatedFailures(interval_us, min_failures),
        "key bigint, first_fail bigint, last_fail bigint, fail_times bigint",
        "EventTime",
    )
    return warnings.select(
        F.col("key").alias("userId"),
        F.timestamp_micros("first_fail").alias("first_fail"),
        F.timestamp_micros("last_fail").alias("last_fail"),
        "fail_times",
    )
