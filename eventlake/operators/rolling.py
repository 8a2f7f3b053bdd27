"""Rolling aggregates: one output per input row, in arrival order.

Batch forms. ``seq`` is the arrival number, a unique integer. On streams use
`eventlake.streaming.processors`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.operators.ordered import CHUNK, DEFAULT_CHUNK_ROWS, ordered, written

Reduce = Callable[[tuple, tuple], tuple]


def rolling_sum(
    df: DataFrame,
    key: str,
    value: Column,
    seq: str = "seq",
    out: str = "rolling_sum",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the key's rows so far."""
    rows = ordered(df, [key], [seq], chunk_rows)
    return rows.running({out: ("sum", value)}).result()


def rolling_max_by(
    df: DataFrame,
    key: str,
    by: str,
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """For each row, the whole row that holds the key's maximum so far; the first wins ties.

    Output columns: those of ``df``, with ``seq`` still the current row's number and
    ``max_seq`` the number of the row shown.
    """
    others = [c for c in df.columns if c not in (key, by, seq)]
    best = F.struct(F.col(by), (-F.col(seq)).alias("__first"), *others)
    rows = ordered(df, [key], [seq], chunk_rows)
    rolled = rows.running({"__best": ("max", best)}).result()
    return rolled.select(
        key,
        seq,
        *[F.col(f"__best.{c}").alias(c) for c in [by, *others]],
        (-F.col("__best.__first")).alias("max_seq"),
    )


def rolling_reduce(
    df: DataFrame,
    key: str,
    newest: str,
    maximum: str,
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """(key, newest timestamp, maximum so far) for each row."""
    rows = ordered(df, [key], [seq], chunk_rows)
    rolled = rows.running({"__max": ("max", F.col(maximum))}).result()
    return rolled.select(key, seq, newest, F.col("__max").alias(maximum))


def _scanned(
    df: DataFrame, group: list[str], order: str, columns: list[str], reduce: Reduce, start: str | None = None
) -> DataFrame:
    """``df`` with ``columns`` replaced by what they fold to from the group's first row to each row.

    Groups are dealt to tasks and sorted there; a task walks its rows with one value in hand, so a group needs
    no memory. ``start`` names a struct column with the value a group begins with; null is none.
    """
    known = [*df.columns]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = so_far = None
        for batch in batches:
            groups = list(zip(*(batch.column(g).to_pylist() for g in group)))
            values = list(zip(*(batch.column(c).to_pylist() for c in columns)))
            starts = [None] * len(groups) if start is None else batch.column(start).to_pylist()
            out = []
            for mine, value, before in zip(groups, values, starts):
                if mine != of:
                    of = mine
                    so_far = None if before is None else tuple(before[c] for c in columns)
                so_far = value if so_far is None else reduce(so_far, value)
                out.append(so_far)
            folded = dict(zip(columns, zip(*out))) if out else {}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(folded[c], batch.schema.field(c).type) if c in folded else batch.column(c)
                    for c in known
                ],
                known,
            )

    dealt = df.repartition(*group).sortWithinPartitions(*group, order)
    return dealt.mapInArrow(walk, df.schema)


def rolling_reduce_user(
    df: DataFrame,
    key: str,
    columns: list[str],
    reduce: Reduce,
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """(key, seq, columns): for each row what ``reduce`` makes of the key's rows so far.

    ``reduce`` takes two tuples of the columns, the earlier one first, and returns one; the first row stands as it is.
    It has to be associative: a hot key's chunks are folded each by itself, their results are folded along
    the key, and each chunk then starts with what comes before it. Results do not depend on ``chunk_rows``
    if no rounding is involved. Columns keep their types.
    """
    rows = ordered(df.select(key, seq, *columns), [key], [seq], chunk_rows)
    if not rows.cut:
        return _scanned(rows.df, [key], seq, columns, reduce)
    group = [key, CHUNK]
    ends = _scanned(rows.hot(), group, seq, columns, reduce)
    totals = written(
        ends.groupBy(*group).agg(F.max_by(F.struct(*columns), seq).alias("__last")).select(*group, "__last.*"),
        "chunk-folds",
    )
    along = _scanned(totals, [key], CHUNK, columns, reduce)
    before = F.lag(F.struct(*columns)).over(Window.partitionBy(key).orderBy(CHUNK))
    carry = written(along.select(*rows.chunk_keys(), before.alias("__before")), "chunk-starts")
    started = rows.join_chunks(carry).select(*rows.df.columns, "__before")
    return _scanned(started, group, seq, columns, reduce, "__before").select(key, seq, *columns)


def running_count(
    df: DataFrame,
    key: str | None = None,
    seq: str = "seq",
    out: str = "running_count",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> DataFrame:
    """Number of rows so far, per key or over the whole input."""
    keys = [key] if key else []
    rows = ordered(df, keys, [seq], chunk_rows)
    return rows.running({out: ("count", F.lit(1))}).result()


def word_count(lines: DataFrame, column: str = "line") -> DataFrame:
    """(word, count) over space-separated words; works on batch and stream input."""
    from eventlake.functions.text import words

    return (
        lines.select(F.explode(words(F.col(column))).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def group_count_avg(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count and mean per key."""
    return df.groupBy(key).agg(
        F.count(key).alias("count"), F.avg(value).alias("avg")
    )
