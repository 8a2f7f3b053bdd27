"""Dated lake buckets, with one JSON document per line.

A row lies in ``<base>/path=<escaped path>/dt=<date>``; rows of the hidden sub-paths lie likewise below
those. Key lists that are asked for get nested folders, ``<base>/<key=value>/…/dt=<date>``. Which
folders a row goes to depends on the row and the arguments only, so a batch that is written again
replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.operators.ordered import written
from eventlake.plans.raw_zone import ERROR_SUB_PATH, META_SUB_PATH
from eventlake.session import shared_dir
from eventlake.sinks.files import read_branch, write_branches

BATCH = "batch"
# What a part file is meant to hold at most (fixed value), and what a row has besides its two texts.
ROLL_BYTES = 256 << 20
_ROW_BYTES = 25
_LINE = "data STRING, extraData STRING"
# What Spark names the folder of an empty partition value (fixed value).
_EMPTY = "__HIVE_DEFAULT_PARTITION__"
_TAKEN = {"data", "extradata", "dt", BATCH, "path"}


def _nests(keys: Sequence[str]) -> Column:
    """Rows with just these path keys, in this order."""
    names = F.transform("entries", lambda e: e["key"])
    return names == F.array(*[F.lit(k) for k in keys]).cast("array<string>")


def write_lake(
    rows: DataFrame,
    base: str,
    batch_id: int | None = None,
    roll_bytes: int = ROLL_BYTES,
    nested: Sequence[Sequence[str]] = (),
) -> None:
    """Write `eventlake.plans.raw_zone.bucketed` rows.

    With a ``batch_id`` the rows go into a ``batch=N`` folder below the date and replace what an
    earlier try of the same batch left there. Files hold about ``roll_bytes`` at most, see `rolled`. Rows are evaluated once, to a table on shared storage; from its parts
    there is a write for each key list of ``nested``, one for all other rows, and one for each hidden sub-path.
    """
    for keys in nested:
        lowered = [k.lower() for k in keys]
        if not keys or len(set(lowered)) < len(keys) or _TAKEN & set(lowered):
            raise ValueError(f"{list(keys)} cannot be partition columns")
    lines = rows.select("path", "dt", "entries", F.from_json("data", _LINE).alias("l"))
    hidden = [META_SUB_PATH, ERROR_SUB_PATH]
    zone = F.lit("visible")
    for i, keys in enumerate(nested):
        zone = F.when(_nests(keys), F.lit(f"nested-{i}")).otherwise(zone)
    for root in hidden:
        mine = (F.col("path") == root) | F.startswith("path", F.lit(f"{root}/"))
        zone = F.when(mine, F.lit(root)).otherwise(zone)
    # Rows are parsed and routed in one pass; each write then reads its own part.
    tagged = lines.withColumn("zone", zone)
    stage = shared_dir(rows.sparkSession, "lake-rows")
    write_branches(tagged, stage, "zone")
    for i, keys in enumerate(nested):
        columns = [F.col("entries")[i]["value"].alias(key) for i, key in enumerate(keys)]
        part = read_branch(tagged, stage, f"nested-{i}", "zone").select("l.*", *columns, "dt")
        _write(part, base, [*keys, "dt"], batch_id, roll_bytes)
    for folder, name in [(base, "visible"), *((f"{base}/{root}", root) for root in hidden)]:
        part = read_branch(tagged, stage, name, "zone").select("l.*", "path", "dt")
        _write(part, folder, ["path", "dt"], batch_id, roll_bytes)


def rolled(df: DataFrame, buckets: list[str], size: Column, roll_bytes: int) -> DataFrame:
    """``df`` dealt so that no task writes more than about ``roll_bytes``, and so no file of a bucket is larger.

    Buckets lie one after another by their sizes' running sum. One of more than half of ``roll_bytes`` is dealt by hash to
    parts of that size. A task gets the parts that begin in the same stretch of bytes: small buckets
    share tasks, a large one has many. Sizes are summed per bucket first; no bucket meets in one task.
    """
    spark = df.sparkSession
    half = max(1, roll_bytes // 2)
    sizes = df.groupBy(*buckets).agg(F.sum(size).alias("__bytes"))
    upto = Window.orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    placed = written(
        sizes.select(
            *[F.col(f"`{b}`").alias(f"__b{i}") for i, b in enumerate(buckets)],
            "__bytes",
            F.ceil(F.col("__bytes") / half).cast("bigint").alias("__parts"),
            F.coalesce(F.sum("__bytes").over(upto), F.lit(0)).alias("__from"),
        ),
        "lake-buckets",
    )
    total = placed.agg(F.sum("__bytes")).first()[0]
    if not total:
        return df
    stretch = max(1, min(half, total // (2 * spark.sparkContext.defaultParallelism)))
    match = reduce(
        lambda x, y: x & y, [F.col(f"`{b}`").eqNullSafe(F.col(f"__b{i}")) for i, b in enumerate(buckets)]
    )
    part = F.pmod(F.xxhash64(*df.columns), F.col("__parts"))
    at = F.col("__from") + (part * (F.col("__bytes") / F.col("__parts"))).cast("bigint")
    numbered = df.join(placed, match).select(*df.columns, F.floor(at / stretch).cast("int").alias("__task"))
    return numbered.repartitionById(int(total // stretch) + 1, "__task").select(*df.columns)


def _write(
    df: DataFrame, folder: str, partitions: list[str], batch_id: int | None, roll_bytes: int
) -> None:
    size = F.octet_length("data") + F.octet_length("extraData") + _ROW_BYTES
    spread = rolled(df, partitions, F.coalesce(size, F.lit(_ROW_BYTES)), roll_bytes)
    mode = "append"
    if batch_id is not None:
        spread = spread.withColumn(BATCH, F.lit(batch_id))
        partitions, mode = [*partitions, BATCH], "overwrite"
    (
        spread.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .json(folder)
    )


def lake_batches(base: str, **kwargs) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for `write_lake`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_lake(batch, base, batch_id, **kwargs)

    return write


def _decoded(name: Column) -> Column:
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_lake_lines(spark: SparkSession, base: str, hidden: bool = True) -> DataFrame:
    """(path, dt, line) of every bucket, with the hidden ones unless told otherwise.

    ``path`` is the path the rows were routed to, whatever layout holds them.
    """
    roots = [base]
    if hidden:
        roots += [r for r in (f"{base}/{META_SUB_PATH}", f"{base}/{ERROR_SUB_PATH}")]
    found = None
    for root in roots:
        try:
            lines = spark.read.option("recursiveFileLookup", "true").text(root)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            continue
        found = lines.select("value", "_metadata.file_path") if found is None else (
            found.unionByName(lines.select("value", "_metadata.file_path"))
        )
    marker = base.rstrip("/").rsplit("/", 1)[-1]
    # The metadata column encodes folder names, which themselves escape special characters.
    below = F.substring_index(_decoded(F.col("file_path")), f"/{marker}/", -1)
    folders = F.regexp_extract(below, r"^(?:(.*)/)?dt=[^/]*/", 1)
    return found.select(
        F.replace(
            _decoded(F.regexp_replace(folders, "^(?:[^=]*/)?path=", "")), F.lit(_EMPTY), F.lit("")
        ).alias("path"),
        F.regexp_extract(below, r"(?:^|/)dt=([^/]*)/", 1).alias("dt"),
        F.col("value").alias("line"),
    )
