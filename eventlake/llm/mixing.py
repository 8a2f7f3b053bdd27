"""Mixing sources to target weights by capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.common import WORD, seeded_unit, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = 20
SLICES = 4096


def word_count(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, source_size) of (source, size); rows of a null source are one source."""
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` with ``weight``: the weights in turn along the code-point order of source, null last.

    The place of a source is counted by range: sources are dealt to ranges of their order, and a
    range starts where the ones before it end, so no task sees all sources.
    """
    dealt = written(
        sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn(
            "part", F.spark_partition_id()
        ),
        "mixing-ranges",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("part")
        .count()
        .withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    )  # one row for each range
    within = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return (
        dealt.withColumn("nth", F.row_number().over(within) - 1)
        .join(starts.select("part", "start"), "part")
        .withColumn(
            "weight",
            F.element_at(cycle, (F.pmod(F.col("start") + F.col("nth"), F.lit(len(weights))) + 1).cast("int")),
        )
        .select(*sources.columns, "weight")
    )


def water_fill(
    sources: DataFrame, share: float = SHARE, most_epochs: float = MOST_EPOCHS, rounds: int = 1000
) -> DataFrame:
    """``sources`` (…, source_size, weight) with ``target``: weighted shares, none above its cap.

    The total is ``share`` of all sizes. Sources whose share reaches ``most_epochs`` times their
    size stop there and the excess goes to the others by weight, until none is above. Only sums
    reach the driver. If every source is at its cap, the rest of the total is left over. Targets that have
    not settled after ``rounds`` rounds are an error.
    """
    cap = F.col("source_size") * most_epochs
    per_weight = 0.0
    full = F.lit(False)
    for _ in range(rounds):
        sums = sources.agg(
            F.sum(F.col("source_size").cast("double")).alias("all"),
            F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weights"),
            F.sum(F.when(full, 1).otherwise(0)).alias("n"),
            F.count(F.lit(1)).alias("sources"),
        ).first()
        if not sums["weights"]:
            break
        level = (share * sums["all"] - sums["capped"]) / sums["weights"]
        if sums["n"] and level <= per_weight:
            break
        per_weight = max(level, per_weight)
        full = F.col("weight") * per_weight >= cap
        if not sources.where(full).agg(F.count(F.lit(1))).first()[0] > sums["n"]:
            break
    else:
        raise RuntimeError(f"targets did not settle in {rounds} rounds")
    target = F.least(F.col("weight") * per_weight, cap)
    return sources.withColumn("target", target.cast("double"))


def sized_documents(docs: DataFrame, with_rows: bool = False) -> DataFrame:
    """(doc_id, source, size, digest) of every row, and ``row``, all its columns, if asked for."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if with_rows else []
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("digest"),
        *row,
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most_epochs: float = MOST_EPOCHS,
    seed: int = SEED,
    slices: int = SLICES,
    with_rows: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs``, and its ``row`` if asked for.

    ``docs`` needs doc_id, source and text. ``taken`` is how many of the document's words the mix takes, repeats
    counted: as many whole repetitions as the source's target holds, and one more for the
    documents that come first in a seeded order, until the source's target is reached; one
    document at that border gives part of its words. The order depends on seed, doc_id, size and text only,
    so reruns agree. Rows that repeat a doc_id, or have none, are taken each by itself; of rows that are alike
    in all of these it is the same which is taken. A null or blank text has size 0 and takes nothing; an empty
    table gives an empty result. ``row`` is a struct of all columns of ``docs``, whatever their names.

    A source's documents are dealt to ``slices`` slices of the seeded order. Sums of slices give
    the slice the border lies in, and only its documents are put in order.
    """
    sized = written(sized_documents(docs), "mixing-sizes")
    targets = written(
        water_fill(
            written(cyclic_weights(source_sizes(sized), weights), "mixing-weights"), share, most_epochs
        ),
        "mixing-targets",
    )
    # Rows without doc_id go by their texts, so that they do not fall into one slice.
    order = seeded_unit(seed, F.coalesce("doc_id", "digest"), F.col("size"))


    def place(rows: DataFrame) -> DataFrame:
        return rows.withColumn("u", order).withColumn("slice", F.floor(F.col("u") * slices).cast("int"))

    placed = place(sized)
    # The part of a repetition beyond the whole ones, in words.
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    borders = (
        placed.groupBy("source", "slice")
        .agg(F.sum("size").alias("words"))
        .withColumn(
            "before",
            F.sum("words").over(Window.partitionBy("source").orderBy("slice")) - F.col("words"),
        )
        .join(
            targets.withColumn("whole", whole).withColumnRenamed("source", "of"),
            F.col("source").eqNullSafe(F.col("of")),
        )
        .withColumn("more", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("bigint"))
        .where((F.col("before") <= F.col("more")) & (F.col("more") < F.col("before") + F.col("words")))
        .select("source", "slice", F.col("more") - F.col("before"))
        .toDF("bordered", "border", "rest")
    )
    plan = written(
        targets.withColumn("whole", whole)
        .join(borders, F.col("source").eqNullSafe(F.col("bordered")), "left")
        .select(F.col("source").alias("of"), "source_size", "target", "whole", "border", "rest"),
        "mixing-plan",
    )
    # Without a border no document, or all of them, are taken once more.
    every = F.col("target") - F.col("whole") * F.col("source_size") >= F.col("source_size")
    # Rows with all their columns are only read here, where they meet a row for each source.
    whole_rows = place(sized_documents(docs, True)) if with_rows else placed
    joined = whole_rows.join(plan, F.col("source").eqNullSafe(F.col("of")))
    at_border = F.col("slice") == F.col("border")
    in_border = joined.where(at_border)
    upto = (
        Window.partitionBy("source")
        .orderBy("u", "doc_id", "size", "digest")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cut = in_border.withColumn(
        "extra",
        F.greatest(
            F.lit(0),
            F.least(F.col("size"), F.col("rest") - (F.sum("size").over(upto) - F.col("size"))),
        ),
    )
    others = joined.where(~F.coalesce(at_border, F.lit(False))).withColumn(
        "extra",
        F.when(
            F.coalesce(F.col("slice") < F.col("border"), every & F.col("border").isNull()), F.col("size")
        ).otherwise(0),
    )
    return cut.unionByName(others).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"),
        *(["row"] if with_rows else []),
    )


def repeated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix takes them (`mix`, which ``how`` is for): a row for each whole repetition, and a cut one for a part.

    A cut row ends after the words taken; its ``n_chars``, if there is one, is that of the cut text.
    Documents of which nothing is taken go. Rows carry their columns through the mix, so each is repeated as
    it was taken itself, also if its doc_id is null or repeats. ``docs`` is read more than once.
    """
    mixed = mix(docs, with_rows=True, **how).where("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("int")
    part = (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(
        F.array_repeat(F.lit(0), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>"))
    )
    joined = mixed.select("row.*", copies.alias("__copies"))
    rows = joined.withColumn("__words", F.explode("__copies"))
    head = F.concat(
        F.regexp_extract(F.col("text"), r"^[\x20\x09-\x0D]*", 0),
        F.array_join(
            F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, F.col("__words")),
            "",
        ),
    )
    out = rows.withColumn("text", F.when(F.col("__words") > 0, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn(
            "n_chars",
            F.when(F.col("__words") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")),
        )
    return out.select(docs.columns)
