"""Lines repeated across documents: range-partitioned hashes, first occurrences, keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import written

LEAST_CHARS = 40
LEAST_DOCUMENTS = 5
# Occurrences that a range of the sorted table is meant to hold.
RANGE_ROWS = 1_000_000
WORD_BITS = 64

_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)


def lines_of(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased and nothing else changed."""
    bare = F.btrim(line, F.lit(_BLANK))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    # Lower-casing whole strings is the cheaper of the two, and the same on ASCII.
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _order_id(doc_id: Column) -> Column:
    """Rows without doc_id are one document, smaller than all others."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(_NO_ID))


def _row_key() -> list[Column]:
    """What tells rows apart: the document and its text, so that rows which share an id keep their own lines."""
    text = F.coalesce("text", F.lit(""))
    return [_order_id(F.col("doc_id")).alias("doc"), F.xxhash64(text).alias("of"), F.xxhash64(F.lit(13), text).alias("of2")]


def occurrences(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(high, low, doc, of, of2, at): hashes and places of all lines long enough, sorted in ranges.

    Ranges go by hash and document, so that a line of very many documents is spread over several;
    within a range rows are sorted by hash, then document from the largest, then place.
    """
    lines = docs.select(*_row_key(), F.posexplode(lines_of(F.col("text"))).alias("at", "line"))
    keys = lines.select("doc", "of", "of2", "at", F.btrim("line", F.lit(_BLANK)).alias("line")).where(
        F.char_length("line") >= least_chars
    )
    key = line_key(F.col("line"))
    hashed = written(
        keys.select(F.xxhash64(key).alias("high"), F.xxhash64(F.lit(7), key).alias("low"), "doc", "of", "of2", "at"),
        "lines-hashed",
    )
    ranges = max(1, -(-hashed.count() // RANGE_ROWS))
    return written(
        hashed.repartitionByRange(
            max(ranges, docs.sparkSession.sparkContext.defaultParallelism), "high", "low", F.desc("doc")
        ).sortWithinPartitions("high", "low", F.desc("doc"), "at"),
        "lines-sorted",
    )


def repeated_lines(found: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(high, low, keeper): the lines of at least so many documents, and the largest doc that holds each.

    A document counts once for a line, however often it holds it: first its occurrences are made one, then
    documents are counted, both times partially before the shuffle.
    """
    once = found.groupBy("high", "low", "doc").agg(F.min("at").alias("at"))
    return (
        once.groupBy("high", "low")
        .agg(F.count(F.lit(1)).alias("documents"), F.max("doc").alias("keeper"))
        .where(F.col("documents") >= least_documents)
        .select("high", "low", "keeper")
    )


def dropped_words(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """(doc, of, of2, words): the keep bitmap of every row that loses lines.

    Of a bitmap only those 64-bit words are there in which some line goes: ``words`` is a sorted array of
    (word, gone), and bit b of ``gone`` says that line 64 * word + b goes. Rows without an entry keep all.
    """
    found = occurrences(docs, least_chars)
    lines = written(repeated_lines(found, least_documents), "lines-repeated")
    gone = found.join(lines, ["high", "low"]).where(F.col("doc") != F.col("keeper"))
    bit = F.expr(f"shiftleft(1L, at % {WORD_BITS})")
    words = gone.groupBy("doc", "of", "of2", F.expr(f"at div {WORD_BITS}").alias("word")).agg(F.bit_or(bit).alias("gone"))
    return words.groupBy("doc", "of", "of2").agg(
        F.sort_array(F.collect_list(F.struct("word", "gone"))).alias("words")
    )


def dropped_places(words: Column) -> Column:
    """The places of the dropped lines, ascending."""
    bits = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))

    def places(word: Column) -> Column:
        is_set = lambda b: F.expr("1L") == F.call_function("shiftright", word["gone"], b).bitwiseAND(F.lit(1).cast("bigint"))
        return F.transform(F.filter(bits, is_set), lambda b: (word["word"] * WORD_BITS + b).cast("int"))

    return F.flatten(F.transform(words, places))


def kept_lines(lines: Column, gone: Column) -> Column:
    """The lines between the dropped places: each stretch is one slice, so the work is linear."""
    borders = F.concat(gone, F.array(F.size(lines)))

    def stretch(border: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(borders, i - 1) + 1)
        return F.slice(lines, start + 1, border - start)

    return F.flatten(F.transform(borders, stretch))


def without_repeated_lines(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row of ``docs`` (doc_id, text; other columns are ignored).

    Lines whose keys (see `line_key`) have at least ``least_chars`` code points and occur in at least
    ``least_documents`` documents go, but for those in the largest doc_id that holds them. Occurrences are
    hashed, range-partitioned and sorted; what comes back to the texts is a compressed bitmap per document.

    A null or empty text is one empty line, which is kept. Rows without doc_id count as one document, smaller
    than all others; rows that repeat a doc_id count as one document, and each keeps or loses its own lines.
    Keys are told apart by 128 bits. An empty table gives an empty result.
    """
    words = written(dropped_words(docs, least_chars, least_documents), "lines-bitmaps")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = rows.select("doc_id", "text", *_row_key()).join(words, ["doc", "of", "of2"], "left")
    none = F.array().cast("array<int>")
    split = joined.select(
        "doc_id",
        "text",
        lines_of(F.col("text")).alias("lines"),
        F.when(F.col("words").isNotNull(), dropped_places(F.col("words"))).alias("gone"),
    )
    return split.select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit("")))
        .otherwise(F.array_join(kept_lines(F.col("lines"), F.coalesce("gone", none)), "\n"))
        .alias("text"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
