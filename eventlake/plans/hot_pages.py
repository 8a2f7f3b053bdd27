"""Most requested pages per sliding window, with late requests set aside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.functions.times import micros
from eventlake.operators.ordered import DEFAULT_CHUNK_ROWS
from eventlake.operators.topn import top_n
from eventlake.operators.transforms import page_requests
from eventlake.operators.windows import MILLI, late_split, sliding_count


def page_counts(
    log: DataFrame,
    size: str = "10 minutes",
    slide: str = "5 seconds",
    out_of_orderness: str = "1 second",
    lateness: str = "1 minute",
    seq: str = "seq",
    chunk_rows: int = DEFAULT_CHUNK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(requests per URL and window, late requests).

    A request counts in those of its windows still open, lateness included, when it arrives;
    one that finds all of them closed is returned as late.
    """
    seen = late_split(
        log, size, out_of_orderness, lateness, slide=slide, seq=seq, chunk_rows=chunk_rows
    )
    requests = page_requests(seen)
    # Before the first arrival there is no watermark and every window is open.
    closed_until = F.coalesce(
        F.unix_micros("watermark") + MILLI - micros(lateness), F.lit(0).cast("bigint")
    )
    counts = sliding_count(
        requests.where(~F.col("is_late")), size, slide, ["url"], open_after=closed_until
    )
    return counts, requests.where("is_late").select(*log.columns)


def hot_pages(log: DataFrame, n: int = 3, **kwargs) -> DataFrame:
    """(window_end, rank, url, count): the ``n`` most requested pages of every window."""
    counts, _ = page_counts(log, **kwargs)
    ranked = top_n(counts, ["window_end"], "count", n, ["url"])
    return ranked.select("window_end", "rank", "url", "count")
