"""Most viewed items per sliding window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators.topn import top_n
from eventlake.operators.windows import sliding_count


def hot_items(
    behaviors: DataFrame,
    n: int = 5,
    size: str = "1 hour",
    slide: str = "5 minutes",
    behavior: str = "pv",
    ts: str = "event_time",
) -> DataFrame:
    """(window_end, rank, itemId, count): the ``n`` most viewed items of every window.

    Items with equal counts rank by item id.
    """
    views = behaviors.where(F.col("behavior") == behavior)
    counts = sliding_count(views, size, slide, ["itemId"], ts)
    ranked = top_n(counts, ["window_end"], "count", n, ["itemId"])
    return ranked.select("window_end", "rank", "itemId", "count")


def hot_items_sql(
    spark: SparkSession,
    view: str,
    n: int = 5,
    size: str = "1 hour",
    slide: str = "5 minutes",
    behavior: str = "pv",
) -> DataFrame:
    """The same ranking as one SQL statement over a registered view."""
    return spark.sql(
        f"""
        SELECT window_end, CAST(row_num AS INT) AS rank, itemId, cnt AS count
        FROM (
          SELECT *, ROW_NUMBER() OVER (
                   PARTITION BY window_end ORDER BY cnt DESC, itemId) AS row_num
          FROM (
            SELECT window.end AS window_end, itemId, COUNT(*) AS cnt
            FROM {view}
            WHERE behavior = :behavior
            GROUP BY window(event_time, '{size}', '{slide}'), itemId))
        WHERE row_num <= {int(n)}
        """,
        args={"behavior": behavior},
    )
