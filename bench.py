"""Time the registered queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (comma-separated
names, default all below). Every query is run twice through the no-op sink, which computes every
row and column; the faster run counts.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from eventlake import session
from eventlake.plans import registry

HEADLINE = [
    "wordcount",
    "flatmap_split",
    "parse_access_log",
    "parse_csv_record",
    "filter_static_assets",
    "json_meta_path",
    "rolling_sum",
    "rolling_max_by",
    "rolling_reduce",
    "running_count_key",
    "running_count_all",
    "group_count_avg",
    "tumbling_count",
    "tumbling_min_by",
    "sliding_count",
    "count_window_avg",
    "window_allowed_lateness",
    "late_side_output",
    "temp_jump_alert",
    "rise_alert",
    "retract_changelog",
    "over_rows_count_avg",
    "topn_per_window",
    "hot_items",
    "hot_items_sql",
    "hot_pages",
    "page_views",
    "page_views_salted",
    "unique_visitors",
    "uv_bitmap",
    "uv_running",
    "ad_clicks_by_province",
    "click_filtered",
    "click_blacklist",
    "click_blacklist_rolling",
    "marketing_by_channel",
    "marketing_total",
    "login_fail",
    "raw_route",
    "udaf_avg",
    "udf_hash_code",
    "udtf_split_lateral",
    "sink_latest_per_key",
    "sink_csv_roundtrip",
    "wm_ascending",
    "raw_bucket_rows",
    "hot_items_stream",
    "hot_pages_stream",
    "unique_visitors_stream",
    "temp_jump_alert_stream",
    "running_count_stream",
    "rise_alert_stream",
    "login_fail_stream",
    "click_blacklist_stream",
    "uv_running_stream",
    "count_window_avg_stream",
    "over_rows_stream",
    "retract_changelog_stream",
    "count_avg_update_stream",
    "rolling_reduce_user",
    "uv_bitmap_daily",
    "hot_pages_updates_stream",
    "topn_changelog",
    "ad_clicks_stream",
    "marketing_by_channel_stream",
    "late_side_output_stream",
    "rolling_reduce_stream",
    "category_counts_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    chosen = names.split(",") if names else HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        spark = (
            session.builder("eventlake-bench")
            .master(f"local[{cpus}]")
            .config("spark.driver.memory", "8g")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        run = registry.queries()
        seconds = {}
        for name in chosen:
            times = []
            for _ in range(2):
                start = time.perf_counter()
                run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                times.append(time.perf_counter() - start)
            seconds[name] = round(min(times), 3)
        spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
