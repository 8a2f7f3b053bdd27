"""DuckDB statements that compute what the registered queries compute."""

from __future__ import annotations

_READINGS = """readings AS (
  SELECT event_id AS seq, user_id AS id, ts AS event_time, value AS temperature,
         CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""
_KEYED = """keyed AS (
  SELECT 'sensor_' || user_id AS id, epoch_us(ts) // 1000000 AS timestamp,
         value AS temperature FROM events)"""
_LINE = "'sensor_' || user_id || ',' || (epoch_us(ts) // 1000000) || ',' || value"
_BEHAVIORS = """behaviors AS (
  SELECT event_id AS seq, user_id AS "userId", CAST(props->>'k' AS BIGINT) AS "itemId",
         event_type AS behavior, ts AS event_time FROM events)"""
_CLICKS = """clicks AS (
  SELECT event_id AS seq, user_id AS "userId", CAST(props->>'k' AS BIGINT) AS "adId",
         n_name AS province, ts AS event_time
  FROM events JOIN nation ON user_id % 25 = n_nationkey)"""
_MARKETING = """marketing AS (
  SELECT event_type AS behavior, ts AS event_time,
         ['search', 'mail', 'partner'][CAST(props->>'k' AS INT) % 3 + 1] AS channel
  FROM events WHERE event_type = 'error')"""
_LOG = """log AS (
  SELECT event_id AS seq, '10.0.0.' || (user_id % 256) AS ip,
         CAST(user_id AS VARCHAR) AS "userId",
         date_trunc('second', ts - CASE WHEN event_id % 50 = 0 THEN INTERVAL 2 HOURS
                                        WHEN event_id % 50 = 25 THEN INTERVAL 5 MINUTES
                                        ELSE INTERVAL 0 SECONDS END) AS event_time,
         CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
         url || CASE event_id % 7 WHEN 0 THEN '/site.css' WHEN 1 THEN '/site.css?x'
                ELSE '' END AS url
  FROM events JOIN pages ON event_id % (SELECT count(*) FROM pages) = page_id)"""
_NOT_ASSET = r"method = 'GET' AND NOT regexp_matches(url, '\.(css|js|png|ico)$')"
# Arrivals with the watermark seen before each, and what windows are then still open.
_SEEN = """seen AS (
  SELECT *, max(event_time) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
                                  AND 1 PRECEDING) - INTERVAL 1 SECOND AS wm FROM log)"""
_PAGE_WINDOWS = f"""page_windows AS (
  SELECT * FROM (
    SELECT seen.*, make_timestamp((epoch_us(event_time) // 5000000 + i) * 5000000) AS e
    FROM seen, range(1, 121) r(i) WHERE {_NOT_ASSET})
  WHERE wm IS NULL OR e - INTERVAL 1 MILLISECOND + INTERVAL 1 MINUTE > wm)"""
_DELAYED = """delayed AS (
  SELECT event_id AS seq, user_id AS id, value AS temperature,
         CAST(round(value * 100) AS BIGINT) AS cents,
         ts - CASE WHEN event_id % 50 = 0 THEN INTERVAL 2 HOURS
              ELSE INTERVAL 0 SECONDS END AS event_time FROM events),
seen AS (
  SELECT *, max(event_time) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
                                  AND 1 PRECEDING) - INTERVAL 2 SECONDS AS wm,
         make_timestamp((epoch_us(event_time) // 15000000 + 1) * 15000000) AS window_end
  FROM delayed),
judged AS (
  SELECT *, coalesce(window_end - INTERVAL 1 MILLISECOND + INTERVAL 1 MINUTE <= wm, false)
         AS is_late FROM seen)"""
_ENVELOPES = """envelopes AS (
  SELECT event_id AS seq, 'topic' || (user_id % 3) AS topic, ts AS at_time,
    '{"data":' || CASE WHEN event_id % 29 = 0 THEN 'null' ELSE '{"user":' || user_id || '}' END
    || ',"meta":' || CASE WHEN event_id % 31 = 0 THEN '{}' ELSE
       '{"shard":{"priority":3,"value":' || (CAST(props->>'k' AS INT) % 3) || '},"type":{"priority":'
       || CASE WHEN event_id % 23 = 0 THEN '"high"' ELSE CAST(event_id % 7 AS VARCHAR) END
       || ',"value":"' || event_type || '"}}' END
    || CASE WHEN event_id % 19 = 0 THEN '' ELSE ',"extra_data":"e' || (props->>'k') || '"' END
    || CASE WHEN event_id % 17 = 0 THEN '' ELSE '}' END AS value
  FROM events),
readable AS (
  SELECT *, CAST(CASE WHEN json_valid(value) THEN value ELSE '{}' END AS JSON) AS j
  FROM envelopes),
fields AS (
  SELECT seq, topic, at_time, value, j->>'data' AS data, j->>'meta' AS meta,
         j->>'extra_data' AS extra_data FROM readable),
complete AS (
  SELECT * FROM fields
  WHERE data IS NOT NULL AND meta IS NOT NULL AND extra_data IS NOT NULL),
entries AS (
  SELECT seq, k, CAST(meta AS JSON)->k->>'value' AS v,
         CASE WHEN regexp_full_match(CAST(meta AS JSON)->k->>'priority', '[+-]?[0-9]{1,10}')
              THEN TRY_CAST(CAST(meta AS JSON)->k->>'priority' AS INT) END AS p
  FROM (SELECT seq, meta, unnest(json_keys(CAST(meta AS JSON))) AS k FROM complete)),
paths AS (
  SELECT c.seq, coalesce(string_agg(k || '=' || v, '/' ORDER BY p DESC, k || '=' || v), '')
         AS path
  FROM complete c LEFT JOIN entries e ON c.seq = e.seq
  GROUP BY c.seq HAVING count(k) = count(p) AND count(k) = count(v)),
routed AS (
  SELECT c.seq, path, topic, at_time,
         CAST(json_object('data', data, 'extraData', extra_data) AS VARCHAR) AS data
  FROM complete c JOIN paths p ON c.seq = p.seq
  UNION ALL
  SELECT c.seq, '.meta', topic, at_time,
         CAST(json_object('data', meta, 'extraData', '') AS VARCHAR)
  FROM complete c JOIN paths p ON c.seq = p.seq
  UNION ALL
  SELECT seq, '.error/' || topic, topic, at_time,
         CAST(json_object('data', value, 'extraData', '') AS VARCHAR)
  FROM envelopes WHERE seq NOT IN (SELECT seq FROM paths))"""


def _fold(text: str, base: int, mask: int) -> str:
    return (
        f"list_reduce(list_transform(string_split({text}, ''), "
        f"lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * {base} + c) & {mask})"
    )


_OFFSET = _fold('CAST("userId" AS VARCHAR)', 61, (1 << 29) - 1)


def _avg6(cents: str, n: str) -> str:
    """Mean of two-decimal numbers, rounded half up to six decimals in whole numbers."""
    return f"CAST((2 * ({cents}) * 10000 + ({n})) // (2 * ({n})) AS DOUBLE) / 1e6"


def _tumble(us: int, ts: str = "event_time") -> str:
    start = f"(epoch_us({ts}) // {us}) * {us}"
    return (
        f"make_timestamp({start}) AS window_start, make_timestamp({start} + {us}) AS window_end"
    )


def _tokens(text: str, separator: str) -> str:
    return (
        f"CASE WHEN {text} <> '' AND rtrim({text}, '{separator}') = '' THEN [] "
        f"ELSE string_split(rtrim({text}, '{separator}'), '{separator}') END"
    )


def _sliding(source: str, size_us: int, slide_us: int, keys: str) -> str:
    """Count per key and sliding window, written out window by window."""
    key_list = f"{keys}, " if keys else ""
    return f"""
      SELECT {key_list} make_timestamp(e - {size_us}) AS window_start,
             make_timestamp(e) AS window_end, count(*) AS "count"
      FROM (SELECT *, (epoch_us(event_time) // {slide_us} + i) * {slide_us} AS e
            FROM {source}, range(1, {size_us // slide_us + 1}) r(i))
      GROUP BY {key_list} e"""


def _episodes(opens: str, resets: str, source: str, key: str, hours: int) -> str:
    """CTEs ending in ``finished``: uncancelled episodes of ``source`` (key, event_time)."""
    span = f"INTERVAL {hours} HOURS"
    return f"""
    marked AS (SELECT *, {opens} AS opens, {resets} AS resets FROM {source}),
    islands AS (SELECT *, count(CASE WHEN resets THEN 1 END) OVER (
                  PARTITION BY {key} ORDER BY event_time, seq) AS island FROM marked),
    opening AS (SELECT {key}, island, event_time AS at_time FROM islands WHERE opens),
    closing AS (SELECT {key}, island - 1 AS island, event_time AS at_time FROM islands WHERE resets),
    episodes AS (
      SELECT {key}, island, min(at_time) AS s FROM opening GROUP BY {key}, island
      UNION ALL
      SELECT p.{key}, p.island, min(o.at_time)
      FROM episodes p JOIN opening o
        ON o.{key} = p.{key} AND o.island = p.island AND o.at_time > p.s + {span}
      GROUP BY p.{key}, p.island),
    finished AS (
      SELECT p.{key}, p.s, max(o.at_time) AS last_at, count(*) AS n
      FROM episodes p
      JOIN opening o ON o.{key} = p.{key} AND o.island = p.island
                    AND o.at_time BETWEEN p.s AND p.s + {span}
      LEFT JOIN closing c ON c.{key} = p.{key} AND c.island = p.island
      WHERE c.at_time IS NULL OR c.at_time > p.s + {span}
      GROUP BY p.{key}, p.s)"""


_RISES = f"""WITH RECURSIVE {_READINGS},
compared AS (SELECT *, lag(temperature) OVER (PARTITION BY id ORDER BY event_time, seq) AS before
             FROM readings),
{_episodes('coalesce(before < temperature, false)', 'coalesce(before >= temperature, false)',
           'compared', 'id', 10)}
SELECT id, s AS rise_start, s + INTERVAL 10 HOURS AS alert_time FROM finished"""

_LOGINS = f"""WITH RECURSIVE logins AS (
  SELECT user_id, event_id AS seq, ts AS event_time, event_type = 'error' AS failed FROM events),
{_episodes('failed', 'NOT failed', 'logins', 'user_id', 24)}
SELECT user_id AS "userId", s AS first_fail, last_at AS last_fail, n AS fail_times"""

_TEXT_LOGIN = "'login fail in 86400s for ' || n || ' times' AS warning"

_RANKED_CLICKS = f"""WITH {_CLICKS}, ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY "userId", "adId", CAST(event_time AS DATE) ORDER BY seq) AS n FROM clicks)"""

_CLICK_WARNINGS = f"""{_RANKED_CLICKS}
SELECT "userId", "adId", seq AS warned_at, 'click over 1 times.' AS warning
FROM ranked WHERE n = 2"""

_PAGE_VIEWS = f"""WITH {_BEHAVIORS}
SELECT window_start, window_end, count(*) AS "count"
FROM (SELECT {_tumble(3_600_000_000)} FROM behaviors WHERE behavior = 'view')
GROUP BY window_start, window_end"""

_UV = f"""WITH {_BEHAVIORS}
SELECT window_start, window_end, count(DISTINCT "userId") AS uv
FROM (SELECT {_tumble(3_600_000_000)}, "userId" FROM behaviors WHERE behavior = 'view')
GROUP BY window_start, window_end"""

_UV_RUNNING = f"""WITH {_BEHAVIORS}, first_seen AS (
  SELECT window_end, "offset", min(seq) AS seq
  FROM (SELECT {_tumble(3_600_000_000)}, {_OFFSET} AS "offset", seq
        FROM behaviors WHERE behavior = 'view')
  GROUP BY window_end, "offset")
SELECT window_end, seq, row_number() OVER (PARTITION BY window_end ORDER BY seq) AS uv
FROM first_seen"""

_VIEWS = "(SELECT * FROM behaviors WHERE behavior = 'view')"
_HOT_ITEMS = f"""WITH {_BEHAVIORS}, counts AS ({_sliding(
    _VIEWS, 3_600_000_000, 300_000_000, '"itemId"')}),
ranked AS (SELECT *, row_number() OVER (
             PARTITION BY window_end ORDER BY "count" DESC, "itemId") AS rank FROM counts)
SELECT window_end, CAST(rank AS INT) AS rank, "itemId", "count" FROM ranked WHERE rank <= 5"""

# Windows an append-mode stream has closed when its input ends.
_CLOSED = "window_end <= (SELECT max(ts) FROM events)"


def _part(seq: str, source: str, n: int) -> str:
    """The micro-batch of a row, where ``n`` of them cover equal ranges of ``seq``."""
    low, width = f"(SELECT min({seq}) FROM {source})", f"(SELECT max({seq}) - min({seq}) + 1 FROM {source})"
    return f"(({seq} - {low} + 1) * {n} - 1) // {width}"


_ROLLING_REDUCE = f"""WITH {_READINGS} SELECT id, seq, event_time,
  max(temperature) OVER (PARTITION BY id ORDER BY seq) AS temperature FROM readings"""

# Rows of four micro-batches, each judged by the largest event time of those before it.
_LATE_BY_BATCH = f"""WITH {_DELAYED},
parted AS (SELECT *, {_part('seq', 'delayed', 4)} AS p FROM judged),
marks AS (SELECT b, (SELECT max(event_time) FROM parted WHERE p < b) - INTERVAL 2 SECONDS AS mark FROM range(4) r(b))
SELECT seq, id, event_time, temperature FROM parted JOIN marks ON b = p
WHERE window_end - INTERVAL 1 MILLISECOND + INTERVAL 1 MINUTE <= mark"""

# Rankings of six micro-batches: windows the watermark reached in one (first), and those it had
# reached before that a late request of the batch still changed, three hours at most.
_PAGE_UPDATES = f"""WITH {_LOG},
parted AS (SELECT *, {_part('seq', 'log', 6)} AS p FROM log),
marks AS (
  SELECT b, (SELECT epoch_us(max(event_time)) - 1000000 + 1000 FROM parted WHERE p <= b) AS now
  FROM range(6) r(b)),
steps AS (SELECT *, lag(now) OVER (ORDER BY b) AS passed FROM marks),
counted AS (
  SELECT url, p, e FROM (
    SELECT url, p, (epoch_us(event_time) // 5000000 + i) * 5000000 AS e
    FROM parted, range(1, 121) r(i) WHERE {_NOT_ASSET}) JOIN steps ON b = p
  WHERE passed IS NULL OR e > passed - 10800000000),
changed AS (
  SELECT DISTINCT b, e, CASE WHEN passed IS NULL OR e > passed THEN 'first' ELSE 'corrected' END AS kind
  FROM counted JOIN steps ON p <= b
  WHERE e <= now AND (passed IS NULL OR e > passed OR p = b)),
counts AS (
  SELECT b, c.e, kind, url, count(*) AS "count"
  FROM changed c JOIN counted k ON c.e = k.e AND k.p <= c.b GROUP BY b, c.e, kind, url),
ranked AS (SELECT *, row_number() OVER (PARTITION BY b, e ORDER BY "count" DESC, url) AS n FROM counts)
SELECT make_timestamp(e) AS window_end, CAST(n AS INT) AS rank, url, "count", kind, b AS batch_id
FROM ranked WHERE n <= 3"""

_SAME_ROW = """o.window_end = s.window_end AND o.rank = s.rank AND o."itemId" = s."itemId"
    AND o."count" = s."count" """

# States after each of four micro-batches, and what tells one from the next.
_RANKED_CHANGES = f"""WITH {_BEHAVIORS},
parted AS (
  SELECT {_tumble(21_600_000_000)}, "itemId", {_part('seq', 'behaviors', 4)} AS p FROM behaviors),
counts AS (
  SELECT b, window_end, "itemId", count(*) AS "count" FROM parted JOIN range(4) r(b) ON p <= b
  GROUP BY b, window_end, "itemId"),
states AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY b, window_end ORDER BY "count" DESC, "itemId") AS INT) AS rank
    FROM counts) WHERE rank <= 5)
SELECT b AS batch_id, '+' AS op, window_end, rank, "itemId", "count" FROM states s
WHERE NOT EXISTS (SELECT 1 FROM states o WHERE o.b = s.b - 1 AND {_SAME_ROW})
UNION ALL
SELECT b + 1, '-', window_end, rank, "itemId", "count" FROM states s
WHERE b < 3 AND NOT EXISTS (SELECT 1 FROM states o WHERE o.b = s.b + 1 AND {_SAME_ROW})"""

_JUMPS = f"""WITH {_READINGS}, compared AS (
  SELECT *, lag(temperature) OVER (PARTITION BY id ORDER BY seq) AS before FROM readings)
SELECT id, seq, before AS "last", temperature AS "now" FROM compared
WHERE abs(before - temperature) >= 50.0"""

_RUNNING_COUNT = f"""WITH {_READINGS}
SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS running_count
FROM readings"""

_MULTISET = "SELECT event_id, user_id, value FROM events"
_SELECTED = f"WITH {_KEYED} SELECT id, temperature AS temp FROM keyed WHERE id = 'sensor_6'"
_KEYED_ROWS = f"WITH {_KEYED} SELECT id, timestamp, temperature FROM keyed"


def _hourly(closed_by: str) -> str:
    return f"""WITH {_READINGS}, counts AS (
      SELECT window_start, window_end, count(*) AS "count"
      FROM (SELECT {_tumble(3_600_000_000)} FROM readings) GROUP BY window_start, window_end)
    SELECT * FROM counts
    WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL {closed_by}"""


_SQL: dict[str, str] = {
    "src_text_lines": f"SELECT {_LINE} AS line FROM events",
    "src_text_stream": f"SELECT {_LINE} AS line FROM events",
    "src_topic_value": f"SELECT 'topic' || (user_id % 3) AS topic, {_LINE} AS value FROM events",
    "src_csv_table": _KEYED_ROWS,
    "src_csv_payload": _KEYED_ROWS,
    "parse_csv_record": _KEYED_ROWS,
    "parse_access_log": f"WITH {_LOG} SELECT * FROM log",
    "view_rename_rowtime": f"""WITH {_KEYED} SELECT id, timestamp AS ts, temperature AS temp,
        make_timestamp(timestamp * 1000000) AS rt FROM keyed""",
    "map_length": r"""SELECT CAST(length(text) + length(regexp_replace(text,
        '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS INT) AS length FROM documents""",
    "flatmap_split": f"SELECT unnest({_tokens('text', ',')}) AS token FROM documents",
    "filter_prefix": f"""SELECT line FROM (SELECT {_LINE} AS line FROM events)
        WHERE starts_with(line, 'sensor_1')""",
    "filter_equals": f"WITH {_BEHAVIORS} SELECT * FROM behaviors WHERE behavior = 'view'",
    "filter_static_assets": f"WITH {_LOG} SELECT * FROM log WHERE {_NOT_ASSET}",
    "table_select_filter": _SELECTED,
    "sql_select_where": _SELECTED,
    "epoch_to_event_time": """SELECT event_id, date_trunc('second', ts) AS from_seconds,
        date_trunc('millisecond', ts) AS from_millis FROM events""",
    "json_envelope": f"WITH {_ENVELOPES} SELECT seq, data, meta, extra_data FROM complete",
    "json_meta_path": f"""WITH {_ENVELOPES}
        SELECT v.seq, path FROM envelopes v LEFT JOIN paths p ON v.seq = p.seq""",
    "json_encode_pair": """SELECT event_id,
        CAST(json_object('data', event_type, 'extraData', props) AS VARCHAR) AS pair
        FROM events""",
    "part_rebalance": _MULTISET,
    "part_by_key": _MULTISET,
    "part_global": _MULTISET,
    "wordcount": f"""SELECT word, count(*) AS "count"
        FROM (SELECT unnest({_tokens('text', ' ')}) AS word FROM documents) GROUP BY word""",
    "rolling_sum": f"""WITH {_READINGS} SELECT seq, id, CAST(sum(cents) OVER (
        PARTITION BY id ORDER BY seq) AS DOUBLE) / 100 AS rolling_sum FROM readings""",
    "rolling_max_by": f"""WITH {_READINGS}, best AS (
        SELECT id, seq, max(temperature) OVER (PARTITION BY id ORDER BY seq) AS temperature
        FROM readings)
        SELECT b.id, b.seq, b.temperature, arg_min(r.event_time, r.seq) AS event_time,
               min(r.seq) AS max_seq
        FROM best b JOIN readings r ON r.id = b.id AND r.seq <= b.seq
                                   AND r.temperature = b.temperature
        GROUP BY b.id, b.seq, b.temperature""",
    "rolling_reduce": _ROLLING_REDUCE,
    "rolling_reduce_user": _ROLLING_REDUCE,
    "rolling_reduce_stream": _ROLLING_REDUCE,
    "category_counts_stream": """SELECT user_id AS id, event_id AS seq, event_type AS behavior,
        row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS "count" FROM events""",
    "late_side_output_stream": _LATE_BY_BATCH,
    "group_count_avg": f"""WITH {_READINGS} SELECT id, count(id) AS "count",
        {_avg6('sum(cents)', 'count(*)')} AS avg FROM readings GROUP BY id""",
    "tumbling_count": f"""WITH {_READINGS} SELECT window_start, window_end, id,
        count(*) AS "count" FROM (SELECT {_tumble(15_000_000)}, id FROM readings)
        GROUP BY window_start, window_end, id""",
    "tumbling_full_window": f"""WITH {_READINGS} SELECT id,
        epoch_ms(window_end) AS window_end_ms, count(*) AS size
        FROM (SELECT {_tumble(15_000_000)}, id FROM readings) GROUP BY window_end, id""",
    "tumbling_min_by": f"""WITH {_READINGS}, placed AS (
        SELECT {_tumble(21_600_000_000)}, * FROM readings), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY window_end, id
                                     ORDER BY temperature, seq) AS n FROM placed)
        SELECT window_start, window_end, id, seq, event_time, temperature
        FROM ranked WHERE n = 1""",
    "count_window_avg": f"""WITH {_READINGS}, framed AS (
        SELECT id, seq, row_number() OVER (PARTITION BY id ORDER BY seq) AS n,
          sum(cents) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN 9 PRECEDING
                           AND CURRENT ROW) AS total FROM readings)
        SELECT id, seq, n, {_avg6('total', 'least(n, 10)')} AS avg FROM framed WHERE n % 2 = 0""",
    "sliding_count": f"""WITH {_BEHAVIORS}
        {_sliding('behaviors', 3_600_000_000, 300_000_000, 'behavior')}""",
    "window_allowed_lateness": f"""WITH {_DELAYED}
        SELECT window_end - INTERVAL 15 SECONDS AS window_start, window_end, id,
               CAST(sum(cents) AS DOUBLE) / 100 AS "sum"
        FROM judged WHERE NOT is_late GROUP BY window_end, id""",
    "late_side_output": f"""WITH {_DELAYED}
        SELECT seq, id, event_time, temperature FROM judged WHERE is_late""",
    "wm_ascending": _hourly("0 HOURS"),
    "wm_bounded": _hourly("2 HOURS"),
    "temp_jump_alert": _JUMPS,
    "temp_jump_alert_stream": _JUMPS,
    "running_count_key": _RUNNING_COUNT,
    "running_count_stream": f"SELECT id, seq, running_count FROM ({_RUNNING_COUNT})",
    "running_count_all": """SELECT event_id AS seq, row_number() OVER (ORDER BY event_id)
        AS running_count FROM events""",
    "split_high_low": f"""WITH {_READINGS} SELECT seq, id, event_time, temperature,
        CASE WHEN temperature > 30 THEN 'high' ELSE 'low' END AS branch FROM readings""",
    "side_output_low": f"""WITH {_READINGS} SELECT seq, id, event_time, temperature
        FROM readings WHERE NOT temperature >= 30""",
    "retract_changelog": f"""WITH {_READINGS}, totals AS (
        SELECT id, seq, cents, count(*) OVER w AS n, sum(cents) OVER w AS total
        FROM readings WINDOW w AS (PARTITION BY id ORDER BY seq))
        SELECT id, seq, '+' AS op, n AS "count", CAST(total AS DOUBLE) / 100 AS "sum"
        FROM totals
        UNION ALL
        SELECT id, seq, '-', n - 1, CAST(total - cents AS DOUBLE) / 100
        FROM totals WHERE n > 1""",
    "rise_alert": _RISES,
    "rise_alert_stream": f"""{_RISES}
        WHERE s + INTERVAL 10 HOURS < (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
    "connect_comap": f"""WITH {_READINGS} SELECT id,
        CASE WHEN temperature > 30 THEN temperature END AS temperature,
        CASE WHEN temperature > 30 THEN 'high temp warning' ELSE 'normal' END AS status
        FROM readings""",
    "union_all": f"""WITH {_READINGS} SELECT seq, id, event_time, temperature
        FROM readings, range(2)""",
    "sql_tumble": f"""WITH {_READINGS} SELECT id, count(id) AS cnt,
        {_avg6('sum(cents)', 'count(*)')} AS avg_temp, window_end
        FROM (SELECT {_tumble(10_000_000)}, id, cents FROM readings) GROUP BY window_end, id""",
    "sql_hop": f"""WITH {_BEHAVIORS} SELECT "itemId" AS item_id, window_end, "count" AS cnt
        FROM ({_sliding(_VIEWS, 3_600_000_000, 300_000_000, '"itemId"')})""",
    "over_rows_count_avg": f"""WITH {_READINGS}, framed AS (
        SELECT id, event_time, count(id) OVER w AS cnt, sum(cents) OVER w AS total
        FROM readings WINDOW w AS (PARTITION BY id ORDER BY event_time, seq
                                   ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
        SELECT id, event_time, cnt, {_avg6('total', 'cnt')} AS avg_temp FROM framed""",
    "topn_per_window": f"""WITH {_BEHAVIORS}, counts AS (
        SELECT window_start, window_end, "itemId", count(*) AS "count"
        FROM (SELECT {_tumble(21_600_000_000)}, "itemId" FROM behaviors)
        GROUP BY window_start, window_end, "itemId"), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY window_end
                                     ORDER BY "count" DESC, "itemId") AS n FROM counts)
        SELECT window_start, window_end, "itemId", "count", CAST(n AS INT) AS rank
        FROM ranked WHERE n <= 5""",
    "hot_items": _HOT_ITEMS,
    "hot_items_sql": _HOT_ITEMS,
    "hot_items_stream": f"SELECT * FROM ({_HOT_ITEMS}) WHERE {_CLOSED}",
    "hot_pages": f"""WITH {_LOG}, {_SEEN}, {_PAGE_WINDOWS}, counts AS (
        SELECT url, e AS window_end, count(*) AS "count" FROM page_windows GROUP BY url, e),
        ranked AS (SELECT *, row_number() OVER (
            PARTITION BY window_end ORDER BY "count" DESC, url) AS n FROM counts)
        SELECT window_end, CAST(n AS INT) AS rank, url, "count" FROM ranked WHERE n <= 3""",
    # The stream waits three hours and a minute, so no row is late; it leaves open windows out.
    "hot_pages_stream": f"""WITH {_LOG}, counts AS (
        SELECT url, make_timestamp((epoch_us(event_time) // 5000000 + i) * 5000000) AS window_end,
               count(*) AS "count" FROM log, range(1, 121) r(i) WHERE {_NOT_ASSET} GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (
            PARTITION BY window_end ORDER BY "count" DESC, url) AS n FROM counts)
        SELECT window_end, CAST(n AS INT) AS rank, url, "count" FROM ranked
        WHERE n <= 3 AND window_end <= (SELECT max(event_time) - INTERVAL 3 HOURS
                                        - INTERVAL 1 MINUTE FROM log)""",
    # Late rows are those whose last window was closed too.
    "hot_pages_late": f"""WITH {_LOG}, {_SEEN}
        SELECT seq, ip, "userId", event_time, method, url FROM seen
        WHERE {_NOT_ASSET} AND wm IS NOT NULL
          AND make_timestamp((epoch_us(event_time) // 5000000 + 120) * 5000000)
              - INTERVAL 1 MILLISECOND + INTERVAL 1 MINUTE <= wm""",
    "page_views": _PAGE_VIEWS,
    "page_views_salted": _PAGE_VIEWS,
    "unique_visitors": _UV,
    "unique_visitors_stream": f"SELECT * FROM ({_UV}) WHERE {_CLOSED}",
    "uv_bitmap": f"""WITH {_BEHAVIORS}
        SELECT window_start, window_end, count(DISTINCT "offset") AS uv
        FROM (SELECT {_tumble(3_600_000_000)}, {_OFFSET} AS "offset"
              FROM behaviors WHERE behavior = 'view') GROUP BY window_start, window_end""",
    "uv_bitmap_daily": f"""WITH {_BEHAVIORS}
        SELECT window_start, window_end, count(DISTINCT "offset") AS uv
        FROM (SELECT {_tumble(86_400_000_000)}, {_OFFSET} AS "offset"
              FROM behaviors WHERE behavior = 'view') GROUP BY window_start, window_end""",
    "hot_pages_updates_stream": _PAGE_UPDATES,
    "topn_changelog": _RANKED_CHANGES,
    "ad_clicks_stream": f"""WITH {_CLICKS} SELECT province, window_end,
        strftime(window_end, '%Y-%m-%d %H:%M:%S') || '.0' AS window_end_text, "count"
        FROM ({_sliding('clicks', 3_600_000_000, 300_000_000, 'province')}) WHERE {_CLOSED}""",
    "marketing_by_channel_stream": f"""WITH {_MARKETING}
        SELECT channel, behavior, window_end, "count"
        FROM ({_sliding('marketing', 3_600_000_000, 5_000_000, 'channel, behavior')}) WHERE {_CLOSED}""",
    "uv_running": _UV_RUNNING,
    "uv_running_stream": _UV_RUNNING,
    "ad_clicks_by_province": f"""WITH {_CLICKS} SELECT province, window_end,
        strftime(window_end, '%Y-%m-%d %H:%M:%S') || '.0' AS window_end_text, "count"
        FROM ({_sliding('clicks', 3_600_000_000, 300_000_000, 'province')})""",
    "click_filtered": f"""{_RANKED_CLICKS}
        SELECT seq, "userId", "adId", province, event_time FROM ranked WHERE n <= 1""",
    "click_blacklist": _CLICK_WARNINGS,
    "click_blacklist_stream": f"""{_RANKED_CLICKS}
        SELECT "userId", "adId", seq, CASE n WHEN 1 THEN 'pass' ELSE 'warn' END AS kind
        FROM ranked WHERE n <= 2""",
    "click_blacklist_rolling": f"""WITH RECURSIVE {_CLICKS}, periods AS (
        SELECT "userId", "adId", min(event_time) AS s FROM clicks GROUP BY "userId", "adId"
        UNION ALL
        SELECT p."userId", p."adId", min(c.event_time)
        FROM periods p JOIN clicks c ON c."userId" = p."userId" AND c."adId" = p."adId"
          AND c.event_time > p.s + INTERVAL 1 DAY
        GROUP BY p."userId", p."adId"), ranked AS (
        SELECT c."userId", c."adId", c.seq, row_number() OVER (
          PARTITION BY c."userId", c."adId", p.s ORDER BY c.event_time, c.seq) AS n
        FROM clicks c JOIN periods p ON c."userId" = p."userId" AND c."adId" = p."adId"
          AND c.event_time BETWEEN p.s AND p.s + INTERVAL 1 DAY)
        SELECT "userId", "adId", seq AS warned_at, 'click over 1 times.' AS warning
        FROM ranked WHERE n = 2""",
    "marketing_by_channel": f"""WITH {_MARKETING}
        SELECT channel, behavior, window_end, "count"
        FROM ({_sliding('marketing', 3_600_000_000, 5_000_000, 'channel, behavior')})""",
    "marketing_total": f"""WITH {_MARKETING}
        SELECT 'total' AS channel, 'total' AS behavior, window_end, "count"
        FROM ({_sliding('marketing', 3_600_000_000, 5_000_000, '')})""",
    "login_fail": f"{_LOGINS}, {_TEXT_LOGIN} FROM finished WHERE n >= 2",
    "login_fail_stream": f"""{_LOGINS} FROM finished WHERE n >= 2
        AND s + INTERVAL 24 HOURS < (SELECT date_trunc('millisecond', max(ts))
                                     - INTERVAL 3 SECONDS FROM events)""",
    "raw_route": f"WITH {_ENVELOPES} SELECT seq, path, topic, data FROM routed",
    "raw_bucket_rows": f"""WITH {_ENVELOPES} SELECT path,
        strftime(at_time + INTERVAL 8 HOURS, '%Y-%m') AS dt, data AS line FROM routed""",
    "udaf_avg": f"""WITH {_READINGS} SELECT id,
        {_avg6('sum(cents)', 'count(*)')} AS avg_temp FROM readings GROUP BY id""",
    "udf_hash_code": f"""WITH {_KEYED}, hashed AS (
        SELECT id, ({_fold('id', 31, (1 << 32) - 1)} + 23) & {(1 << 32) - 1} AS h FROM keyed)
        SELECT id, CAST(CASE WHEN h >= {1 << 31} THEN h - {1 << 32} ELSE h END AS INT)
               AS hash_code FROM hashed""",
    "udtf_split_lateral": f"""WITH {_KEYED}, split AS (
        SELECT id, timestamp, unnest({_tokens('id', '_')}) AS word FROM keyed)
        SELECT id, timestamp, word, CAST(length(word) AS INT) AS length FROM split""",
    "sink_topic_payload": f"""WITH {_KEYED} SELECT 'SensorReading{{id=''' || id
        || ''', timestamp=' || timestamp || ', temperature=' || temperature || '}}' AS value
        FROM keyed""",
    "sink_csv_payload": f"SELECT {_LINE} AS value FROM events",
    "sink_csv_roundtrip": _KEYED_ROWS,
    "sink_latest_per_key": """SELECT CAST(user_id AS VARCHAR) AS field,
        CAST(arg_max(value, event_id) AS VARCHAR) AS value FROM events GROUP BY user_id""",
    "sink_jdbc_upsert": """SELECT user_id AS id, coalesce(
          arg_max(value, event_id) FILTER (event_type = 'view'),
          arg_max(value, event_id) FILTER (event_type IS DISTINCT FROM 'view')) AS temp
        FROM events GROUP BY user_id""",
    "sink_doc_payload": f"""WITH {_KEYED} SELECT CAST(json_object('id', id,
        'temp', CAST(temperature AS VARCHAR), 'ts', CAST(timestamp AS VARCHAR)) AS VARCHAR)
        AS document FROM keyed""",
}


_SQL["count_window_avg_stream"] = _SQL["count_window_avg"]
_SQL["retract_changelog_stream"] = _SQL["retract_changelog"]
_SQL["count_avg_update_stream"] = _SQL["group_count_avg"]
_SQL["over_rows_stream"] = f"""WITH {_READINGS}, framed AS (
  SELECT id, seq, count(id) OVER w AS n, sum(cents) OVER w AS total
  FROM readings WINDOW w AS (PARTITION BY id ORDER BY seq
                             ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT id, seq, n AS "count", {_avg6('total', 'n')} AS avg FROM framed"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
