"""SQL (DuckDB) for the registered queries, over the same generated tables."""

from __future__ import annotations

_ACTIONS = """
ev AS (
  SELECT event_id, user_id, event_type, ts, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events
), parts AS (
  SELECT *,
    (day(ts) - 1) // CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 10 ELSE 30 END AS b,
    (event_id * 37 + k * 11) % CASE user_id % 7 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 50 WHEN 4 THEN 150 WHEN 5 THEN 900 ELSE 3600 END AS off,
    CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 10 ELSE 30 END AS w
  FROM ev
), timed AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(b * w * 86400 + user_id % 23 * 3600 + off) AS t FROM parts
), actions AS (
  SELECT strftime(t, '%Y-%m-%d') AS date, user_id, user_id || '_' || b AS session_id, k % 10 AS page_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS action_time,
    CASE WHEN event_type = 'view' THEN 'kw' || (k % 10) END AS search_keyword,
    CASE WHEN event_type = 'click' THEN k END AS click_category_id,
    CASE WHEN event_type = 'click' THEN (event_id * 13 + k) % 200 END AS click_product_id,
    CASE WHEN event_type = 'purchase' THEN k || ',' || ((k + 1) % 100) END AS order_category_ids,
    CASE WHEN event_type = 'purchase' THEN CAST(event_id % 200 AS VARCHAR) END AS order_product_ids,
    CASE WHEN event_type = 'signup' THEN CAST(k AS VARCHAR) END AS pay_category_ids,
    CASE WHEN event_type = 'signup' THEN CAST(event_id % 200 AS VARCHAR) END AS pay_product_ids,
    user_id % 25 AS city_id, event_id, t
  FROM timed
)"""

_USERS = """
users AS (
  SELECT c_custkey AS user_id, 'user' || c_custkey AS username, c_name AS name, CAST(c_custkey * 7 % 60 AS INTEGER) AS age, c_mktsegment AS professional, n_name AS city,
    CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
)"""

_CITIES = """
cities AS (
  SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name, CASE n_regionkey WHEN 0 THEN '华北' WHEN 1 THEN '华东' WHEN 2 THEN '华南' WHEN 3 THEN '西北' WHEN 4 THEN '东北' END AS area FROM nation
)"""

_LEVEL = "CASE WHEN area IN ('华北', '华东') THEN 'A级' WHEN area IN ('华南', '华中') THEN 'B级' WHEN area IN ('西北', '西南') THEN 'C级' ELSE 'D级' END"

_SESSIONS = """
all_sessions AS (
  SELECT session_id, min(user_id) AS user_id,
    coalesce(array_to_string(list_sort(list(DISTINCT search_keyword) FILTER (search_keyword IS NOT NULL)), ','), '') AS search_keywords,
    coalesce(array_to_string(list_sort(list(DISTINCT click_category_id) FILTER (click_category_id IS NOT NULL)), ','), '') AS click_category_ids,
    CAST(epoch(max(t)) - epoch(min(t)) AS BIGINT) AS visit_length, count(*) AS step_length, min(action_time) AS start_time
  FROM actions {where} GROUP BY session_id
)"""
_ALL = _SESSIONS.format(where="")
_RANGED = _SESSIONS.format(where="WHERE date BETWEEN '2024-01-01' AND '2024-01-31'")

_FILTERED = f"""{_ACTIONS}, {_USERS}, {_RANGED}, sessions AS (
  SELECT s.*, age, professional, city, sex FROM all_sessions AS s JOIN users USING (user_id)
  WHERE age BETWEEN 10 AND 50 AND sex = 'male' AND list_has_any(string_split(search_keywords, ','), ['kw0', 'kw1', 'kw2', 'kw3', 'kw4', 'kw5', 'kw6'])
)"""

_DETAIL = f"""{_FILTERED}, detail AS (
  SELECT * EXCLUDE (t) FROM actions WHERE date BETWEEN '2024-01-01' AND '2024-01-31' AND session_id IN (SELECT session_id FROM sessions)
), hits AS (
  SELECT click_category_id AS category_id, 'c' AS kind FROM detail WHERE click_category_id IS NOT NULL
  UNION ALL SELECT CAST(unnest(string_split(order_category_ids, ',')) AS BIGINT), 'o' FROM detail WHERE order_category_ids IS NOT NULL
  UNION ALL SELECT CAST(unnest(string_split(pay_category_ids, ',')) AS BIGINT), 'p' FROM detail WHERE pay_category_ids IS NOT NULL
), counts AS (
  SELECT category_id, count(*) FILTER (kind = 'c') AS click_count, count(*) FILTER (kind = 'o') AS order_count, count(*) FILTER (kind = 'p') AS pay_count FROM hits GROUP BY category_id
), top_categories AS (
  SELECT * FROM counts ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10
), top_sessions AS (
  SELECT category_id, session_id, click_count FROM (
    SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS r FROM (
      SELECT click_category_id AS category_id, session_id, count(*) AS click_count FROM detail WHERE click_category_id IN (SELECT category_id FROM top_categories) GROUP BY ALL
    ) AS y
  ) AS x WHERE r <= 10
)"""

_DETAIL_COLUMNS = "CAST(1 AS BIGINT) AS task_id, user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids"

_SAMPLE = f"""{_DETAIL}, hours AS (
  SELECT substr(start_time, 1, 10) AS date, substr(start_time, 12, 2) AS hour, count(*) AS session_count FROM sessions GROUP BY ALL
), quotas AS (
  SELECT date, hour, session_count, least(session_count * (100 // (SELECT count(DISTINCT date) FROM hours)) // sum(session_count) OVER (PARTITION BY date), session_count)::BIGINT AS quota FROM hours
), drawn AS (
  SELECT session_id, start_time, search_keywords, click_category_ids FROM (
    SELECT *, row_number() OVER (PARTITION BY substr(start_time, 1, 10), substr(start_time, 12, 2) ORDER BY md5(session_id || ':9'), session_id) AS r FROM sessions
  ) AS x JOIN quotas ON quotas.date = substr(start_time, 1, 10) AND quotas.hour = substr(start_time, 12, 2) WHERE r <= quota
)"""

_BINS = {
    "visit_length": ((1, 3, "1s_3s"), (4, 6, "4s_6s"), (7, 9, "7s_9s"), (10, 30, "10s_30s"), (31, 60, "31s_60s"), (61, 180, "1m_3m"), (181, 600, "3m_10m"), (601, 1800, "10m_30m"), (1801, 1 << 60, "30m")),
    "step_length": ((1, 3, "1_3"), (4, 6, "4_6"), (7, 9, "7_9"), (10, 30, "10_30"), (31, 60, "31_60"), (61, 1 << 60, "60")),
}
_COUNTS = [(f"{c}_{name}", f"count(*) FILTER ({c} BETWEEN {a} AND {b})") for c, bins in _BINS.items() for a, b, name in bins]

_PAIRS = """pairs AS (
  SELECT session_id, lag(page_id) OVER (PARTITION BY session_id ORDER BY action_time, event_id, page_id) || '_' || page_id AS page_split FROM actions
), flow AS (
  SELECT step, step || '_' || (step + 1) AS page_split FROM (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS step) AS x
), pv AS (
  SELECT step, page_split, (SELECT count(*) FROM pairs WHERE pairs.page_split = flow.page_split) AS pv FROM flow
), rates AS (
  SELECT step, page_split, pv, coalesce(lag(pv) OVER (ORDER BY step), (SELECT count(*) FROM actions WHERE page_id = 1)) AS base FROM pv
)"""

_LOG = """clicks AS (
  SELECT ts, replace(r_name, ' ', '-') AS province, replace(replace(n_name, '_', '-'), ' ', '-') AS city, user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 10 AS ad_id, strftime(ts, '%Y-%m-%d') AS date
  FROM (SELECT * REPLACE (date_trunc('milliseconds', ts) AS ts) FROM events) AS e JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey
), user_clicks AS (
  SELECT date, user_id, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL
), blacklist AS (
  SELECT DISTINCT user_id FROM user_clicks WHERE click_count >= 3
), stat AS (
  SELECT date, province, city, ad_id, count(*) AS click_count FROM {clicks} GROUP BY ALL
), by_province AS (
  SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM stat GROUP BY ALL
), top AS (
  SELECT date, province, ad_id, click_count FROM (SELECT *, row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS r FROM by_province) AS x WHERE r <= 3
)"""
_ALLOWED = _LOG.format(clicks="clicks WHERE user_id NOT IN (SELECT user_id FROM blacklist)")
_EVERY = _LOG.format(clicks="clicks")
#: The stream replayed: five batches by event id; a user is listed from the batch on after the one in which clicks on an ad in a day reach 3.
_REPLAY = """clicks AS (
  SELECT event_id % 5 AS batch, ts, replace(r_name, ' ', '-') AS province, replace(replace(n_name, '_', '-'), ' ', '-') AS city, user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 10 AS ad_id, strftime(ts, '%Y-%m-%d') AS date
  FROM (SELECT * REPLACE (date_trunc('milliseconds', ts) AS ts) FROM events) AS e JOIN nation ON user_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey
), so_far AS (
  SELECT user_id, batch, sum(count(*)) OVER (PARTITION BY date, user_id, ad_id ORDER BY batch) AS n FROM clicks GROUP BY date, user_id, ad_id, batch
), blacklist AS (
  SELECT user_id, min(batch) AS last_batch FROM so_far WHERE n >= 3 GROUP BY user_id
), allowed AS (
  SELECT clicks.* FROM clicks LEFT JOIN blacklist USING (user_id) WHERE last_batch IS NULL OR batch <= last_batch
), stat AS (
  SELECT date, province, city, ad_id, count(*) AS click_count FROM allowed GROUP BY ALL
), by_province AS (
  SELECT date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM stat GROUP BY ALL
), top AS (
  SELECT date, province, ad_id, click_count FROM (SELECT *, row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS r FROM by_province) AS x WHERE r <= 3
)"""
#: Windows of an hour every ten seconds, each click in all of its 360, then runs of windows of equal count.
_INTERVALS = """direct AS (
  SELECT start, minute, ad_id, count(*) AS click_count FROM (
    SELECT time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(10 * unnest(range(360))) AS start, date_trunc('minute', ts) AS minute, ad_id FROM {clicks}
  ) GROUP BY ALL
), marked AS (
  SELECT *, lag(start) OVER w IS DISTINCT FROM start - INTERVAL 10 SECOND OR lag(click_count) OVER w <> click_count AS fresh FROM direct WINDOW w AS (PARTITION BY minute, ad_id ORDER BY start)
), numbered AS (
  SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY minute, ad_id ORDER BY start) AS run FROM marked
) SELECT minute, ad_id, min(start) AS first_window, max(start) AS last_window, any_value(click_count) AS click_count FROM numbered GROUP BY minute, ad_id, run"""
_TREND = "SELECT date, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count FROM clicks GROUP BY ALL"
_AREA = f"""{_ACTIONS}, {_CITIES}, area_clicks AS (
  SELECT area, click_product_id AS product_id, count(*) AS click_count, array_to_string(list_sort(list(DISTINCT city_id || ':' || city_name)), ',') AS city_infos
  FROM actions JOIN cities USING (city_id) WHERE click_product_id IS NOT NULL AND date BETWEEN '2024-01-01' AND '2024-01-31' GROUP BY ALL
)"""
_STATUS = "CASE WHEN p_partkey % 2 = 0 THEN '自营商品' ELSE '第三方商品' END"
_JOIN = f"WITH {_ACTIONS}, {_USERS}, {_ALL} SELECT user_id, session_id, step_length, age, city FROM all_sessions JOIN users USING (user_id)"

ORACLE_SQL = {
    "actions_in_range": f"WITH {_ACTIONS} SELECT * EXCLUDE (t) FROM actions WHERE date BETWEEN '2024-01-05' AND '2024-01-20'",
    "user_info": f"WITH {_USERS} SELECT * FROM users",
    "product_info": f"SELECT p_partkey AS product_id, p_name AS product_name, '{{\"product_status\": ' || (p_partkey % 2) || '}}' AS extend_info, {_STATUS} AS product_status FROM part",
    "city_info": f"WITH {_CITIES} SELECT *, {_LEVEL} AS area_level FROM cities",
    "session_aggregates": f"WITH {_ACTIONS}, {_ALL} SELECT * FROM all_sessions",
    "session_filter": f"WITH {_FILTERED} SELECT * FROM sessions",
    "session_histogram": f"WITH {_ACTIONS}, {_ALL} SELECT count(*) AS session_count, {', '.join(f'{e} AS {n}' for n, e in _COUNTS)} FROM all_sessions",
    "session_aggr_stat": f"WITH {_FILTERED} SELECT CAST(1 AS BIGINT) AS task_id, count(*) AS session_count, {', '.join(f'floor({e} / CAST(nullif(count(*), 0) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS {n}_ratio' for n, e in _COUNTS)} FROM sessions",
    "observed_session_aggr_stat": f"WITH {_FILTERED} SELECT CAST(1 AS BIGINT) AS task_id, count(*) AS session_count, {', '.join(f'floor({e} / CAST(nullif(count(*), 0) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS {n}_ratio' for n, e in _COUNTS)} FROM sessions",
    "sessions_per_hour": f"WITH {_SAMPLE} SELECT * FROM hours",
    "session_sample_quotas": f"WITH {_SAMPLE} SELECT * FROM quotas",
    "session_random_extract": f"WITH {_SAMPLE} SELECT CAST(1 AS BIGINT) AS task_id, * FROM drawn",
    "session_random_extract_detail": f"WITH {_SAMPLE} SELECT {_DETAIL_COLUMNS} FROM actions WHERE date BETWEEN '2024-01-01' AND '2024-01-31' AND session_id IN (SELECT session_id FROM drawn)",
    "session_detail": f"WITH {_DETAIL} SELECT * FROM detail",
    "bucketed_session_detail": f"WITH {_DETAIL} SELECT * FROM detail",
    "bloom_session_detail": f"WITH {_DETAIL} SELECT * FROM detail",
    "heavy_hitters": f"WITH {_ACTIONS} SELECT user_id, count(*) AS n FROM actions WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 0.002 * (SELECT count(user_id) FROM actions)",
    "category_counts": f"WITH {_DETAIL} SELECT * FROM counts",
    "top10_category": f"WITH {_DETAIL} SELECT CAST(1 AS BIGINT) AS task_id, * FROM top_categories",
    "top10_session": f"WITH {_DETAIL} SELECT CAST(1 AS BIGINT) AS task_id, * FROM top_sessions",
    "top10_session_detail": f"WITH {_DETAIL} SELECT {_DETAIL_COLUMNS} FROM detail WHERE session_id IN (SELECT session_id FROM top_sessions)",
    "page_slice_counts": f"WITH {_ACTIONS}, {_PAIRS} SELECT page_split, pv FROM pv WHERE pv > 0",
    "page_start_pv": f"WITH {_ACTIONS} SELECT count(*) AS pv FROM actions WHERE page_id = 1",
    "page_split_convert_rate": f"WITH {_ACTIONS}, {_PAIRS} SELECT step, page_split, pv, base, floor(pv / CAST(nullif(base, 0) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS convert_rate FROM rates",
    "page_convert_rate_text": f"WITH {_ACTIONS}, {_PAIRS} SELECT CAST(1 AS BIGINT) AS task_id, string_agg(page_split || '=' || coalesce(printf('%.2f', floor(pv / CAST(nullif(base, 0) AS DOUBLE) * 100.0 + 0.5) / 100.0), 'null'), '|' ORDER BY step) AS convert_rate FROM rates",
    "area_product_clicks": f"WITH {_AREA} SELECT * FROM area_clicks",
    "area_top3_product": f"WITH {_AREA} SELECT CAST(1 AS BIGINT) AS task_id, area, {_LEVEL} AS area_level, product_id, city_infos, click_count, product_name, product_status FROM (SELECT *, p_name AS product_name, {_STATUS} AS product_status, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS r FROM area_clicks JOIN part ON product_id = p_partkey) AS x WHERE r <= 3",
    "ad_log": f"WITH {_ALLOWED} SELECT * FROM clicks",
    "ad_user_click_count": f"WITH {_ALLOWED} SELECT * FROM user_clicks",
    "ad_blacklist": f"WITH {_ALLOWED} SELECT * FROM blacklist",
    "ad_stat": f"WITH {_ALLOWED} SELECT * FROM stat",
    "ad_province_count": f"WITH {_ALLOWED} SELECT * FROM by_province",
    "ad_province_top3": f"WITH {_ALLOWED} SELECT * FROM top",
    "ad_click_trend": f"WITH {_ALLOWED} {_TREND}",
    "stream_ad_blacklist": f"WITH {_REPLAY} SELECT user_id FROM blacklist",
    "stream_ad_user_click_count": f"WITH {_REPLAY} SELECT date, user_id, ad_id, count(*) AS click_count FROM allowed GROUP BY ALL",
    "stream_ad_stat": f"WITH {_REPLAY} SELECT * FROM stat",
    "stream_ad_province_top3": f"WITH {_REPLAY} SELECT * FROM top",
    "stream_ad_click_trend": f"WITH {_REPLAY} {_TREND}",
    "ad_trend_intervals": f"WITH {_EVERY}, {_INTERVALS.format(clicks='clicks')}",
    "stream_trend_intervals": f"WITH {_EVERY}, passed AS (SELECT * FROM clicks WHERE time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND <= (SELECT max(ts) FROM clicks) - INTERVAL 1 HOUR), {_INTERVALS.format(clicks='passed')}",
    "scalar_functions": f"""WITH {_ACTIONS} SELECT event_id,
      search_keyword IS NULL OR search_keyword = '' AS no_keyword, coalesce(order_category_ids, '') AS trimmed, '0' || page_id AS two_digits, CAST(page_id AS VARCHAR) AS page,
      CAST(NULL AS VARCHAR) AS empty_field, CAST(NULL AS VARCHAR) AS bad_field, 'session=' || session_id || '|page=x|empty=|bad=1=2' AS changed,
      action_time < '2024-01-10 00:00:00' AS is_before, false AS is_after, CAST(epoch(t) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS seconds, strftime(t, '%Y-%m-%d_%H') AS date_hour,
      strftime(t, '%Y%m%d') AS date_key, date AS parsed_key, strftime(t, '%Y%m%d%H%M') AS minute_key, date AS key_date, strftime(t, '%H') AS key_hour, strftime(t, '%M') AS key_minute,
      floor(page_id / CAST(nullif(city_id, 0) AS DOUBLE) * 100.0 + 0.5) / 100.0 AS rounded, coalesce(CAST(click_category_id AS VARCHAR), 'null') || ':' || coalesce(search_keyword, 'null') AS joined
      FROM actions""",
    "category_ids_distinct": f"WITH {_DETAIL} SELECT DISTINCT category_id FROM hits",
    "join_broadcast": _JOIN,
    "join_salted": _JOIN,
    "join_split_skew": _JOIN,
    "two_stage_count": f"WITH {_DETAIL} SELECT click_category_id, count(*) AS click_count FROM detail WHERE click_category_id IS NOT NULL GROUP BY ALL",
    "customer_grades": """SELECT user_id, class, grade, CASE WHEN grade >= 90 THEN 'A' WHEN grade >= 80 THEN 'B' WHEN grade >= 70 THEN 'C' ELSE 'D' END AS level, CASE WHEN grade >= 80 THEN 'GOOD' ELSE 'BAD' END AS verdict,
      CAST(row_number() OVER (PARTITION BY class ORDER BY grade DESC, user_id) AS INTEGER) AS rank FROM (SELECT c_custkey AS user_id, c_nationkey AS class, CAST(floor(c_acctbal / 100) AS BIGINT) AS grade FROM customer) AS c""",
    "skew_sample": f"WITH {_ACTIONS}, {_ALL} SELECT user_id, count(*) AS n FROM all_sessions WHERE substr(md5('9:' || session_id), 1, 4) < '1999' AND user_id IS NOT NULL GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "task_session_filter": f"WITH {_ACTIONS}, {_USERS}, {_SESSIONS.format(where="WHERE date BETWEEN '2024-01-05' AND '2024-01-25'")} SELECT s.*, age, professional, city, sex FROM all_sessions AS s JOIN users USING (user_id) WHERE age BETWEEN 10 AND 50 AND city = (SELECT n_name FROM nation WHERE n_nationkey = 11)",
    "json_items": "SELECT p_partkey AS product_id, p_name AS name, CAST(NULL AS VARCHAR) AS beyond FROM part",
    "date_functions": f"WITH {_ACTIONS} SELECT event_id, strftime(t, '%Y-%m-%d') AS date_text, strftime(t, '%Y-%m-%d %H:%M:%S') AS time_text, CAST(1 AS INTEGER) AS days FROM actions",
    "session_filter_all": f"""WITH {_ACTIONS}, {_USERS}, {_ALL} SELECT s.*, age, professional, city, sex FROM all_sessions AS s JOIN users USING (user_id)
      WHERE professional IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND city IN (SELECT DISTINCT city FROM users ORDER BY city LIMIT 15)
      AND list_has_any(string_split(click_category_ids, ','), list_transform(range(60), lambda x: CAST(x AS VARCHAR)))""",
    "ad_blacklist_100": f"WITH {_ALLOWED} SELECT DISTINCT user_id FROM user_clicks WHERE click_count * 40 >= 100",
    "ad_sliding_trend": f"""WITH {_ALLOWED}, starts AS (
      SELECT time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(10 * unnest(range(6))) AS window_start, date_trunc('minute', ts) AS minute, ad_id FROM clicks
    ) SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, minute, ad_id, count(*) AS click_count FROM starts GROUP BY ALL""",
    "store_latest": f"WITH {_EVERY} SELECT date, ad_id, CAST(sum(click_count) * CASE WHEN ad_id < 5 THEN 10 ELSE 1 END AS BIGINT) AS click_count FROM stat GROUP BY date, ad_id",
    "append_twice": "SELECT p_partkey AS product_id, p_name AS product_name FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 3 = 0",
}
