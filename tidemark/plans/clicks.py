"""Queries over the clickstream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import clicks
from tidemark.sources import standin
from tidemark.sources.standin import CLICKS_AS_OF as NOW
from tidemark.sources.standin import VIEWS_SQL

QUERIES, ORACLE_SQL = {}, {}
_NOW = f"TIMESTAMP '{NOW}'"
_BASE = f"""WITH {VIEWS_SQL}, h24 AS (SELECT *, coalesce(kind = 'page' OR event = 'nav', false) AS is_view FROM page_views WHERE ts >= {_NOW} - INTERVAL 24 HOUR AND ts <= {_NOW}),
    today AS (SELECT *, coalesce(kind = 'page' OR event = 'nav', false) AS is_view FROM page_views WHERE ts >= date_trunc('day', {_NOW}) AND ts <= {_NOW}),
    shown AS (SELECT * FROM h24 WHERE NOT bot)"""


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: query(standin.page_views(spark, sf_dir))
    if sql:
        ORACLE_SQL[name] = f"{_BASE} {sql}"


# the whole month for sessions, so that the result is not a handful of rows
_SESSIONS = """, human AS (SELECT visitor, ts, event_id FROM page_views WHERE coalesce(kind = 'page' OR event = 'nav', false) AND NOT bot),
    opened AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS opens FROM human WINDOW w AS (PARTITION BY visitor ORDER BY ts, event_id)),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY visitor ORDER BY ts, event_id) AS session FROM opened),
    session AS (SELECT visitor, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS pages FROM numbered GROUP BY ALL)"""
register("c8_sessions", clicks.sessions, _SESSIONS + " SELECT * FROM session")
register("c8_session_totals", clicks.session_totals, _SESSIONS + " SELECT count(*) AS sessions, count(*) FILTER (WHERE pages = 1) AS bounced, round(avg(pages), 1) AS pages_per_session FROM session")
register("c7_last_day", lambda v: clicks.last_day(v, NOW).select("event_id", "kind", "bot"), "SELECT event_id, kind, bot FROM h24")
register("c7_today", lambda v: clicks.today(v, NOW).select("event_id", "kind", "bot"), "SELECT event_id, kind, bot FROM today")
register("c9_timeline", lambda v: clicks.timeline(v, NOW), f"""SELECT CAST(b AS INTEGER) AS bucket, count(event_id) FILTER (WHERE NOT bot) AS humans, count(event_id) FILTER (WHERE bot) AS bots
    FROM range(24) t(b) LEFT JOIN (SELECT *, least(23, date_diff('second', {_NOW} - INTERVAL 24 HOUR, ts) // 3600) AS hour FROM h24 WHERE is_view) ON hour = b GROUP BY b""")
register("c10_consumers", lambda v: clicks.consumers(v, NOW), """SELECT CASE WHEN bot THEN browser ELSE 'visitor ' || left(visitor, 6) END AS who, arg_min_null(country, (ts, event_id)) AS country, count(*) AS requests,
    CAST(sum(bytes) AS BIGINT) AS bytes, arg_min(bot, (ts, event_id)) AS bot FROM h24 WHERE kind <> 'event' GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 10""")
register("c11_kpis", lambda v: clicks.kpis(v, NOW), _SESSIONS.replace("FROM page_views WHERE coalesce", "FROM h24 WHERE coalesce") + """,
    times AS (SELECT list(ms ORDER BY ms) AS x FROM h24 WHERE kind <> 'event')
    SELECT (SELECT count(*) FROM shown WHERE is_view) AS views_24h, (SELECT count(DISTINCT visitor) FROM shown WHERE is_view) AS uniques_24h, (SELECT count(*) FROM h24 WHERE is_view AND NOT bot) AS human_views_24h,
           (SELECT count(*) FROM h24 WHERE bot AND kind <> 'event') AS bot_hits_24h, (SELECT CAST(coalesce(round(avg(ms)), 0) AS BIGINT) FROM h24 WHERE kind <> 'event') AS avg_ms,
           (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM h24 WHERE kind <> 'event') AS bytes_24h, (SELECT count(*) FROM shown WHERE event = 'nav') AS spa_navigations,
           (SELECT count(*) FROM shown WHERE kind = 'event' OR event IS NOT NULL) AS interactions, (SELECT count(*) FROM h24 WHERE kind = 'crawl') AS crawler_fetches,
           (SELECT count(*) FROM shown WHERE event = 'job_click' AND regexp_matches(detail, '^[0-9]+$')) AS job_clicks, (SELECT count(*) FROM shown WHERE event = 'search') AS searches,
           (SELECT count(*) FROM today WHERE is_view AND NOT bot) AS views_today, (SELECT count(DISTINCT visitor) FROM today WHERE is_view AND NOT bot) AS uniques_today,
           (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM today WHERE kind <> 'event') AS bytes_today, (SELECT coalesce(x[CAST(floor(len(x) * 0.95) AS BIGINT) + 1], 0) FROM times) AS p95_ms,
           (SELECT round(count(*) FILTER (WHERE pages = 1) / count(*), 3) FROM session) AS bounce_rate, (SELECT coalesce(round(avg(pages), 1), 0) FROM session) AS pages_per_session,
           (SELECT CAST(coalesce(round(sum(bytes) / nullif(count(DISTINCT visitor), 0)), 0) AS BIGINT) FROM h24 WHERE kind <> 'event') AS bytes_per_visitor""")
_LISTS = {
    "top_pages": ("shown", "path", "is_view AND kind = 'page'", 10), "top_api": ("shown", "path", "kind = 'api'", 10), "referrers": ("shown", "referrer", "referrer IS NOT NULL", 10),
    "countries": ("shown", "country", "kind <> 'event' AND country IS NOT NULL", 10), "os": ("shown", "os", "kind <> 'event'", 10), "browsers": ("shown", "browser", "kind <> 'event'", 10),
    "devices": ("h24", "device", "kind <> 'event'", 10), "bots": ("h24", "browser", "kind <> 'event' AND bot", 10), "statuses": ("shown", "status", "kind <> 'event'", 10),
    "searches": ("shown", "detail", "event = 'search' AND detail IS NOT NULL", 15), "events": ("shown", "event", "event IS NOT NULL AND event NOT IN ('nav', 'search')", 12),
}
register("c12_top_lists", lambda v: clicks.top_lists(v, NOW), " UNION ALL ".join(
    f"SELECT '{name}' AS list, key, hits FROM (SELECT CAST({key} AS VARCHAR) AS key, count(*) AS hits FROM {of} WHERE {where} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT {n}) WHERE key <> ''" for name, (of, key, where, n) in _LISTS.items()))
register("c14_recent", lambda v: clicks.recent(v, NOW), """SELECT event_id, ts, path, status, ms, bytes, referrer, country, browser, device, left(visitor, 6) AS visitor, event
    FROM (SELECT * FROM h24 WHERE kind IN ('page', 'event', 'crawl') ORDER BY ts DESC, event_id DESC LIMIT 25) WHERE NOT bot ORDER BY ts DESC, event_id DESC LIMIT 20""")
_ROLLUP = """, finished AS (SELECT *, CAST(ts AS DATE) AS day FROM page_views WHERE kind <> 'event' AND CAST(ts AS DATE) BETWEEN DATE '{first}' AND DATE '{last}'),
    keyed AS (SELECT day, 'country' AS dim, country AS key FROM finished WHERE NOT bot UNION ALL SELECT day, 'referrer', referrer FROM finished WHERE NOT bot UNION ALL SELECT day, 'page', path FROM finished WHERE NOT bot AND kind = 'page'),
    counted AS (SELECT day, dim, key, count(*) AS hits FROM keyed WHERE key <> '' GROUP BY day, dim, key QUALIFY row_number() OVER (PARTITION BY day, dim ORDER BY count(*) DESC, key) <= 200),
    daily AS (SELECT day, 'total' AS dim, 'all' AS key, count(*) AS hits, count(*) FILTER (WHERE NOT bot) AS humans, count(DISTINCT visitor) FILTER (WHERE NOT bot) AS uniques FROM finished GROUP BY day
              UNION ALL SELECT day, dim, left(key, 200), hits, hits, 0 FROM counted)"""
_MONTH = _ROLLUP.format(first="2024-01-01", last="2024-01-29")
register("r1_rollup", lambda v: clicks.rollup(v, "2024-01-01", "2024-01-29"), _MONTH + " SELECT * FROM daily")
register("r2_nightly", lambda v: clicks.rollup(v, "2024-01-28", "2024-01-29"), _ROLLUP.format(first="2024-01-28", last="2024-01-29") + " SELECT * FROM daily")
register("r2_retained", lambda v: clicks.retained(v, NOW).select("event_id"), f"SELECT event_id FROM page_views WHERE ts >= {_NOW} - INTERVAL 90 DAY AND (kind <> 'api' OR ts >= {_NOW} - INTERVAL 14 DAY)")
register("r3_forget_visitor", lambda v: clicks.forget_visitor(v, "00000007", NOW).select("event_id"), f"SELECT event_id FROM page_views WHERE NOT (visitor = '00000007' AND ts >= date_trunc('day', {_NOW}))")
register("r4_rate_breaches", lambda v: clicks.rate_breaches(v, 1), "SELECT visitor, date_trunc('minute', ts) AS minute, count(*) AS hits FROM page_views GROUP BY 1, 2 HAVING count(*) > 1")
register("r4_sliding_peaks", lambda v: clicks.sliding_counts(v), ", a AS (SELECT visitor, epoch(date_trunc('second', ts)) AS s FROM page_views), b AS (SELECT visitor, count(*) OVER (PARTITION BY visitor ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hits FROM a) SELECT visitor, max(hits) AS peak FROM b GROUP BY visitor")
register("c15_all_time", lambda v: clicks.all_time(clicks.rollup(v, "2024-01-01", "2024-01-29"), v, NOW), _MONTH + f""", live AS (SELECT * FROM today WHERE kind <> 'event'),
    one AS (SELECT CAST((SELECT coalesce(sum(hits), 0) FROM daily WHERE dim = 'total') + (SELECT count(*) FROM live) AS BIGINT) AS h,
           CAST((SELECT coalesce(sum(humans), 0) FROM daily WHERE dim = 'total') + (SELECT count(*) FROM live WHERE NOT bot) AS BIGINT) AS p,
           CAST((SELECT coalesce(sum(uniques), 0) FROM daily WHERE dim = 'total') + (SELECT count(DISTINCT visitor) FROM live WHERE NOT bot) AS BIGINT) AS u, (SELECT min(day) FROM daily) AS s,
           (SELECT count(DISTINCT key) FROM (SELECT key FROM daily WHERE dim = 'country' UNION SELECT country FROM live WHERE NOT bot)) AS c), two AS (SELECT *, date_diff('day', s, CAST({_NOW} AS DATE)) + 1 AS d FROM one)
    SELECT h AS hits, p AS humans, h - p AS bots, u AS uniques, s AS since, d AS days, c AS countries, CAST(round(p / d) AS BIGINT) AS avg_daily_humans FROM two""")
register("c15_daily_series", lambda v: clicks.daily_series(clicks.rollup(v, "2024-01-01", "2024-01-29"), v, NOW), _MONTH + f""", stored AS (SELECT day, hits, humans, uniques FROM daily WHERE dim = 'total'
        UNION ALL SELECT CAST({_NOW} AS DATE), count(*), count(*) FILTER (WHERE NOT bot), count(DISTINCT visitor) FILTER (WHERE NOT bot) FROM today WHERE kind <> 'event')
    SELECT CAST({_NOW} AS DATE) - CAST(i AS INTEGER) AS day, coalesce(humans, 0) AS humans, coalesce(hits - humans, 0) AS bots, coalesce(uniques, 0) AS uniques FROM range(14) t(i) LEFT JOIN stored ON day = CAST({_NOW} AS DATE) - CAST(i AS INTEGER)""")


def _job_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks carry small numbers here, which name suppliers' parts in place of postings."""
    parts = standin.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("company"), F.col("p_name").alias("title"))
    return clicks.job_clicks(standin.page_views(spark, sf_dir), parts, NOW)


QUERIES["c13_job_clicks"] = _job_clicks
ORACLE_SQL["c13_job_clicks"] = f"""{_BASE}, hit AS (SELECT p_brand AS company, p_name AS title FROM shown JOIN part ON p_partkey = CAST(detail AS BIGINT) WHERE event = 'job_click' AND regexp_matches(detail, '^[0-9]+$'))
    SELECT * FROM (SELECT 'employer' AS list, company AS key, count(*) AS hits FROM hit GROUP BY company ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'job' AS list, title || ' · ' || company AS key, count(*) AS hits FROM hit GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"""
