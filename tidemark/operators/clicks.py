"""Clickstream reports over page views: sessions, timelines, top lists, daily roll-ups and retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SESSION_GAP_MINUTES = 30
ROLLUP_TOP = 200
RAW_DAYS, API_DAYS = 90, 14


def _at(now: str, hours: int = 0) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(hours)} hours")


def is_view() -> Column:
    return F.coalesce((F.col("kind") == "page") | (F.col("event") == "nav"), F.lit(False))


def last_day(views: DataFrame, now: str) -> DataFrame:
    return views.where((F.col("ts") >= _at(now, 24)) & (F.col("ts") <= _at(now)))


def today(views: DataFrame, now: str) -> DataFrame:
    return views.where((F.col("ts") >= F.date_trunc("day", _at(now)).cast("timestamp_ntz")) & (F.col("ts") <= _at(now)))


def sessions(views: DataFrame, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """visitor, session, started, ended, pages of human views; a gap of more than the limit opens a new session."""
    mine = Window.partitionBy("visitor").orderBy("ts", "event_id")
    human = views.where(is_view() & ~F.col("bot")).select("visitor", "ts", "event_id")
    before = F.lag("ts").over(mine)
    opens = F.when(before.isNull() | (F.col("ts") > before + F.expr(f"interval {gap_minutes} minutes")), 1).otherwise(0)
    numbered = human.withColumn("opens", opens).withColumn("session", F.sum("opens").over(mine))
    return numbered.groupBy("visitor", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("pages"))


def session_totals(views: DataFrame) -> DataFrame:
    return sessions(views).agg(F.count(F.lit(1)).alias("sessions"), F.count_if(F.col("pages") == 1).alias("bounced"), F.round(F.avg("pages"), 1).alias("pages_per_session"))


def timeline(views: DataFrame, now: str) -> DataFrame:
    """24 hourly buckets back from ``now``, people and bots apart, empty hours as 0."""
    seconds = F.timestamp_diff("SECOND", _at(now, 24), F.col("ts"))
    hour = F.least(F.lit(23), F.floor(seconds / 3600)).cast("int")
    counted = last_day(views, now).where(is_view()).groupBy(hour.alias("bucket")).agg(F.count_if(~F.col("bot")).alias("humans"), F.count_if("bot").alias("bots"))
    every = views.sparkSession.range(24).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("humans", F.lit(0)).alias("humans"), F.coalesce("bots", F.lit(0)).alias("bots"))


def consumers(views: DataFrame, now: str, top: int = 10) -> DataFrame:
    served = last_day(views, now).where("kind <> 'event'")
    who = F.when(F.col("bot"), F.col("browser")).otherwise(F.concat(F.lit("visitor "), F.substring("visitor", 1, 6)))
    first = F.min_by("country", F.struct("ts", "event_id"))
    found = served.groupBy(who.alias("who")).agg(first.alias("country"), F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"), F.min_by("bot", F.struct("ts", "event_id")).alias("bot"))
    return found.orderBy(F.desc("bytes"), "who").limit(top)


def kpis(views: DataFrame, now: str, include_bots: bool = False) -> DataFrame:
    """One row. The 95th percentile is the value at index floor(0.95 n) of the sorted times, found by counts per time."""
    h24, day = last_day(views, now), today(views, now)
    shown = F.lit(True) if include_bots else ~F.col("bot")
    served = F.col("kind") != "event"
    clicked = F.col("event").eqNullSafe("job_click") & F.col("detail").rlike("^[0-9]+$")
    a = h24.agg(
        F.count_if(is_view() & shown).alias("views_24h"),
        F.count_distinct(F.when(is_view() & shown, F.col("visitor"))).alias("uniques_24h"),
        F.count_if(is_view() & ~F.col("bot")).alias("human_views_24h"),
        F.count_if(F.col("bot") & served).alias("bot_hits_24h"),
        F.coalesce(F.round(F.avg(F.when(served, F.col("ms")))), F.lit(0.0)).cast("long").alias("avg_ms"),
        F.coalesce(F.sum(F.when(served, F.col("bytes"))), F.lit(0)).alias("bytes_24h"),
        F.count_distinct(F.when(served, F.col("visitor"))).alias("_visitors"),
        F.count_if((F.col("event") == "nav") & shown).alias("spa_navigations"),
        F.count_if(((F.col("kind") == "event") | F.col("event").isNotNull()) & shown).alias("interactions"),
        F.count_if(F.col("kind") == "crawl").alias("crawler_fetches"),
        F.count_if(clicked & shown).alias("job_clicks"),
        F.count_if((F.col("event") == "search") & shown).alias("searches"),
    )
    b = day.agg(
        F.count_if(is_view() & shown).alias("views_today"),
        F.count_distinct(F.when(is_view() & shown, F.col("visitor"))).alias("uniques_today"),
        F.coalesce(F.sum(F.when(served, F.col("bytes"))), F.lit(0)).alias("bytes_today"),
    )
    times = h24.where(served).groupBy("ms").agg(F.count(F.lit(1)).alias("n"))
    upto = times.select("ms", F.sum("n").over(Window.orderBy("ms")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))  # distinct times only
    c = upto.agg(F.coalesce(F.min(F.when(F.col("upto") > F.floor(F.col("total") * 0.95), F.col("ms"))), F.lit(0)).alias("p95_ms"))
    s = session_totals(h24).select(F.round(F.col("bounced") / F.col("sessions"), 3).alias("bounce_rate"), F.coalesce("pages_per_session", F.lit(0.0)).alias("pages_per_session"))
    one = reduce(DataFrame.crossJoin, [a, b, c, s])  # single rows
    per = F.when(F.col("_visitors") > 0, F.round(F.col("bytes_24h") / F.col("_visitors"))).otherwise(0.0).cast("long")
    return one.withColumn("bytes_per_visitor", per).drop("_visitors")


def top_list(rows: DataFrame, key: str, top: int = 10) -> DataFrame:
    """The commonest values; an empty one takes its place before it is dropped."""
    counted = rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("hits"))
    return counted.orderBy(F.desc("hits"), F.asc_nulls_first("key")).limit(top).where("key is not null and key <> ''")


def top_lists(views: DataFrame, now: str, include_bots: bool = False) -> DataFrame:
    """list, key, hits for every top list of the dashboard."""
    h24 = last_day(views, now)
    shown = h24 if include_bots else h24.where("not bot")
    served = "kind <> 'event'"
    lists = {
        "top_pages": (shown.where(is_view() & (F.col("kind") == "page")), "path", 10),
        "top_api": (shown.where("kind = 'api'"), "path", 10),
        "referrers": (shown.where("referrer is not null"), "referrer", 10),
        "countries": (shown.where(f"{served} and country is not null"), "country", 10),
        "os": (shown.where(served), "os", 10),
        "browsers": (shown.where(served), "browser", 10),
        "devices": (h24.where(served), "device", 10),
        "bots": (h24.where(f"{served} and bot"), "browser", 10),
        "statuses": (shown.where(served), "status", 10),
        "searches": (shown.where("event = 'search' and detail is not null"), "detail", 15),
        "events": (shown.where("event is not null and event not in ('nav', 'search')"), "event", 12),
    }
    return reduce(DataFrame.unionByName, [top_list(rows, key, n).select(F.lit(name).alias("list"), "key", "hits") for name, (rows, key, n) in lists.items()])


def job_clicks(views: DataFrame, postings: DataFrame, now: str, top: int = 10) -> DataFrame:
    """list, key, hits: clicked employers and jobs of the last day; clicks on unknown postings do not count."""
    clicks = last_day(views, now).where("not bot and event = 'job_click' and detail rlike '^[0-9]+$'").select(F.col("detail").cast("long").alias("id"))
    joined = clicks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(postings.select("id", "company", "title"), "id")
    best = lambda key: joined.groupBy(key.alias("key")).agg(F.sum("n").alias("hits")).orderBy(F.desc("hits"), "key").limit(top)
    employer, job = best(F.col("company")), best(F.concat_ws(" · ", "title", "company"))
    return employer.select(F.lit("employer").alias("list"), "key", "hits").unionByName(job.select(F.lit("job").alias("list"), "key", "hits"))


def recent(views: DataFrame, now: str, include_bots: bool = False, window: int = 25, top: int = 20) -> DataFrame:
    """The newest hits of the last day: the last 25 are taken first, then bots go, then 20 are shown."""
    last = last_day(views, now).where("kind in ('page', 'event', 'crawl')").orderBy(F.desc("ts"), F.desc("event_id")).limit(window)
    shown = last if include_bots else last.where("not bot")
    return shown.orderBy(F.desc("ts"), F.desc("event_id")).limit(top).select("event_id", "ts", "path", "status", "ms", "bytes", "referrer", "country", "browser", "device", F.substring("visitor", 1, 6).alias("visitor"), "event")


def rollup(views: DataFrame, first_day: str, last_day: str, top: int = ROLLUP_TOP) -> DataFrame:
    """day, dim, key, hits, humans, uniques for each finished day of the range: the total, and people by country, referrer and page.

    One pass over the views, each stacked into a row per dimension; a day without hits gives no rows. Written by overwriting the days'
    partitions, so running it again changes nothing.
    """
    rows = views.where("kind <> 'event'").withColumn("day", F.to_date("ts")).where(F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
    total = rows.groupBy("day").agg(F.count(F.lit(1)).alias("hits"), F.count_if(~F.col("bot")).alias("humans"), F.count_distinct(F.when(~F.col("bot"), F.col("visitor"))).alias("uniques"))
    total = total.select("day", F.lit("total").alias("dim"), F.lit("all").alias("key"), "hits", "humans", F.col("uniques").alias("uniques"))
    keyed = rows.where("not bot").select("day", F.expr("stack(3, 'country', country, 'referrer', referrer, 'page', case when kind = 'page' then path end) as (dim, key)")).where("key is not null and key <> ''")
    counted = keyed.groupBy("day", "dim", "key").agg(F.count(F.lit(1)).alias("hits"))
    nth = F.row_number().over(Window.partitionBy("day", "dim").orderBy(F.desc("hits"), "key"))
    best = counted.withColumn("nth", nth).where(F.col("nth") <= top)
    return total.unionByName(best.select("day", "dim", F.left("key", F.lit(200)).alias("key"), "hits", F.col("hits").alias("humans"), F.lit(0).cast("long").alias("uniques")))


def all_time(daily: DataFrame, views: DataFrame, now: str) -> DataFrame:
    """One row: the rolled-up totals with today's rows on top, and the mean of people a day since the first day."""
    live = today(views, now).where("kind <> 'event'")
    a = daily.where("dim = 'total'").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("h"), F.coalesce(F.sum("humans"), F.lit(0)).alias("p"), F.coalesce(F.sum("uniques"), F.lit(0)).alias("u"), F.min("day").alias("since"))
    b = live.agg(F.count(F.lit(1)).alias("lh"), F.count_if(~F.col("bot")).alias("lp"), F.count_distinct(F.when(~F.col("bot"), F.col("visitor"))).alias("lu"))
    countries = daily.where("dim = 'country'").select("key").unionByName(live.where("not bot and country is not null").select(F.col("country").alias("key"))).agg(F.count_distinct("key").alias("countries"))
    day = F.to_date(_at(now))
    one = a.crossJoin(b).crossJoin(countries).withColumn("since", F.coalesce("since", day))
    days = F.datediff(day, F.col("since")) + 1
    hits, humans = F.col("h") + F.col("lh"), F.col("p") + F.col("lp")
    return one.select(hits.alias("hits"), humans.alias("humans"), (hits - humans).alias("bots"), (F.col("u") + F.col("lu")).alias("uniques"), "since", days.alias("days"), "countries", F.round(humans / days).cast("long").alias("avg_daily_humans"))


def daily_series(daily: DataFrame, views: DataFrame, now: str, days: int = 14) -> DataFrame:
    """The last days, today from the raw rows; days without a total are 0."""
    day = F.to_date(_at(now))
    every = views.sparkSession.range(days).select(F.date_sub(day, F.col("id").cast("int")).alias("day"))
    live = today(views, now).where("kind <> 'event'").agg(F.count(F.lit(1)).alias("hits"), F.count_if(~F.col("bot")).alias("humans"), F.count_distinct(F.when(~F.col("bot"), F.col("visitor"))).alias("uniques"))
    stored = daily.where("dim = 'total'").where(F.col("day") < day).select("day", "hits", "humans", "uniques").unionByName(live.select(day.alias("day"), "hits", "humans", "uniques"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.join(stored, "day", "left").select("day", zero("humans").alias("humans"), (zero("hits") - zero("humans")).alias("bots"), zero("uniques").alias("uniques"))


def retained(views: DataFrame, now: str) -> DataFrame:
    """Raw rows that are still kept: 90 days, API hits 14."""
    return views.where((F.col("ts") >= _at(now, 24 * RAW_DAYS)) & ((F.col("kind") != "api") | (F.col("ts") >= _at(now, 24 * API_DAYS))))


def forget_visitor(views: DataFrame, visitor: str, now: str) -> DataFrame:
    """All rows but today's of one visitor."""
    return views.where(~((F.col("visitor") == visitor) & (F.col("ts") >= F.date_trunc("day", _at(now)).cast("timestamp_ntz"))))


def rate_breaches(views: DataFrame, per_minute: int) -> DataFrame:
    """visitor, minute, hits of the minutes in which a visitor made more requests than allowed."""
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return views.groupBy("visitor", minute.alias("minute")).agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") > per_minute)


def sliding_counts(views: DataFrame, seconds: int = 3600) -> DataFrame:
    """Each visitor's largest number of hits within any window of so many seconds that ends at a hit."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    around = Window.partitionBy("visitor").orderBy("second").rangeBetween(-seconds, 0)
    return views.select("visitor", at.alias("second")).withColumn("hits", F.count(F.lit(1)).over(around)).groupBy("visitor").agg(F.max("hits").alias("peak"))
