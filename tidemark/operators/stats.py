"""Reports over the row view: demand, co-occurrence, breakdowns, trends, salaries, listings and matching.

Ties are settled by key (or id), so results do not depend on the order of the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at(as_of: str, days: int = 0) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")


def overview(postings: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """One row of counts. Companies and closed postings take duplicates in; the median is of hours from posting to first sight."""
    rows = postings.join(sources.select("source_id", "first_success_at"), "source_id")
    live, tech = F.col("closed_at").isNull() & F.col("duplicate_of").isNull(), F.col("is_tech")
    week, settled = _at(as_of, 7), F.col("first_success_at") + F.expr("interval 10 minutes")
    is_new = (F.col("posted_at") >= week) | (F.col("posted_at").isNull() & (F.col("first_seen") >= week) & (F.col("first_seen") > settled))
    fresh = (F.col("first_seen") >= _at(as_of, 14)) & (F.col("first_seen") > settled) & (F.col("first_seen") >= F.col("posted_at"))
    hours = F.timestamp_diff("SECOND", F.col("posted_at"), F.col("first_seen")) / 3600
    counts = rows.agg(
        F.count_if(live).alias("live_postings"),
        F.count_if(live & tech).alias("live_tech_postings"),
        F.count_distinct(F.when(F.col("closed_at").isNull() & tech, F.col("company"))).alias("companies"),
        F.count_if(live & tech & is_new).alias("new_last_7d"),
        F.count_if(tech & (F.col("closed_at") >= week)).alias("closed_last_7d"),
        F.round(F.median(F.when(fresh, hours)), 1).alias("freshness_median_hours"),
    )
    boards = sources.agg(
        F.count(F.lit(1)).alias("sources_total"),
        F.count_if("active").alias("sources_active"),
        F.count_if(F.col("last_status") == "ok").alias("sources_ok"),
        F.max(F.when(F.col("last_status") == "ok", F.col("last_run_at"))).alias("last_crawl_at"),
    )
    return counts.crossJoin(boards)  # two single rows


def skill_counts(rows: DataFrame, top: int = 40) -> DataFrame:
    """Skills by the number of postings that name them, with their share of all rows and how often they are required."""
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    named = rows.select(F.explode("skills").alias("skill"), "skills_required")
    counted = named.groupBy("skill").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("skills_required", F.col("skill"))).alias("required"))
    best = counted.orderBy(F.desc("n"), "skill").limit(top)
    return best.crossJoin(total).select("skill", F.col("n").alias("count"), F.round(F.col("n") / F.col("total"), 4).alias("share"), "required")


def cooccurrence(rows: DataFrame, top: int = 30, min_pair: int = 3, max_links: int = 200) -> DataFrame:
    """Pairs of the top skills within postings: weight, and lift over independence with n = all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    counts = skill_counts(rows, top).select("skill", F.col("count").alias("n"))
    names = counts.agg(F.collect_list("skill").alias("names"))  # at most ``top`` names
    kept = rows.crossJoin(names).select(F.array_sort(F.array_intersect("skills", "names")).alias("s"))
    pairs = kept.select("s", F.posexplode("s").alias("k", "source")).select("source", F.explode(F.expr("slice(s, k + 2, size(s))")).alias("target"))
    weight = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_pair)
    of = lambda side: counts.select(F.col("skill").alias(side), F.col("n").alias(f"n_{side}"))
    joined = weight.join(of("source"), "source").join(of("target"), "target").crossJoin(total)
    lift = F.round(F.col("weight") * F.col("total") / F.greatest(F.col("n_source") * F.col("n_target"), F.lit(1)), 2)
    return joined.select("source", "target", "weight", lift.alias("lift")).orderBy(F.desc("weight"), "source", "target").limit(max_links)


BREAKDOWN_KEYS = ("city", "company", "experience", "degree", "employees", "org_size", "ats", "sector", "position", "role_family", "seniority", "posting_language", "remote_policy", "degree_required")


def breakdown(rows: DataFrame, key: str, top: int = 20) -> DataFrame:
    if key not in BREAKDOWN_KEYS:
        raise ValueError(f"key must be one of {', '.join(BREAKDOWN_KEYS)}")
    if key == "city":
        value = F.coalesce("city", F.when(F.col("remote"), "Remote").otherwise("Unknown"))
    elif key == "employees":
        value = F.col("employee_band")
    else:
        value = F.coalesce(F.col(key).cast("string"), F.lit("unknown"))
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    counted = rows.groupBy(value.alias("key")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "key").limit(top)
    return counted.crossJoin(total).select("key", "count", F.round(F.col("count") / F.col("total"), 4).alias("share"))


def iso_week(ts: Column) -> Column:
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def trends(rows: DataFrame, as_of: str, skills: list[str] | None = None, weeks: int = 12, default_series: int = 5) -> DataFrame:
    """series, week, count: postings first seen per ISO week, in all and per skill; weeks without a skill count 0."""
    recent = rows.where(F.col("first_seen") >= _at(as_of, 7 * weeks)).select(iso_week(F.col("first_seen")).alias("week"), "skills")
    total = recent.groupBy("week").agg(F.count(F.lit(1)).alias("count"))
    named = recent.select("week", F.explode("skills").alias("series"))
    if skills is None:
        chosen = named.groupBy("series").count().orderBy(F.desc("count"), "series").limit(default_series).select("series")
    else:
        chosen = named.where(F.col("series").isin(skills)).select("series").distinct()
    by_skill = named.join(chosen, "series").groupBy("series", "week").agg(F.count(F.lit(1)).alias("count"))
    grid = total.select("week").crossJoin(chosen)  # weeks of the range times a few series
    filled = grid.join(by_skill, ["series", "week"], "left").select("series", "week", F.coalesce("count", F.lit(0)).alias("count"))
    return total.select(F.lit("total").alias("series"), "week", "count").unionByName(filled)


def salary(rows: DataFrame) -> DataFrame:
    """Quartiles of the middle of the stated range. From four values on by the exclusive method, at i * (n + 1) / 4.

    The order statistics come from one ranking over the values, not from a collected list.
    """
    low, high = F.col("salary_min_eur"), F.col("salary_max_eur")
    middle = F.when(high.isNotNull() & (high != 0), (low + high) / 2).otherwise(low.cast("double"))
    values = rows.where(low.isNotNull() & (low != 0)).groupBy(middle.alias("mid")).agg(F.count(F.lit(1)).alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.orderBy("mid").rowsBetween(Window.unboundedPreceding, 0)))  # distinct amounts only
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.min("mid").alias("low"), F.max("mid").alias("high"))
    ranked = upto.crossJoin(total)

    def value_at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col("mid")))

    out = []
    for i in (1, 2, 3):
        j = F.greatest(F.lit(1), F.least(F.floor(i * (F.col("total") + 1) / 4), F.col("total") - 1))
        d = i * (F.col("total") + 1) - 4 * j
        out.append((j, d))
    wide = ranked.agg(
        F.max("total").alias("n"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
        *(value_at(j).alias(f"a{i}") for i, (j, _) in enumerate(out, 1)),
        *(value_at(j + 1).alias(f"b{i}") for i, (j, _) in enumerate(out, 1)),
        *(F.max(d).alias(f"d{i}") for i, (_, d) in enumerate(out, 1)),
        value_at(F.floor(F.col("total") / 2) + 1).alias("third"),
    )
    exact = lambda i: (F.col(f"a{i}") * (4 - F.col(f"d{i}")) + F.col(f"b{i}") * F.col(f"d{i}")) / 4
    few = F.col("n") < 4
    pick = lambda i, small: F.bround(F.when(few, small).otherwise(exact(i))).cast("long")
    return wide.select(
        F.coalesce("n", F.lit(0)).alias("n"),
        pick(1, F.col("low")).alias("p25"),
        pick(2, F.col("third")).alias("median"),
        pick(3, F.col("high")).alias("p75"),
        F.bround("low").cast("long").alias("min"),
        F.bround("high").cast("long").alias("max"),
    )


def match_score(have: list[str]) -> Column:
    """Share of a posting's skills that the reader has, of three at least."""
    if not have:
        return F.lit(0.0)
    shared = F.size(F.array_intersect("skills", F.array(*map(F.lit, have))))
    return F.when(F.size("skills") == 0, 0.0).otherwise(shared / F.greatest(F.size("skills"), F.lit(3)))


def posting_page(rows: DataFrame, as_of: str, page: int = 1, size: int = 50, sort: str = "newest", have: list[str] | None = None) -> DataFrame:
    """One page of the listing, with a rank. Spark keeps page * size rows per task, never the whole order."""
    have = sorted(set(have or []))
    rows = rows.withColumn("score", match_score(have))
    newest = [F.desc("effective_at"), F.asc("id")]
    unknown = F.col("employees").isNull()
    if sort == "match" and have:
        order = [F.desc("score"), *newest]
    elif sort == "size_small":
        order = [unknown.asc(), F.coalesce("employees", F.lit(0)).asc(), F.asc("org_roles"), *newest]
    elif sort == "size_large":
        order = [unknown.asc(), F.coalesce("employees", F.lit(0)).desc(), F.desc("org_roles"), *newest]
    else:
        order = newest
    first = rows.orderBy(*order).limit(page * size)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    mine = F.array(*map(F.lit, have)) if have else F.array().cast("array<string>")
    nothing = F.array().cast("array<string>")
    return ranked.where(F.col("rank") > (page - 1) * size).select(
        "rank", "id", "title", "company", "city", "also_in", "remote", "url",
        F.to_date("effective_at").alias("posted_on"),
        "first_seen",
        F.col("closed_at").isNotNull().alias("is_closed"),
        F.col("role_family").alias("role"),
        "seniority",
        F.col("years_experience").alias("years"),
        "experience", "degree", "employees", "enrollment_required",
        F.slice("skills", 1, 12).alias("skills"),
        "english_only", "english_required",
        F.col("visa_sponsorship").alias("visa"),
        "remote_policy",
        F.col("salary_min_eur").alias("salary_min"),
        F.col("salary_max_eur").alias("salary_max"),
        "ats",
        (F.col("kind") == "agency").alias("via_agency"),
        "org_size", "confirmed_at", "link_checked_at", "link_status",
        F.col("kind").alias("source_kind"),
        "org_roles",
        F.greatest(F.lit(0), F.timestamp_diff("DAY", F.col("effective_at"), F.lit(as_of).cast("timestamp_ntz"))).alias("age_days"),
        (F.round("score", 2) if have else F.lit(None).cast("double")).alias("match"),
        (F.array_sort(F.array_intersect("skills", mine)) if have else nothing).alias("matched"),
        (F.slice(F.array_sort(F.array_except("skills", mine)), 1, 6) if have else nothing).alias("missing"),
    )


def gap_missing(rows: DataFrame, have: list[str], top: int = 15) -> DataFrame:
    """The skills most in demand that the reader lacks."""
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    demand = rows.select(F.explode("skills").alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("count"))
    lacking = demand.where(~F.col("skill").isin(list(have))) if have else demand
    return lacking.orderBy(F.desc("count"), "skill").limit(top).crossJoin(total).select("skill", "count", F.round(F.col("count") / F.col("total"), 4).alias("share"))


def gap_matches(rows: DataFrame, have: list[str], top: int = 20) -> DataFrame:
    """The postings that fit best: by score, then overlap, then id."""
    mine = F.array(*map(F.lit, sorted(set(have)))) if have else F.array().cast("array<string>")
    rows = rows.where(F.size("skills") > 0).withColumns({"score": match_score(list(have)), "overlap": F.size(F.array_intersect("skills", mine))})
    best = rows.orderBy(F.desc("score"), F.desc("overlap"), "id").limit(top)
    return best.select("id", "title", "company", "city", "url", F.round("score", 2).alias("match"), F.array_sort(F.array_intersect("skills", mine)).alias("matched"), F.array_sort(F.array_except("skills", mine)).alias("missing"))


def gap_coverage(rows: DataFrame, have: list[str]) -> DataFrame:
    """Share of all skill mentions that the reader's skills cover."""
    named = rows.select(F.explode("skills").alias("skill"))
    hit = F.count_if(F.col("skill").isin(list(have))) if have else F.lit(0)
    return named.agg(F.round(hit / F.greatest(F.count(F.lit(1)), F.lit(1)), 3).alias("demand_coverage"))


def open_roles(postings: DataFrame) -> DataFrame:
    return postings.where("closed_at is null and duplicate_of is null").groupBy("company").agg(F.count(F.lit(1)).alias("open_roles"))


def sources_by_kind(sources: DataFrame) -> DataFrame:
    return sources.groupBy(F.coalesce("kind", F.lit("employer")).alias("kind")).agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("last_status") == "ok").alias("healthy"))


def source_status(sources: DataFrame) -> DataFrame:
    return sources.groupBy(F.coalesce("last_status", F.lit("pending")).alias("status")).agg(F.count(F.lit(1)).alias("sources"))


def filter_options(rows: DataFrame, top: int = 50) -> DataFrame:
    """dimension, key, count: the commonest values of each filter over open rows."""
    live = rows.where("closed_at is null")
    parts = [live.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "key").limit(top).select(F.lit(c).alias("dimension"), "key", "count") for c in ("city", "company", "role_family", "seniority", "sector")]
    return reduce(DataFrame.unionByName, parts)
