"""Job-posting tables made from the star-schema test tables, so that every query has data to run on.

Orders stand for postings, nations for their boards, brands of the order's parts for skills, events for
page views. The same definitions are given as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-08-01 00:00:00"
CLICKS_AS_OF = "2024-01-30 18:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# column -> expression over orders o, customer c, nation n and the skills s; valid in Spark and DuckDB.
_POSTING = {
    "id": "o_orderkey",
    "source_id": "c_nationkey",
    "external_id": "concat('x', o_orderkey)",
    "company": "c_name",
    "title": "concat(o_orderpriority, ' engineer ', c_mktsegment)",
    "city": "CASE WHEN o_orderkey % 17 <> 0 THEN n_name END",
    "remote": "o_orderkey % 7 = 0",
    "url": "concat(CASE WHEN o_orderkey % 101 = 0 THEN 'ftp' ELSE 'https' END, '://jobs.example/en/job-', o_orderkey)",
    "posted_at": "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END",
    "closed": "o_orderstatus = 'F'",
    "is_tech": "o_orderkey % 10 <> 9",
    "duplicate_of": "CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey - 1 END",
    "description_length": "o_orderkey % 1000",
    "link_status": "CASE o_orderkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'gone' WHEN 2 THEN 'redirected' WHEN 3 THEN 'error' END",
    "role_family": "lower(c_mktsegment)",
    "seniority": "CASE WHEN o_orderkey % 23 = 0 THEN 'junior' WHEN o_orderkey % 19 = 0 THEN 'unknown' ELSE lower(substring(o_orderpriority, 3)) END",
    "years_experience": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 9 END",
    "degree_required": "CASE o_orderkey % 7 WHEN 0 THEN 'phd' WHEN 1 THEN 'msc' WHEN 2 THEN 'bsc' WHEN 3 THEN 'hbo' WHEN 4 THEN 'mbo' WHEN 5 THEN 'none' END",
    "posting_language": "CASE WHEN o_orderkey % 4 = 0 THEN 'nl' ELSE 'en' END",
    "dutch_required": "o_orderkey % 6 = 0",
    "english_only": "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 2 = 0 END",
    "english_required": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 = 0 END",
    "visa_sponsorship": "CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "enrollment_required": "CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false END",
    "remote_policy": "CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' ELSE 'unknown' END",
    "salary_min_eur": "CASE WHEN o_orderkey % 5 = 0 THEN CAST(floor(o_totalprice / 4) AS BIGINT) END",
    "salary_max_eur": "CASE WHEN o_orderkey % 10 = 0 THEN CAST(floor(o_totalprice / 3) AS BIGINT) END",
    "employees": "CASE WHEN c_custkey % 5 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) END",
}
# days after o_orderdate
_DAYS = {"first_seen": "o_orderkey % 5", "last_seen": "o_orderkey % 5 + o_orderkey % 60"}


def postings(spark: SparkSession, sf_dir: str, skills: bool = True) -> DataFrame:
    """Postings; without ``skills`` both lists of skills are empty and their tables are not read."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, customer.c_nationkey == nation.n_nationkey)
    if skills:
        named = _skills(spark, sf_dir)
        rows = rows.join(named, rows.o_orderkey == named.l_orderkey, "left")
    else:
        rows = rows.withColumns({c: F.lit(None).cast("array<string>") for c in ("skills_required", "skills_nice")})
    day = lambda days: F.expr(f"o_orderdate + make_dt_interval(cast({days} as int))")
    first, last = day(_DAYS["first_seen"]), day(_DAYS["last_seen"])
    empty = F.array().cast("array<string>")
    also = F.expr("CASE WHEN o_orderkey % 12 = 0 THEN array('NATION_3', 'NATION_8') END")
    return rows.select(
        *(F.expr(e).alias(c) for c, e in _POSTING.items()),
        first.alias("first_seen"),
        last.alias("last_seen"),
        F.when(F.expr(_POSTING["closed"]), last + F.expr("interval 1 day")).alias("closed_at"),
        F.when(F.expr("o_orderkey % 5 < 4"), last + F.expr("interval 3 days")).alias("link_checked_at"),
        F.coalesce("skills_required", empty).alias("skills_required"),
        F.coalesce("skills_nice", empty).alias("skills_nice"),
        also.alias("also_in"),
    )


def _skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    brands = lineitem.select("l_orderkey", "l_partkey", "l_linenumber").join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return brands.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("p_brand")))).alias("skills_required"),
        F.array_sort(F.collect_set(F.when(F.col("l_linenumber") > 3, F.col("p_brand")))).alias("skills_nice"),
    )


_SOURCE = {
    "source_id": "n_nationkey",
    "source_company": "n_name",
    "ats": "CASE n_nationkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'jsonld' END",
    "slug": "lower(n_name)",
    "kind": "CASE n_nationkey % 4 WHEN 0 THEN 'employer' WHEN 1 THEN 'agency' WHEN 2 THEN 'aggregator' END",
    "active": "n_nationkey % 6 <> 5",
    "last_status": "CASE n_nationkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'error' WHEN 3 THEN 'ok' END",
    "last_error": "CASE WHEN n_nationkey % 8 = 3 THEN 'unverified: check' END",
    "last_nl_count": "CASE WHEN n_nationkey % 5 <> 4 THEN n_nationkey % 4 * 10 END",
}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation")
    at = F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(cast(n_nationkey % 9 as int), cast(n_nationkey as int))")
    return rows.select(
        *(F.expr(e).alias(c) for c, e in _SOURCE.items()),
        F.when(F.expr("n_nationkey % 5 <> 4"), at).alias("last_run_at"),
        F.expr("timestamp_ntz'1995-03-01 00:00:00'").alias("first_success_at"),
    )


_VIEW = {
    "event_id": "event_id",
    "ts": "ts",
    "visitor": "lpad(cast(user_id as varchar(20)), 8, '0')",
    "kind": "CASE event_type WHEN 'view' THEN 'page' WHEN 'purchase' THEN 'page' WHEN 'error' THEN 'api' WHEN 'click' THEN 'event' ELSE 'event' END",
    "event": "CASE event_type WHEN 'click' THEN 'job_click' WHEN 'signup' THEN 'nav' END",
    "path": "CASE event_type WHEN 'error' THEN '/api/postings' WHEN 'view' THEN concat('/jobs/', user_id % 40) WHEN 'purchase' THEN concat('/company/', user_id % 15) ELSE '/' END",
    "status": "CASE WHEN event_type = 'error' THEN 500 ELSE 200 END",
    "ms": "CAST(floor(value) AS BIGINT)",
    "bytes": "event_id % 997 * 10",
    "referrer": "CASE user_id % 4 WHEN 0 THEN 'google.com' WHEN 1 THEN 'linkedin.com' END",
    "country": "CASE user_id % 6 WHEN 0 THEN 'NL' WHEN 1 THEN 'BE' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' WHEN 4 THEN 'US' END",
    "bot": "user_id % 10 = 9",
    "browser": "CASE WHEN user_id % 10 = 9 THEN concat('Bot', user_id % 3) ELSE concat('Browser', user_id % 5) END",
    "os": "concat('OS', user_id % 4)",
    "device": "CASE WHEN user_id % 10 = 9 THEN 'bot' WHEN user_id % 2 = 0 THEN 'desktop' ELSE 'mobile' END",
}


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    detail = F.when(F.col("event_type") == "click", F.get_json_object("props", "$.k"))
    return rows.select(*(F.expr(e).alias(c) for c, e in _VIEW.items()), detail.alias("detail"))


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


POSTINGS_SQL = f"""
    skills AS (
        SELECT l_orderkey, coalesce(list_sort(list(DISTINCT p_brand) FILTER (WHERE l_linenumber <= 3)), []) AS skills_required,
               coalesce(list_sort(list(DISTINCT p_brand) FILTER (WHERE l_linenumber > 3)), []) AS skills_nice
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
    ), postings AS (
        SELECT {_columns(_POSTING)},
               o_orderdate + to_days(CAST({_DAYS['first_seen']} AS INTEGER)) AS first_seen,
               o_orderdate + to_days(CAST({_DAYS['last_seen']} AS INTEGER)) AS last_seen,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST({_DAYS['last_seen']} + 1 AS INTEGER)) END AS closed_at,
               CASE WHEN o_orderkey % 5 < 4 THEN o_orderdate + to_days(CAST({_DAYS['last_seen']} + 3 AS INTEGER)) END AS link_checked_at,
               coalesce(skills_required, []) AS skills_required, coalesce(skills_nice, []) AS skills_nice,
               CASE WHEN o_orderkey % 12 = 0 THEN ['NATION_3', 'NATION_8'] END AS also_in
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN skills ON l_orderkey = o_orderkey
    ), sources AS (
        SELECT {_columns(_SOURCE)},
               CASE WHEN n_nationkey % 5 <> 4 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(n_nationkey % 9 AS INTEGER)) - to_hours(CAST(n_nationkey AS INTEGER)) END AS last_run_at,
               TIMESTAMP '1995-03-01 00:00:00' AS first_success_at
        FROM nation
    )"""

VIEWS_SQL = f"""
    page_views AS (
        SELECT {_columns(_VIEW).replace("varchar(20)", "varchar")}, CASE WHEN event_type = 'click' THEN json_extract_string(props, '$.k') END AS detail
        FROM events
    )"""
