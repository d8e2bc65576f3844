"""Queries on the health of the data and on evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.plans.stats import NOW, ROWS_SQL
from tidemark.sources import standin
from tidemark.sources.standin import AS_OF

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = f"WITH {ROWS_SQL} {sql}"


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(standin.postings(spark, sf_dir), standin.sources(spark, sf_dir), AS_OF)


def _share(condition: str, base: str = "true") -> str:
    return f"round(count(*) FILTER (WHERE {base} AND {condition}) / greatest(count(*) FILTER (WHERE {base}), 1), 4)"


_REPORT_SQL = f""", live AS (SELECT * FROM postings JOIN sources USING (source_id) WHERE closed_at IS NULL AND duplicate_of IS NULL), report AS (
    SELECT count(*) AS live_postings, count(*) FILTER (WHERE is_tech) AS live_tech, {_share('description_length < 200')} AS empty_description_share, {_share("coalesce(city, '') = ''")} AS unknown_city_share,
        {_share('posted_at IS NULL')} AS missing_posted_date_share, count(*) FILTER (WHERE NOT starts_with(url, 'http')) AS invalid_url_count,
        {_share(f'coalesce(posted_at, first_seen) < {NOW} - INTERVAL 90 DAY')} AS stale_over_90_days_share, {_share("seniority = 'unknown'", 'is_tech')} AS tech_unknown_seniority_share,
        {_share('len(skills_required) + len(skills_nice) = 0', 'is_tech')} AS tech_no_skills_share, {_share(f'last_seen >= {NOW} - INTERVAL 7 DAY')} AS confirmed_7d_share,
        {_share(f'link_checked_at >= {NOW} - INTERVAL 30 DAY')} AS link_checked_30d_share, {_share(f'coalesce(posted_at, first_seen) < {NOW} - INTERVAL 180 DAY')} AS open_over_180_days_share,
        {_share("kind = 'agency'")} AS agency_share, {_share("link_status IN ('gone', 'redirected')", 'link_status IS NOT NULL')} AS link_checked_gone_share,
        (SELECT count(*) FROM sources WHERE active AND starts_with(last_error, 'unverified')) AS sources_unverified, (SELECT count(*) FROM sources WHERE last_status = 'partial') AS sources_partial,
        (SELECT count(*) FROM sources WHERE active AND last_status IN ('error', 'exception')) AS sources_failed, (SELECT count(*) FROM sources WHERE active AND last_run_at < {NOW} - INTERVAL 1 DAY) AS sources_stale_over_24h
    FROM live)"""
register("a13_quality_report", _report, _REPORT_SQL + " SELECT * FROM report")
_LIMITS = ", ".join(f"('{k}', {v})" for k, v in quality.THRESHOLDS.items())
_LONG = " UNION ALL ".join(f"SELECT '{k}' AS figure, CAST({k} AS DOUBLE) AS value FROM report" for k in quality.THRESHOLDS)
register("a14_violations", lambda spark, sf_dir: quality.violations(_report(spark, sf_dir)), _REPORT_SQL + f", long AS ({_LONG}) SELECT figure, value, CAST(threshold AS DOUBLE) AS threshold FROM long JOIN (VALUES {_LIMITS}) t(figure, threshold) USING (figure) WHERE value > threshold")
register("o3_link_check_batch", lambda spark, sf_dir: quality.link_check_batch(standin.postings(spark, sf_dir), AS_OF), f""", live AS (SELECT *, coalesce(posted_at, first_seen) AS age_at FROM postings WHERE closed_at IS NULL AND duplicate_of IS NULL)
    SELECT id, source_id, url, age_at FROM live WHERE age_at <= {NOW} - INTERVAL 21 DAY AND (link_checked_at IS NULL OR link_checked_at <= {NOW} - INTERVAL 7 DAY)
    ORDER BY age_at, id LIMIT (SELECT greatest(200, count(*) // 14) FROM live)""")
register("a16_link_guard", lambda spark, sf_dir: quality.link_guard(standin.postings(spark, sf_dir).where("link_status is not null")), """, g AS (SELECT source_id, count(*) AS checked, count(*) FILTER (WHERE link_status IN ('gone', 'redirected')) AS dead FROM postings WHERE link_status IS NOT NULL GROUP BY source_id)
    SELECT source_id, checked, dead, checked >= 3 AND dead / checked >= 0.5 AS flagged, CASE WHEN checked >= 3 AND dead / checked >= 0.5 THEN 0 ELSE dead END AS closed FROM g""")
register("a28_crawl_volume", lambda spark, sf_dir: quality.crawl_volume(standin.sources(spark, sf_dir), AS_OF), f""", v AS (SELECT count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE active AND last_run_at >= {NOW} - INTERVAL 3 HOUR) AS n_recent,
    max(last_run_at) FILTER (WHERE last_status = 'ok') AS last_ok FROM sources)
    SELECT n_active AS active, n_recent AS recent, last_ok, coalesce(last_ok <= {NOW} - INTERVAL 3 HOUR, true) OR (n_active >= 100 AND n_recent < greatest(5, n_active * 0.01)) AS stale FROM v""")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, and a plain rule's word on their quality: long enough and not a table."""
    docs = standin.table(spark, sf_dir, "documents").join(standin.table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(((F.col("n_chars") > 300) & ~F.contains("text", F.lit(" | "))).alias("predicted"), (F.col("quality") == 1).alias("actual"))


_EVAL = """, j AS (SELECT n_chars > 300 AND NOT contains(text, ' | ') AS p, quality = 1 AS a FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND a) AS fn, count(*) FILTER (WHERE NOT p AND NOT a) AS tn FROM j)
    SELECT tp, fp, fn, tn"""
for _name, _hits, _n in (("precision", "tp", "tp + fp"), ("recall", "tp", "tp + fn"), ("accuracy", "tp + tn", "tp + fp + fn + tn")):
    _p, _z = f"(({_hits}) / ({_n}))", 1.96
    _w = f"{_z} * sqrt({_p} * (1 - {_p}) / ({_n}) + {_z * _z} / (4.0 * ({_n}) * ({_n})))"
    for _side, _sign, _edge in (("", "", ""), ("_low", "-", "greatest"), ("_high", "+", "least")):
        if not _side:
            _EVAL += f", round({_p}, 4) AS {_name}"
        else:
            _bound = 0.0 if _sign == "-" else 1.0
            _EVAL += f", round({_edge}({_bound}, ({_p} + {_z * _z} / (2.0 * ({_n})) {_sign} {_w}) / (1 + {_z * _z} / ({_n}))), 4) AS {_name}{_side}"
register("a20_filter_evaluation", lambda spark, sf_dir: quality.binary_evaluation(_judged(spark, sf_dir)), _EVAL + " FROM c")


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.postings(spark, sf_dir).where("is_tech")
    return rows.select(
        F.col("seniority").alias("expected_seniority"), F.when(F.col("id") % 5 == 0, "senior").otherwise(F.col("seniority")).alias("found_seniority"),
        F.col("remote_policy").alias("expected_remote_policy"), F.when(F.col("id") % 8 == 0, "unknown").otherwise(F.col("remote_policy")).alias("found_remote_policy"),
        F.col("skills_required").alias("expected_skills"), F.array_distinct(F.concat("skills_required", "skills_nice")).alias("found_skills"),
    )


register("a19_extraction_evaluation", lambda spark, sf_dir: quality.extraction_evaluation(_extractions(spark, sf_dir), ["seniority", "remote_policy"]), """, e AS (SELECT *, list_distinct(list_concat(skills_required, skills_nice)) AS found FROM postings WHERE is_tech),
    v AS (SELECT avg(CASE WHEN id % 5 = 0 THEN (seniority = 'senior')::INT ELSE 1 END) AS seniority, avg(CASE WHEN id % 8 = 0 THEN (remote_policy = 'unknown')::INT ELSE 1 END) AS remote_policy,
        sum(len(list_intersect(skills_required, found))) / sum(len(found)) AS skill_precision, sum(len(list_intersect(skills_required, found))) / sum(len(skills_required)) AS skill_recall FROM e),
    w AS (SELECT *, 2 * skill_precision * skill_recall / (skill_precision + skill_recall) AS skill_f1, (seniority + remote_policy + 2 * skill_precision * skill_recall / (skill_precision + skill_recall)) / 3 AS overall FROM v)
    SELECT figure, round(value, 4) AS value FROM (UNPIVOT w ON seniority, remote_policy, skill_precision, skill_recall, skill_f1, overall INTO NAME figure VALUE value)""")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = standin.postings(spark, sf_dir).withColumn("description", F.when(F.col("id") % F.greatest(F.col("source_id"), F.lit(1)) == 0, F.concat(F.lit("Work in "), F.coalesce("city", F.lit("a team")))).otherwise("A good job"))
    return quality.mention_share(posts, standin.sources(spark, sf_dir))


register("a15_mention_share", _mentions, """, named AS (SELECT source_id, source_company, list_filter(regexp_split_to_array(lower(source_company), ' +'), lambda w: length(w) >= 3) AS tokens,
        lower(title || chr(10) || CASE WHEN id % greatest(source_id, 1) = 0 THEN 'Work in ' || coalesce(city, 'a team') ELSE 'A good job' END) AS t FROM postings JOIN sources USING (source_id) WHERE closed_at IS NULL)
    SELECT source_id, source_company, count(*) AS postings, round(avg(CASE WHEN len(list_filter(tokens, lambda w: contains(t, w))) > 0 THEN 1 ELSE 0 END), 2) AS mention_share FROM named GROUP BY 1, 2
    HAVING count(*) >= 3 AND avg(CASE WHEN len(list_filter(tokens, lambda w: contains(t, w))) > 0 THEN 1 ELSE 0 END) < 0.3""")
