"""Reports on the health of the data: quality shares, violations, link checks, source checks and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The highest acceptable value of each figure.
THRESHOLDS = {
    "empty_description_share": 0.10,
    "unknown_city_share": 0.35,
    "missing_posted_date_share": 0.30,
    "invalid_url_count": 0.0,
    "stale_over_90_days_share": 0.50,
    "tech_unknown_seniority_share": 0.50,
    "tech_no_skills_share": 0.35,
    "sources_partial": 25.0,
    "sources_failed": 60.0,
}


def _ago(as_of: str, days: int) -> Column:
    return F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")


def quality_report(postings: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """One row of 18 figures, from one pass over live postings and one over the boards."""
    live = postings.where("closed_at is null and duplicate_of is null").join(sources.select("source_id", "kind"), "source_id")
    tech, age = F.coalesce(F.col("is_tech"), F.lit(False)), F.coalesce("posted_at", "first_seen")
    known = F.col("link_status").isNotNull()

    def share(condition: Column, base: Column | None = None) -> Column:
        n = F.count(F.lit(1)) if base is None else F.count_if(base)
        hit = condition if base is None else base & condition
        return F.round(F.count_if(hit) / F.greatest(n, F.lit(1)), 4)

    counted = live.agg(
        F.count(F.lit(1)).alias("live_postings"),
        F.count_if(tech).alias("live_tech"),
        share(F.coalesce("description_length", F.lit(0)) < 200).alias("empty_description_share"),
        share(F.coalesce("city", F.lit("")) == "").alias("unknown_city_share"),
        share(F.col("posted_at").isNull()).alias("missing_posted_date_share"),
        F.count_if(~F.coalesce("url", F.lit("")).startswith("http")).alias("invalid_url_count"),
        share(age < _ago(as_of, 90)).alias("stale_over_90_days_share"),
        share(F.coalesce("seniority", F.lit("unknown")) == "unknown", tech).alias("tech_unknown_seniority_share"),
        share((F.size("skills_required") == 0) & (F.size("skills_nice") == 0), tech).alias("tech_no_skills_share"),
        share(F.col("last_seen") >= _ago(as_of, 7)).alias("confirmed_7d_share"),
        share(F.col("link_checked_at") >= _ago(as_of, 30)).alias("link_checked_30d_share"),
        share(age < _ago(as_of, 180)).alias("open_over_180_days_share"),
        share(F.col("kind") == "agency").alias("agency_share"),
        share(F.col("link_status").isin("gone", "redirected"), known).alias("link_checked_gone_share"),
    )
    boards = sources.agg(
        F.count_if(F.col("active") & F.col("last_error").startswith("unverified")).alias("sources_unverified"),
        F.count_if(F.col("last_status") == "partial").alias("sources_partial"),
        F.count_if(F.col("active") & F.col("last_status").isin("error", "exception")).alias("sources_failed"),
        F.count_if(F.col("active") & (F.col("last_run_at") < _ago(as_of, 1))).alias("sources_stale_over_24h"),
    )
    return counted.crossJoin(boards)  # two single rows


def violations(report: DataFrame, thresholds: dict[str, float] = THRESHOLDS) -> DataFrame:
    """figure, value, threshold of every figure above its limit."""
    pairs = ", ".join(f"'{k}', cast({k} as double), cast({v} as double)" for k, v in thresholds.items())
    return report.select(F.expr(f"stack({len(thresholds)}, {pairs}) as (figure, value, threshold)")).where("value > threshold")


def link_check_batch(postings: DataFrame, as_of: str, older_than_days: int = 21, cycle_days: int = 14, least: int = 200) -> DataFrame:
    """The pages to open next: live, old enough, not checked for a week, the oldest first; so many that all get their turn in a cycle."""
    live = postings.where("closed_at is null and duplicate_of is null")
    n = max(least, live.count() // cycle_days)
    age = F.coalesce("posted_at", "first_seen")
    due = live.where((age <= _ago(as_of, older_than_days)) & (F.col("link_checked_at").isNull() | (F.col("link_checked_at") <= _ago(as_of, 7))))
    return due.withColumn("age_at", age).orderBy("age_at", "id").limit(n).select("id", "source_id", "url", "age_at")


def link_guard(checked: DataFrame) -> DataFrame:
    """source_id, checked, dead, flagged, closed: a board most of whose links look dead is flagged and loses nothing."""
    counted = checked.groupBy("source_id").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("link_status").isin("gone", "redirected")).alias("dead"))
    flagged = (F.col("checked") >= 3) & (F.col("dead") / F.col("checked") >= 0.5)
    return counted.select("source_id", "checked", "dead", flagged.alias("flagged"), F.when(flagged, 0).otherwise(F.col("dead")).alias("closed"))


def crawl_volume(sources: DataFrame, as_of: str, hours: int = 3) -> DataFrame:
    """One row: active boards, those crawled lately, and whether crawling has stalled."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    one = sources.agg(
        F.count_if("active").alias("active"),
        F.count_if(F.col("active") & (F.col("last_run_at") >= since)).alias("recent"),
        F.max(F.when(F.col("last_status") == "ok", F.col("last_run_at"))).alias("last_ok"),
    )
    few = (F.col("active") >= 100) & (F.col("recent") < F.greatest(F.lit(5.0), F.col("active") * 0.01))
    return one.withColumn("stale", F.coalesce(F.col("last_ok") <= since, F.lit(True)) | few)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share."""
    p = hits / n
    middle, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    base = 1 + z * z / n
    zero = F.when(n > 0, (middle - width) / base).otherwise(0.0), F.when(n > 0, (middle + width) / base).otherwise(1.0)
    return F.greatest(zero[0], F.lit(0.0)), F.least(zero[1], F.lit(1.0))


def binary_evaluation(pairs: DataFrame, predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """One row: precision, recall and accuracy with their intervals, of two boolean columns."""
    p, a = F.col(predicted), F.col(actual)
    counts = pairs.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    out = ["tp", "fp", "fn", "tn"]
    for name, hits, n in (("precision", F.col("tp"), F.col("tp") + F.col("fp")), ("recall", F.col("tp"), F.col("tp") + F.col("fn")), ("accuracy", F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))):
        low, high = wilson(hits, n)
        out += [F.round(F.when(n > 0, hits / n), 4).alias(name), F.round(low, 4).alias(f"{name}_low"), F.round(high, 4).alias(f"{name}_high")]
    return counts.select(*out)


def extraction_evaluation(pairs: DataFrame, fields: list[str]) -> DataFrame:
    """figure, value: accuracy of each field (expected_x against found_x), micro precision, recall and F1 of skills, and their mean."""
    shared = F.sum(F.size(F.array_intersect("expected_skills", "found_skills")))
    wanted, got = F.sum(F.size("expected_skills")), F.sum(F.size("found_skills"))
    one = pairs.agg(*(F.avg(F.col(f"expected_{f}").eqNullSafe(F.col(f"found_{f}")).cast("int")).alias(f) for f in fields), (shared / F.nullif(got, F.lit(0))).alias("skill_precision"), (shared / F.nullif(wanted, F.lit(0))).alias("skill_recall"))
    precision, recall = F.coalesce("skill_precision", F.lit(0.0)), F.coalesce("skill_recall", F.lit(0.0))
    one = one.withColumn("skill_f1", F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0))
    one = one.withColumn("overall", (sum((F.col(f) for f in fields), F.lit(0.0)) + F.col("skill_f1")) / (len(fields) + 1))
    names = [*fields, "skill_precision", "skill_recall", "skill_f1", "overall"]
    pairs_sql = ", ".join(f"'{n}', cast({n} as double)" for n in names)
    return one.select(F.expr(f"stack({len(names)}, {pairs_sql}) as (figure, value)")).select("figure", F.round("value", 4).alias("value"))


def mention_share(postings: DataFrame, sources: DataFrame, least: int = 3, limit: float = 0.3, read: int = 6000) -> DataFrame:
    """Boards whose postings rarely name the employer (words of three letters and more, in the title or the text's beginning)."""
    words = F.filter(F.split(F.lower(F.regexp_replace("source_company", r"[^\p{L}\p{N} ]", " ")), r"\s+"), lambda w: F.length(w) >= 3)
    named = postings.where("closed_at is null").join(sources.where("coalesce(kind, 'employer') <> 'board'").select("source_id", "source_company", words.alias("tokens")), "source_id")
    text = F.lower(F.concat_ws("\n", "title", F.left("description", F.lit(read))))
    hit = F.exists("tokens", lambda t: F.contains(F.col("_text"), t))
    counted = named.where(F.size("tokens") > 0).withColumn("_text", text).groupBy("source_id", "source_company").agg(F.count(F.lit(1)).alias("postings"), F.avg(hit.cast("int")).alias("share"))
    return counted.where((F.col("postings") >= least) & (F.col("share") < limit)).select("source_id", "source_company", "postings", F.round("share", 2).alias("mention_share"))
