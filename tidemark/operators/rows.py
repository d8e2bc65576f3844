"""The denormalised view of postings that the analytical queries run over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.positions import position
from tidemark.session import stored

# Title words of entry-level roles.
EARLY_TITLE = r"graduate|trainee|traineeship|internship|\bintern\b|\bstage\b|stagiair|afstudeer|werkstudent|working student|young professional|starter|\bjunior\b"
# Degree levels and the groups that reports use.
DEGREE_GROUPS = {"phd": "phd", "msc": "master", "bsc": "bachelor", "hbo": "bachelor", "mbo": "mbo"}


def ignoring_case(pattern: str) -> str:
    """A pattern in Java's dialect that folds case and knows letters beyond ASCII."""
    return "(?iuU)" + pattern


def org_size(open_roles: Column) -> Column:
    return F.when(open_roles >= 100, "large").when(open_roles >= 10, "medium").otherwise("small")


def employee_band(employees: Column) -> Column:
    return F.when(employees.isNull(), "unknown").when(employees < 50, "1-49").when(employees < 250, "50-249").when(employees < 5000, "250-4999").otherwise("5000+")


def experience_band(years: Column, seniority: Column, title: Column) -> Column:
    """Bands of years asked for; without years, 'none' is for entry-level roles only."""
    early = F.coalesce(seniority.isin("intern", "trainee", "junior"), F.lit(False)) | F.coalesce(title, F.lit("")).rlike(ignoring_case(EARLY_TITLE))
    unstated = F.when(early, "none").otherwise("unspecified")
    return F.when(years.isNull() | (years == 0), unstated).when(years <= 1, "1").when(years <= 3, "2-3").when(years <= 5, "4-5").otherwise("6+")


def degree_group(degree: Column) -> Column:
    found = F.lit("unstated")
    for level, group in DEGREE_GROUPS.items():
        found = F.when(degree == level, group).otherwise(found)
    return found


def row_view(postings: DataFrame, sources: DataFrame, sectors: DataFrame | None = None, closed_since: str | None = None) -> DataFrame:
    """Tech postings that are not duplicates, with what their board, employer and sector add, and the derived columns.

    Boards and sectors are joined by key and left to Spark to broadcast by their size; open roles are
    one aggregate over all open postings, of every field.
    """
    open_roles = postings.where("closed_at is null and duplicate_of is null").groupBy("company").agg(F.count(F.lit(1)).alias("org_roles"))
    kept = postings.where("is_tech and duplicate_of is null")
    if closed_since:
        kept = kept.where(F.col("closed_at").isNull() | (F.col("closed_at") >= F.lit(closed_since).cast("timestamp_ntz")))
    rows = kept.join(sources.select("source_id", "ats", "kind"), "source_id").join(open_roles, "company", "left")
    if sectors is None:
        rows = rows.withColumn("sector", F.lit("other"))
    else:
        rows = rows.join(sectors.select("company", "sector"), "company", "left").withColumn("sector", F.coalesce("sector", F.lit("other")))
    confirmed = F.greatest("last_seen", F.when(F.col("link_status") == "ok", F.col("link_checked_at")))
    return rows.withColumns(
        {
            "org_roles": F.coalesce("org_roles", F.lit(0)),
            "kind": F.when(F.col("sector") == "staffing", "agency").otherwise(F.coalesce("kind", F.lit("employer"))),
            "effective_at": F.coalesce("posted_at", "first_seen"),
            "confirmed_at": confirmed,
            "skills": F.array_distinct(F.concat("skills_required", "skills_nice")),
            "experience": experience_band(F.col("years_experience"), F.col("seniority"), F.col("title")),
            "degree": degree_group(F.col("degree_required")),
            "employee_band": employee_band(F.col("employees")),
            "org_size": org_size(F.coalesce("org_roles", F.lit(0))),
        }
    )


def by_distinct(rows: DataFrame, key: Column, **facts) -> DataFrame:
    """``rows`` with what functions of one text say of ``key``, each computed once for every distinct text, nulls included.

    For texts that many rows share (titles, names of skills, user agents): patterns cost far more than the join back, which Spark
    broadcasts if the distinct texts are few. The facts are stored, else a later filter on them is pushed down to all rows.
    """
    keyed = rows.withColumn("_key", key)
    distinct = keyed.select(F.col("_key").alias("_text")).distinct()
    told = stored(distinct.select("_text", *(of(F.col("_text")).alias(name) for name, of in facts.items())))
    return keyed.join(told, F.col("_key").eqNullSafe(F.col("_text")), "left").drop("_key", "_text")


def with_positions(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``position`` that their title names: the many patterns are tried once for each distinct title; a null title is 'other'."""
    titles = rows.select(F.col("title").alias("_title")).where("title is not null").distinct()
    named = titles.select("_title", position(F.col("_title")).alias("position"))
    return rows.drop("position").join(named, F.col("title") == F.col("_title"), "left").drop("_title").withColumn("position", F.coalesce("position", F.lit("other")))
