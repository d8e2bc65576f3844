"""Landing pages, employer index and the figures that such pages show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.filters import Filters

MIN_POSTINGS, MIN_POSTINGS_COMBO = 8, 20


def slugify(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "company").otherwise(s)


def company_index(rows: DataFrame) -> DataFrame:
    """name, slug, postings: spellings of one slug are one employer, shown under the most used one."""
    names = rows.groupBy("company").agg(F.count(F.lit(1)).alias("n")).withColumn("slug", slugify(F.col("company")))
    return names.groupBy("slug").agg(F.min_by("company", F.struct((-F.col("n")).alias("n"), "company")).alias("name"), F.sum("n").alias("postings"))


def employer_figures(rows: DataFrame) -> DataFrame:
    """company, open, english, visa, employees."""
    live = rows.where("closed_at is null")
    return live.groupBy("company").agg(F.count(F.lit(1)).alias("open"), F.count_if(F.col("english_only").eqNullSafe(True)).alias("english"), F.count_if(F.col("visa_sponsorship").eqNullSafe(True)).alias("visa"), F.max("employees").alias("employees"))


def employer_top(rows: DataFrame, of: str, top: int = 5) -> DataFrame:
    """company, key, count: each employer's commonest cities or skills."""
    live = rows.where("closed_at is null")
    keyed = live.select("company", F.explode(of).alias("key")) if of == "skills" else live.where(F.col(of).isNotNull()).select("company", F.col(of).alias("key"))
    counted = keyed.groupBy("company", "key").agg(F.count(F.lit(1)).alias("count"))
    nth = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("count"), "key"))
    return counted.withColumn("nth", nth).where(F.col("nth") <= top).drop("nth")


def page_figures(rows: DataFrame) -> DataFrame:
    """One row for the rows of a landing page: postings, employers, share without Dutch, visa and entry-level counts."""
    entry = F.col("seniority").isin("intern", "trainee", "junior") | (F.col("experience") == "none")
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("postings"),
        F.count_distinct("company").alias("employers"),
        F.coalesce(F.round(100 * F.count_if(F.col("english_only").eqNullSafe(True)) / F.nullif(n, F.lit(0))), F.lit(0.0)).cast("long").alias("no_dutch_percent"),
        F.count_if(F.col("visa_sponsorship").eqNullSafe(True)).alias("visa"),
        F.count_if(F.coalesce(entry, F.lit(False))).alias("entry_level"),
    )


THEMES = {
    "english": Filters(english_only=True),
    "visa": Filters(sponsorship=True),
    "junior": Filters(experience="none,1"),
    "remote": Filters(remote="remote"),
}
CITY_THEMES = ("english", "visa", "junior")


def landing_pages(rows: DataFrame, as_of: str, max_cities: int = 14, role_cities: int = 8, theme_cities: int = 6, minimum: int = MIN_POSTINGS, minimum_combo: int = MIN_POSTINGS_COMBO, themes: dict[str, Filters] = THEMES) -> DataFrame:
    """kind, role, theme, city, postings of every page with enough postings.

    A row is in a city's page if its own city or one of its others is that city. One pass counts all
    city, role and role-in-city pages as aggregates of the same rows, united; themes are counted as flags.
    """
    live = rows.where("closed_at is null")
    own = live.where(F.col("city").isNotNull()).groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    cities = own.where(F.col("n") >= minimum).orderBy(F.desc("n"), "city").limit(max_cities)
    cities = cities.select(F.col("city").alias("page_city"), F.row_number().over(Window.orderBy(F.desc("n"), "city")).alias("place"))  # at most max_cities rows
    names = F.array_distinct(F.concat(F.array(F.upper("city")), F.transform(F.coalesce("also_in", F.array().cast("array<string>")), F.upper)))
    flags = {name: reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in f.conditions(as_of)]) for name, f in themes.items()}
    flagged = live.select("role_family", names.alias("names"), *(c.alias(f"theme_{t}") for t, c in flags.items()))
    in_city = flagged.select("role_family", *(f"theme_{t}" for t in themes), F.explode("names").alias("name")).join(F.broadcast(cities), F.col("name") == F.upper("page_city"))
    counts = [F.count(F.lit(1)).alias("all"), *(F.count_if(f"theme_{t}").alias(t) for t in themes)]
    by_city = in_city.groupBy("page_city", "place").agg(*counts)
    by_role_city = in_city.where(F.col("place") <= role_cities).groupBy("role_family", "page_city").agg(F.count(F.lit(1)).alias("postings"))
    by_role = flagged.groupBy("role_family").agg(F.count(F.lit(1)).alias("postings"))
    everywhere = flagged.agg(*counts)
    stack = ", ".join(f"'{t}', {t}" for t in themes)
    stack_city = ", ".join(f"'{t}', {t}" for t in themes if t in CITY_THEMES)
    n_city = sum(t in CITY_THEMES for t in themes)
    nothing = F.lit(None).cast("string")
    pages = [
        by_city.select(F.lit("city").alias("kind"), nothing.alias("role"), nothing.alias("theme"), F.col("page_city").alias("city"), F.col("all").alias("postings"), F.lit(minimum).alias("least")),
        by_role.select(F.lit("role").alias("kind"), F.col("role_family").alias("role"), nothing.alias("theme"), nothing.alias("city"), "postings", F.lit(minimum).alias("least")),
        by_role_city.select(F.lit("role_city").alias("kind"), F.col("role_family").alias("role"), nothing.alias("theme"), F.col("page_city").alias("city"), "postings", F.lit(minimum_combo).alias("least")),
        everywhere.select(F.expr(f"stack({len(themes)}, {stack}) as (theme, postings)")).select(F.lit("theme").alias("kind"), nothing.alias("role"), "theme", nothing.alias("city"), "postings", F.lit(minimum).alias("least")),
        by_city.where(F.col("place") <= theme_cities).select("page_city", F.expr(f"stack({n_city}, {stack_city}) as (theme, postings)")).select(F.lit("theme_city").alias("kind"), nothing.alias("role"), "theme", F.col("page_city").alias("city"), "postings", F.lit(minimum_combo).alias("least")),
    ]
    return reduce(DataFrame.unionByName, pages).where("postings >= least").drop("least")


def popular(pages: DataFrame, top: int = 18) -> DataFrame:
    return pages.orderBy(F.desc("postings"), "kind", F.asc_nulls_first("role"), F.asc_nulls_first("theme"), F.asc_nulls_first("city")).limit(top)


def related(pages: DataFrame, role: str | None, city: str | None, top: int = 14) -> DataFrame:
    """Pages that share the role or the city."""
    same = F.lit(False)
    if role:
        same = same | (F.col("role") == role)
    if city:
        same = same | (F.col("city") == city)
    return popular(pages.where(F.coalesce(same, F.lit(False)) & ~(F.col("role").eqNullSafe(role) & F.col("city").eqNullSafe(city))), top)
