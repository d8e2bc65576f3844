"""Pages that sitemaps list, over a landing table of fetched sitemaps: an index's children first, then the pages themselves.

The walk has one level, as sitemaps do: a start that lists sitemaps hands over to its children, and what those list are pages. Each
level is a join of addresses with landed documents; a sitemap's entries keep their order through numbers, never by being in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normalize import CITIES, folded
from tidemark.functions.spans import search

# Addresses of job pages and of application forms, and words of addresses in the country.
JOB_LINK = r"(?i)(job|jobs|career|careers|vacature|vacatures|vacancy|vacancies|position|opening)"
APPLY_PAGE = r"(?i)/(?:[a-z]{2}/)?(?:apply|solliciteer|solliciteren|application(?:-form)?)/?(?:\?.*)?$"
IN_COUNTRY = (r"netherlands", r"nederland", r"[-_/]nl[-_/]", r"[-_/]nl$")
MOST_CHILDREN, OTHER_CHILDREN, PREFILTER_ABOVE = 10, 5, 2500


def entries(documents: DataFrame) -> DataFrame:
    """source_id, sitemap, at, url: every address of a landed sitemap (source_id, url, payload) in its order, with characters unescaped."""
    locs = documents.select("source_id", F.col("url").alias("sitemap"), F.posexplode(F.regexp_extract_all("payload", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("at", "url"))
    plain = F.col("url")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return locs.withColumn("url", plain)


def _is_index(url: Column) -> Column:
    """Whether all of a sitemap's entries are sitemaps."""
    return F.bool_and(F.lower(url).endswith(".xml") | F.contains(F.lower(url), F.lit("sitemap")))


def _pages(rows: DataFrame) -> DataFrame:
    """Of each sitemap the pages that are no application forms: those with a word of jobs in their address if there are any, else all."""
    kept = rows.where(~search(F.col("url"), APPLY_PAGE)).withColumn("job", search(F.col("url"), JOB_LINK))
    some = F.max("job").over(Window.partitionBy("source_id", "sitemap"))
    return kept.withColumn("some", some).where(F.col("job") | ~F.col("some")).drop("job", "some")


def sitemap_pages(documents: DataFrame, starts: DataFrame) -> DataFrame:
    """source_id, nth, url: the pages that each source's start (source_id, url) leads to, each once, in order.

    An index is followed into its first ten entries that speak of jobs, or into its first five entries where none does. Sources of more
    than 2,500 entries keep those whose address names a city or the country. Sitemaps that were not landed list nothing; of documents
    landed twice under one address the greatest payload counts; null payloads and addresses list nothing; other columns are not read.
    """
    landed = documents.where("payload is not null").groupBy("source_id", "url").agg(F.max("payload").alias("payload"))
    every = entries(landed)
    first = every.join(starts.select("source_id", F.col("url").alias("sitemap")).distinct(), ["source_id", "sitemap"])
    kinds = first.groupBy("source_id", "sitemap").agg(_is_index(F.col("url")).alias("is_index"))
    first = first.join(kinds, ["source_id", "sitemap"])
    children = first.where("is_index").withColumn("job", search(F.col("url"), JOB_LINK))
    of_start = Window.partitionBy("source_id", "sitemap")
    children = children.withColumns({"some": F.max("job").over(of_start), "place": F.row_number().over(of_start.orderBy(F.desc("job"), "at"))})
    most = F.when(F.col("some"), MOST_CHILDREN).otherwise(OTHER_CHILDREN)
    children = children.where((F.col("place") <= most) & (F.col("job") | ~F.col("some"))).select("source_id", F.col("url").alias("sitemap"), F.col("place").alias("child"))
    below = _pages(every.join(children, ["source_id", "sitemap"]))
    own = _pages(first.where("not is_index").withColumn("child", F.lit(0)))
    pages = own.select("source_id", "child", "at", "url").unionByName(below.select("source_id", "child", "at", "url"))
    number = pages.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    at_home = folded("|".join([*CITIES.values(), *IN_COUNTRY]))
    pages = pages.join(number, "source_id").where((F.col("n") <= PREFILTER_ABOVE) | search(F.col("url"), at_home))
    once = pages.groupBy("source_id", "url").agg(F.min(F.struct("child", "at")).alias("place"))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("place", "url"))
    return once.select("source_id", nth.alias("nth"), "url")


def to_read(pages: DataFrame, known: DataFrame, most: int = 4000) -> DataFrame:
    """The first ``most`` pages of each source that are not known (source_id, url) yet."""
    new = pages.join(known.select("source_id", "url").distinct(), ["source_id", "url"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("nth"))
    return new.withColumn("place", nth).where(F.col("place") <= most).select("source_id", "nth", "url")
