"""Employers' headcounts out of landed entries of a knowledge base, and of an encyclopedia where that says nothing.

An entry counts for an employer if one of its sites is the employer's, or if it has the employer's name and is Dutch. Candidates come
with the employer that they were looked up for, so all joins are on its name; every choice (first fitting entry, latest year, first
fitting article) is an aggregate with map-side combine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.links import site_domain
from tidemark.functions.normalize import norm_company
from tidemark.functions.spans import search

# Properties of entries (headcount, its date, site, country), the country, and fields of articles.
HEADCOUNT, AT, SITE, COUNTRY, DUTCH = "P1128", "P585", "P856", "P17", "Q55"
WEBSITE_FIELD = r"(?im)^\s*\|\s*(?:website|homepage|url|web)\s*=\s*(.+)$"
STAFF_FIELD = r"(?im)^\s*\|\s*(?:werknemers|medewerkers|aantal[ _]werknemers|aantal[ _]medewerkers|num[ _]employees|employees)\s*=\s*(.+)$"
MOST_PEOPLE, LANGUAGES, HEAD, LEAD_OF, LEAD = 3_000_000, ("nl", "en"), 8000, 20_000, 800

_CLAIM = "struct<mainsnak: struct<datavalue: struct<value: {v}>>{q}>"
_PLAIN, _ID = _CLAIM.format(v="string", q=""), _CLAIM.format(v="struct<id: string>", q="")
_COUNT = _CLAIM.format(v="struct<amount: string>", q=f", qualifiers: struct<{AT}: array<struct<datavalue: struct<value: struct<time: string>>>>>")
ENTRY = f"labels map<string, struct<value: string>>, aliases map<string, array<struct<value: string>>>, claims struct<{HEADCOUNT}: array<{_COUNT}>, {SITE}: array<{_PLAIN}>, {COUNTRY}: array<{_ID}>>"


def _key(name: Column) -> Column:
    return F.lower(norm_company(name))


def _or_empty(array: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(array, F.array().cast(kind))


def from_entries(companies: DataFrame, entries: DataFrame) -> DataFrame:
    """company, employees, as_of, source of each employer's first fitting entry that states a count; of counts the latest, of equal years the first."""
    e = F.from_json("payload", ENTRY)
    rows = entries.select("company", "nth", "entry_id", e.alias("e")).join(companies, "company")
    value = lambda claims: F.transform(_or_empty(claims, f"array<{_PLAIN}>"), lambda c: c["mainsnak"]["datavalue"]["value"])
    sites = F.transform(F.array_compact(value(F.col(f"e.claims.{SITE}"))), site_domain)
    names = F.concat(F.transform(_or_empty(F.map_values("e.labels"), "array<struct<value: string>>"), lambda n: n["value"]), F.transform(F.flatten(_or_empty(F.map_values("e.aliases"), "array<array<struct<value: string>>>")), lambda n: n["value"]))
    named = F.coalesce(F.exists(names, lambda n: _key(n) == _key(F.col("company"))), F.lit(False))
    dutch = F.coalesce(F.exists(f"e.claims.{COUNTRY}", lambda c: c["mainsnak"]["datavalue"]["value"]["id"].eqNullSafe(DUTCH)), F.lit(False))
    own_site = F.coalesce(F.arrays_overlap(sites, _or_empty(F.col("domains"))), F.lit(False))
    fitting = rows.where(own_site | (named & dutch)).select("company", "nth", "entry_id", F.posexplode(f"e.claims.{HEADCOUNT}").alias("at", "claim"))
    year = F.coalesce(F.substring(F.get(F.col(f"claim.qualifiers.{AT}"), F.lit(0))["datavalue"]["value"]["time"], 2, 4), F.lit(""))
    counts = fitting.select("company", "nth", "entry_id", "at", F.expr("try_cast(try_cast(claim.mainsnak.datavalue.value.amount AS double) AS long)").alias("employees"), year.alias("as_of")).where("employees is not null")
    latest = counts.groupBy("company", "nth", "entry_id").agg(F.max_by(F.struct("employees", "as_of"), F.struct("as_of", -F.col("at"))).alias("best"))
    first = latest.groupBy("company").agg(F.min_by(F.struct("entry_id", "best"), F.struct("nth", "entry_id")).alias("f"))
    return first.select("company", F.col("f.best.employees").alias("employees"), F.col("f.best.as_of").alias("as_of"), F.concat(F.lit("wikidata:"), F.col("f.entry_id")).alias("source"))


def parse_count(text: Column) -> Column:
    """The first number of a field, thousands marked in any way: "43,520 (2024)", "ca. 5000", "{{formatnum:12000}}"; null beyond three million."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)<ref.*?(?:</ref>|/>)", " "), r"(?i)\{\{(?:formatnum|nts|nowrap|circa|c\.)\s*:?\|?\s*([^}|]+)[^}]*\}\}", "$1")
    digits = F.regexp_replace(F.regexp_extract(bare, r"(\d{1,3}(?:[.,\s]\d{3})+|\d+)", 1), r"[.,\s]", "")
    number = digits.try_cast("long")
    return F.when(number.between(1, MOST_PEOPLE), number)


def from_articles(companies: DataFrame, articles: DataFrame) -> DataFrame:
    """company, employees, as_of, source of each employer's first fitting article with a count: Dutch ones first, by their place in the search.

    An article fits if a site in its fact box is the employer's, and its title has the name's first word or its opening the name.
    """
    head = F.left("wikitext", F.lit(HEAD))
    fields = F.regexp_extract_all(head, F.lit(WEBSITE_FIELD), F.lit(1))
    bare = F.transform(fields, lambda f: site_domain(F.regexp_replace(f, r"^[ \[\]{}|]+|[ \[\]{}|]+$", "")))
    linked = F.transform(F.regexp_extract_all(F.array_join(fields, " "), F.lit(r"(https?://[^\s\]|}]+)"), F.lit(1)), site_domain)
    opening = F.left(F.trim(F.regexp_replace(F.left("wikitext", F.lit(LEAD_OF)), r"(?s)\{\{.*?\}\}", " ")), F.lit(LEAD))
    first_word = F.split(_key(F.col("company")), r"\s+")[0]
    about = F.contains(F.lower("title"), first_word) | F.contains(F.lower(opening), F.lower("company"))
    rows = articles.where(F.col("lang").isin(*LANGUAGES)).join(companies.where("size(domains) > 0"), "company")
    stated = F.regexp_extract(head, STAFF_FIELD, 1)
    fitting = rows.where(F.coalesce(F.arrays_overlap(F.concat(bare, linked), F.col("domains")) & about, F.lit(False)))
    counts = fitting.select("company", "lang", "nth", "title", parse_count(stated).alias("employees"), F.regexp_extract(stated, r"(20\d\d|19\d\d)", 1).alias("as_of")).where("employees is not null")
    first = counts.groupBy("company").agg(F.min_by(F.struct("employees", "as_of", "lang", "title"), F.struct(F.col("lang") != LANGUAGES[0], "nth", "title")).alias("f"))
    return first.select("company", "f.employees", "f.as_of", F.concat(F.col("f.lang"), F.lit("wiki:"), F.col("f.title")).alias("source"))


def headcounts(companies: DataFrame, entries: DataFrame, articles: DataFrame, done: DataFrame, wrong: DataFrame) -> DataFrame:
    """company, employees, as_of, source of every employer that has not been looked up yet (``done``) and whose hit is not listed as ``wrong``.

    ``companies``: company, domains; ``entries``: company, nth, entry_id, payload (JSON); ``articles``: company, lang, nth, title, wikitext.
    Null domains are none, unreadable payloads have no counts, null texts are no articles; the domains of a company
    listed twice are united; empty tables give no rows; other columns are not read.
    """
    asked = companies.where("company is not null").groupBy("company").agg(F.array_distinct(F.flatten(F.collect_list(_or_empty(F.col("domains"))))).alias("domains"))  # one employer's domains
    asked = reduce(lambda rows, table: rows.join(table.select("company").distinct(), "company", "left_anti"), (done, wrong), asked)
    known = from_entries(asked, entries)
    rest = asked.join(known.select("company"), "company", "left_anti")
    return known.unionByName(from_articles(rest, articles))


def is_employer_site(url: Column) -> Column:
    """Whether an address is an employer's own and not a board's."""
    # Platforms that host boards.
    platforms = "greenhouse|lever\\.co|recruitee|teamtailor|workday|smartrecruiters|ashby|workable|personio|homerun"
    return F.contains(url, F.lit(".")) & ~search(url, platforms)


def candidate_domains(boards: DataFrame) -> DataFrame:
    """company, domains: the employers' own domains among their boards' addresses (source_company, url, slug), with and without a careers prefix."""
    each = boards.select(F.col("source_company").alias("company"), F.explode(F.array("url", "slug")).alias("u")).where(is_employer_site(F.col("u")))
    domain = site_domain(F.col("u"))
    bare = F.regexp_replace(domain, "^(werkenbij|werkenvoor|careers?|jobs|vacatures)", "")
    both = each.select("company", F.explode(F.array(domain, F.when(bare == "", domain).otherwise(bare))).alias("d")).where("d <> ''")
    return both.groupBy("company").agg(F.array_sort(F.collect_set("d")).alias("domains"))  # one employer's domains
