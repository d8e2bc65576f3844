"""Board payloads to raw postings: projections over a landing table (source_id, slug, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normalize import parse_time

COLUMNS = ["source_id", "external_id", "title", "url", "location", "city", "country", "remote", "description_html", "description_text", "posted_at", "valid_through"]
# Slugs of the platforms themselves.
VENDOR_SLUGS = ("www", "app", "api", "cdn", "static", "assets", "careers-analytics", "help", "support", "blog", "embed", "boards", "job-boards", "status", "docs", "tt", "feed", "images", "attachments")
# Where a platform's address holds the board's name.
SLUG_PATTERNS = {
    "greenhouse": r"boards\.greenhouse\.io/([A-Za-z0-9_-]+)",
    "lever": r"jobs\.lever\.co/([A-Za-z0-9_-]+)",
    "ashby": r"jobs\.ashbyhq\.com/([A-Za-z0-9_-]+)",
    "workable": r"apply\.workable\.com/([A-Za-z0-9_-]+)",
    "recruitee": r"https?://([a-z0-9-]+)\.recruitee\.com",
    "teamtailor": r"https?://([a-z0-9-]+)\.teamtailor\.com",
    "personio": r"https?://([a-z0-9-]+)\.jobs\.personio\.de",
    "smartrecruiters": r"careers\.smartrecruiters\.com/([A-Za-z0-9_-]+)",
}


def _raw(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` in the shape of COLUMNS, those not given null; columns beyond them follow."""
    kinds = {"source_id": "long", "remote": "boolean", "posted_at": "timestamp_ntz", "valid_through": "timestamp_ntz"}
    given = {"source_id": F.col("source_id")} | columns
    return rows.select(*(given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in [*COLUMNS, *(c for c in columns if c not in COLUMNS)]))


def _filled(value: Column) -> Column:
    return F.when(value != "", value)


def _joined(values: Column, sep: str) -> Column:
    return _filled(F.array_join(F.filter(values, lambda v: v.isNotNull() & (v != "")), sep))


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def _jobs(landing: DataFrame, schema: str, field: str | None) -> DataFrame:
    parsed = landing.select("source_id", "slug", F.from_json("payload", schema).alias("p"))
    return parsed.select("source_id", "slug", F.explode(F.col(f"p.{field}") if field else F.col("p")).alias("j"))


def _iso2(code: Column) -> Column:
    return F.when(F.length(code) == 2, F.upper(code))


def greenhouse(landing: DataFrame) -> DataFrame:
    job = "id string, title string, absolute_url string, location struct<name:string>, offices array<struct<location:string,name:string>>, content string, first_published string, updated_at string"
    rows = _jobs(landing, f"jobs array<struct<{_nested(job)}>>", "jobs")
    offices = _joined(F.transform("j.offices", lambda o: F.coalesce(_filled(o["location"]), o["name"])), ", ")
    return _raw(rows, external_id=F.col("j.id"), title=F.coalesce("j.title", F.lit("")), url=F.coalesce("j.absolute_url", F.lit("")), location=F.coalesce(_filled(F.col("j.location.name")), offices), description_html=F.col("j.content"), posted_at=parse_time(F.coalesce("j.first_published", "j.updated_at")))


def lever(landing: DataFrame) -> DataFrame:
    job = "id string, text string, hostedUrl string, applyUrl string, categories struct<location:string,allLocations:array<string>>, country string, workplaceType string, description string, descriptionPlain string, lists array<struct<text:string,content:string>>, additional string, additionalPlain string, createdAt string"
    rows = _jobs(landing, f"array<struct<{_nested(job)}>>", None)
    lists = F.coalesce("j.lists", F.from_json(F.lit("[]"), "array<struct<text:string,content:string>>"))
    html = F.concat(F.array("j.description"), F.flatten(F.transform(lists, lambda x: F.array(F.concat(F.lit("<h3>"), _filled(x["text"]), F.lit("</h3>")), F.concat(F.lit("<ul>"), _filled(x["content"]), F.lit("</ul>"))))), F.array("j.additional"))
    plain = F.concat(F.array("j.descriptionPlain"), F.flatten(F.transform(lists, lambda x: F.array(x["text"], F.regexp_replace(F.regexp_replace(x["content"], r"(?i)</li\s*>", "\n"), "<[^>]*>", "")))), F.array("j.additionalPlain"))
    return _raw(rows, external_id=F.col("j.id"), title=F.coalesce("j.text", F.lit("")), url=F.coalesce(_filled(F.col("j.hostedUrl")), "j.applyUrl", F.lit("")), location=F.coalesce(_filled(F.col("j.categories.location")), _joined(F.col("j.categories.allLocations"), ", ")),
                country=F.col("j.country"), remote=F.when(F.lower("j.workplaceType") == "remote", True), description_html=_stripped(_joined(html, "\n")), description_text=_stripped(_joined(plain, "\n")), posted_at=parse_time(F.col("j.createdAt")))


def ashby(landing: DataFrame) -> DataFrame:
    job = "id string, title string, jobUrl string, applyUrl string, location string, secondaryLocations array<struct<location:string>>, isRemote boolean, descriptionHtml string, descriptionPlain string, publishedAt string"
    rows = _jobs(landing, f"jobs array<struct<{_nested(job)}>>", "jobs")
    places = F.concat(F.array("j.location"), F.coalesce(F.transform("j.secondaryLocations", lambda s: s["location"]), F.array().cast("array<string>")))
    return _raw(rows, external_id=F.col("j.id"), title=F.coalesce("j.title", F.lit("")), url=F.coalesce(_filled(F.col("j.jobUrl")), "j.applyUrl", F.lit("")), location=_joined(places, "; "), remote=F.when(F.col("j.isRemote"), True), description_html=F.col("j.descriptionHtml"), description_text=F.col("j.descriptionPlain"), posted_at=parse_time(F.col("j.publishedAt")))


def recruitee(landing: DataFrame) -> DataFrame:
    job = "id string, status string, title string, careers_url string, url string, location string, city string, country_code string, remote boolean, description string, requirements string, published_at string, created_at string"
    rows = _jobs(landing, f"offers array<struct<{_nested(job)}>>", "offers").where("j.status is null or j.status = 'published'")
    return _raw(rows, external_id=F.col("j.id"), title=F.coalesce("j.title", F.lit("")), url=F.coalesce(_filled(F.col("j.careers_url")), "j.url", F.lit("")), location=_filled(F.col("j.location")), city=F.col("j.city"), country=_iso2(F.col("j.country_code")), remote=F.when(F.col("j.remote"), True), description_html=_joined(F.array("j.description", "j.requirements"), "\n"), posted_at=parse_time(F.coalesce("j.published_at", "j.created_at")))


def workable(landing: DataFrame) -> DataFrame:
    place = "struct<city:string,region:string,country:string,countryCode:string>"
    job = f"shortcode string, id string, title string, url string, shortlink string, city string, state string, country string, country_code string, locations array<{place}>, workplace string, telecommuting string, description string, requirements string, benefits string, published_on string, created_at string"
    rows = _jobs(landing, f"jobs array<struct<{_nested(job)}>>", "jobs")
    first, named = F.get("j.locations", F.lit(0)), F.coalesce(F.col("j.country"), F.get("j.locations", F.lit(0))["country"])
    code = F.coalesce(_filled(first["countryCode"]), _filled(F.col("j.country_code")), F.when(F.lower(named).isin("netherlands", "the netherlands", "nederland"), "NL"), F.when(F.exists("j.locations", lambda x: F.upper(x["countryCode"]) == "NL"), "NL"))
    city = F.coalesce(_filled(F.col("j.city")), first["city"])
    everywhere = _joined(F.transform("j.locations", lambda x: _joined(F.array(x["city"], x["region"], x["country"]), ", ")), "; ")
    remote = (F.lower("j.workplace") == "remote") | (F.lower("j.telecommuting") == "true")
    return _raw(rows, external_id=F.coalesce("j.shortcode", "j.id"), title=F.coalesce("j.title", F.lit("")), url=F.coalesce(_filled(F.col("j.url")), "j.shortlink", F.lit("")), location=F.coalesce(everywhere, _joined(F.array(city, F.col("j.state"), named), ", ")), city=city, country=_iso2(code),
                remote=F.when(remote, True), description_html=_joined(F.array("j.description", "j.requirements", "j.benefits"), "\n"), posted_at=parse_time(F.coalesce("j.published_on", "j.created_at")))


def amazon(landing: DataFrame) -> DataFrame:
    job = "id_icims string, id string, title string, job_path string, location string, normalized_location string, city string, country_code string, description string, basic_qualifications string, preferred_qualifications string, posted_date string"
    rows = _jobs(landing, f"jobs array<struct<{_nested(job)}>>", "jobs").withColumn("ext", F.coalesce(_filled(F.col("j.id_icims")), F.col("j.id"))).where("ext <> ''").dropDuplicates(["source_id", "ext"])
    code = F.create_map(*[F.lit(x) for pair in {"NLD": "NL", "DEU": "DE", "BEL": "BE", "GBR": "GB", "USA": "US"}.items() for x in pair])
    posted = F.coalesce(F.try_to_timestamp("j.posted_date", F.lit("MMMM d, yyyy")), F.try_to_timestamp("j.posted_date", F.lit("yyyy-MM-dd")))
    return _raw(rows, external_id=F.col("ext"), title=F.trim(F.coalesce("j.title", F.lit(""))), url=F.concat(F.lit("https://www.amazon.jobs"), F.coalesce(_filled(F.col("j.job_path")), F.concat(F.lit("/en/jobs/"), F.col("ext")))), location=F.coalesce(_filled(F.col("j.location")), _filled(F.col("j.normalized_location")), "j.city"), city=_filled(F.col("j.city")),
                country=F.try_element_at(code, F.upper("j.country_code")), description_html=_joined(F.array("j.description", "j.basic_qualifications", "j.preferred_qualifications"), "<br/>"), posted_at=posted)


def personio(landing: DataFrame) -> DataFrame:
    """XML: positions with an id and a name."""
    items = F.regexp_extract_all("payload", F.lit(r"(?s)(<position>.*?</position>)"), F.lit(1))
    position = "id string, name string, office string, createdAt string, jobDescriptions struct<jobDescription:array<struct<value:string>>>"
    # read inside the generator, which no condition passes: else it would be read anew for each of them
    rows = landing.select("source_id", "slug", F.explode(F.transform(items, lambda xml: F.from_xml(xml, position))).alias("j")).where("trim(j.id) <> '' and trim(j.name) <> ''")
    number = F.trim("j.id")
    return _raw(rows, external_id=number, title=F.trim("j.name"), url=F.concat(F.lit("https://"), F.col("slug"), F.lit(".jobs.personio.de/job/"), number), location=_filled(F.trim("j.office")), description_html=_joined(F.transform("j.jobDescriptions.jobDescription", lambda d: d["value"]), "\n"), posted_at=parse_time(F.col("j.createdAt")))


def sitemap_urls(landing: DataFrame) -> DataFrame:
    """source_id, url: the addresses of a sitemap without apply pages; job links if there are any, else all."""
    locs = landing.select("source_id", F.explode(F.regexp_extract_all("payload", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()
    locs = locs.withColumn("url", F.replace("url", F.lit("&amp;"), F.lit("&"))).where(~F.col("url").rlike(r"(?i)/(apply|solliciteer|sollicitatie)(/|$|\?)"))
    job = F.col("url").rlike(r"(?i)/(jobs?|vacatures?|vacancy|vacancies|careers?|werken-bij|positions?)/")
    some = locs.groupBy("source_id").agg(F.max(job.cast("int")).alias("some"))
    return locs.join(some, "source_id").where((F.col("some") == 0) | job).select("source_id", "url")


def slugs_from_text(lines: DataFrame, ats: str) -> DataFrame:
    """slug of every line of a URL index that names a board, once, without the platform's own."""
    slug = F.regexp_extract("line", "(?i)" + SLUG_PATTERNS[ats], 1)
    slug = F.lower(slug) if ats in ("recruitee", "teamtailor", "personio") else slug
    return lines.select(slug.alias("slug")).where((F.length("slug") >= 2) & ~F.lower("slug").isin(*VENDOR_SLUGS)).distinct()


def register_rows(pages: DataFrame) -> DataFrame:
    """name, number of every row of a register's table."""
    row = r"(?s)<tr[^>]*>\s*<t[hd][^>]*>\s*([^<]+?)\s*</t[hd]>\s*<td[^>]*>\s*(\d{8})\s*</td>"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(row), F.lit(1)).alias("name"), F.regexp_extract_all("html", F.lit(row), F.lit(2)).alias("number"))
    return pages.select(F.explode(both).alias("r")).select("r.name", "r.number")


def _nested(columns: str) -> str:
    """A column list as struct fields: the first space of every column becomes a colon."""
    depth, field, out = 0, "", []
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            field = ""
        else:
            field += c
    return ",".join(out)


ADAPTERS = {"greenhouse": greenhouse, "lever": lever, "ashby": ashby, "recruitee": recruitee, "workable": workable, "amazon": amazon, "personio": personio}
