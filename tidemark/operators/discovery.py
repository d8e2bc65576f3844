"""Finding employers' boards in landed pages, sitemaps and robots files.

Nulls count as empty; a page without boards or links gives no row; repeated rows give repeated results; other columns are
not read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.links import authority, is_detail, path_of
from tidemark.functions.normalize import folded

# How an address shows a board's platform and slug, in order; (?i) where case does not matter.
BOARD_PATTERNS = [
    ("greenhouse", r"(?i)boards(?:-api)?\.greenhouse\.io/(?:v1/boards/)?([a-z0-9_-]+)"),
    ("greenhouse", r"(?i)job-boards\.greenhouse\.io/([a-z0-9_-]+)"),
    ("greenhouse", r"(?i)greenhouse\.io/embed/job_board(?:/js)?\?for=([a-z0-9_-]+)"),
    ("lever", r"(?i)jobs\.lever\.co/([a-z0-9_-]+)"),
    ("ashby", r"(?i)jobs\.ashbyhq\.com/([a-z0-9_-]+)"),
    ("ashby", r"(?i)api\.ashbyhq\.com/posting-api/job-board/([a-z0-9_-]+)"),
    ("workable", r"(?i)apply\.workable\.com/(?:api/v1/widget/accounts/)?([a-z0-9_-]+)"),
    ("recruitee", r"(?i)https?://([a-z0-9-]+)\.recruitee\.com"),
    ("teamtailor", r"(?i)https?://([a-z0-9-]+)\.teamtailor\.com"),
    ("workday", r"https?://([a-z0-9-]+\.wd\d+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]+)"),
    ("personio", r"(?i)https?://([a-z0-9-]+)\.jobs\.personio\.(?:de|com)"),
    ("smartrecruiters", r"(?:careers|jobs)\.smartrecruiters\.com/([A-Za-z0-9_-]+)"),
    ("homerun", r"(?i)https?://(?!(?:static|cdn|feed|app|www|api)\.)([a-z0-9-]+)\.homerun\.co"),
]
# Names of the platforms' own hosts and paths.
NO_BOARDS = {
    "workable": ("api", "j", "jobs", "widget"),
    "recruitee": ("careers-analytics", "api", "career", "careers", "app", "cdn", "static", "assets", "www"),
    "teamtailor": ("www", "app", "tt", "api", "cdn", "static", "assets", "images", "attachments"),
    "homerun": ("cdn", "static", "feed", "www", "app", "api", "assets"),
    "personio": ("www", "app", "api", "cdn"),
    "greenhouse": ("www", "boards", "app", "api"),
    "lever": ("www", "api"),
    "ashby": ("www", "api"),
}
CAREERS = r"career|careers|jobs|job\b|vacature|vacatures|werken[- ]bij|work[- ]with[- ]us|join[- ]us|join[- ]the[- ]team|open[- ]positions|opportunities|werkenbij|recruitment|we'?re hiring|hiring"
PLATFORM_HOSTS = r"greenhouse|lever\.co|ashbyhq|workable|recruitee|teamtailor|myworkdayjobs|personio|smartrecruiters|homerun"
READ_BY_ADAPTER = r"(?:^|\.)(?:myworkdayjobs\.com|greenhouse\.io|lever\.co|ashbyhq\.com|workable\.com|recruitee\.com|teamtailor\.com|personio\.de|personio\.com|smartrecruiters\.com)$"


def boards_on_pages(pages: DataFrame) -> DataFrame:
    """page_id, nth, ats, slug: the boards that a page's markup (html) names, each once, in order of the patterns."""
    html = F.coalesce("html", F.lit(""))

    def boards(ats: str, rx: str) -> Column:
        slugs = F.regexp_extract_all(html, F.lit(rx), F.lit(1))
        if ats == "workday":
            slugs = F.zip_with(slugs, F.regexp_extract_all(html, F.lit(rx), F.lit(2)), lambda a, b: F.concat(a, F.lit("/"), b))
        if names := NO_BOARDS.get(ats):
            slugs = F.filter(slugs, lambda s: ~F.lower(s).isin(*names))
        return F.transform(slugs, lambda s: F.struct(F.lit(ats).alias("ats"), s.alias("slug")))

    found = [boards(ats, rx) for ats, rx in BOARD_PATTERNS]
    return pages.select("page_id", F.posexplode(F.array_distinct(F.concat(*found))).alias("nth", "b")).select("page_id", "nth", "b.ats", "b.slug")


def careers_links(pages: DataFrame, top: int = 5) -> DataFrame:
    """page_id, rank, href: the links of a page (url, html) that most look like the way to its jobs, by their text, address and platform."""
    anchor = F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)[^>]*>(.*?)</a\s*>""")
    both = F.arrays_zip(F.regexp_extract_all("html", anchor, F.lit(1)).alias("href"), F.regexp_extract_all("html", anchor, F.lit(2)).alias("label"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("base"), F.posexplode(both).alias("at", "a")).select("page_id", "base", "at", F.split("a.href", "#")[0].alias("given"), F.trim(F.regexp_replace(F.regexp_replace("a.label", "<[^>]*>", " "), r"\s+", " ")).alias("label"))
    root, folder = F.regexp_extract("base", r"^([^:/?#]+://[^/?#]*)", 1), F.regexp_extract("base", r"^([^:/?#]+://[^?#]*/)[^/?#]*", 1)
    given = F.col("given")
    full = F.when(given.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), given).when(given.startswith("//"), F.concat(F.regexp_extract("base", r"^([^:/?#]+:)", 1), given)).when(given.startswith("/"), F.concat(root, given)).when(given == "", F.split("base", "#")[0]).otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(root, F.lit("/"))), given))
    rows = rows.withColumn("href", full).withColumns({"host": F.lower(authority(F.col("href"))), "own": F.replace(F.lower(authority(F.col("base"))), F.lit("www."))})
    says = lambda c: c.rlike(folded(CAREERS))
    score = says(F.col("label")).cast("int") * 2 + says(F.concat_ws(" ", path_of(F.col("href")), "host")).cast("int") * 2 + F.col("host").rlike(PLATFORM_HOSTS).cast("int") * 3
    kept = rows.withColumn("score", score).where((F.col("score") > 0) & (F.contains("host", F.col("own")) | says(F.col("host")) | (F.col("score") >= 3)))
    best = kept.groupBy("page_id", "href").agg(F.min(F.struct((-F.col("score")).alias("score"), "at")).alias("b"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("b"))  # a page's own links
    return best.withColumn("rank", nth).where(F.col("rank") <= top).select("page_id", "rank", "href")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """host, rules: what a robots file (host, text) tells this agent: the group that names it, else that for all; arrays of (allow, pattern), as long as the file."""
    lines = files.select("host", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n|\r")).alias("at", "line"))
    line = F.trim(F.split("line", "#")[0])
    keyed = lines.select("host", "at", F.lower(F.trim(F.split(line, ":", 2)[0])).alias("key"), F.trim(F.get(F.split(line, ":", 2), F.lit(1))).alias("value")).where("value is not null")
    by_host = Window.partitionBy("host").orderBy("at")  # the lines of one file
    named = F.col("key") == "user-agent"
    starts = named & ~F.coalesce(F.lag("key").over(by_host) == "user-agent", F.lit(False))
    grouped = keyed.withColumn("group", F.sum(starts.cast("int")).over(by_host))
    agents = grouped.where(named).select("host", "group", "at", F.lower("value").alias("name"))
    ours = (F.col("name") != "*") & (F.col("name") != "") & F.contains(F.lit(agent.lower()), F.col("name"))
    first = agents.where(ours).groupBy("host").agg(F.min_by("name", "at").alias("mine"))
    wanted = agents.join(first, "host", "left").where(F.col("name") == F.coalesce("mine", F.lit("*"))).select("host", "group").distinct()
    rules = grouped.where(F.col("key").isin("allow", "disallow") & (F.col("value") != "")).join(wanted, ["host", "group"])
    return rules.groupBy("host").agg(F.collect_list(F.struct((F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"))).alias("rules"))


def with_robots_verdict(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (host, path and what else they have) with ``allowed``: the longest pattern that fits a path decides, Allow at equal lengths, and without one all is allowed."""
    quoted = lambda p: F.regexp_replace(p, r"([\\.\[\]{}()+?^|$])", r"\\$1")

    def fits(pattern: Column, path: Column) -> Column:
        ends = pattern.endswith("$")
        bare = F.when(ends, F.substr(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
        return F.rlike(path, F.concat(F.lit("(?s)^"), F.replace(quoted(bare), F.lit("*"), F.lit(".*")), F.when(ends, F.lit(r"\z")).otherwise(F.lit(""))))

    joined = urls.join(rules.select(F.col("host").alias("_host"), F.col("rules").alias("_rules")), F.col("host") == F.col("_host"), "left")
    best = F.array_max(F.transform(F.filter("_rules", lambda r: fits(r["pattern"], F.col("path"))), lambda r: F.struct(F.length(r["pattern"]).alias("n"), r["allow"].alias("allow"))))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("_host", "_rules")


def job_sitemaps(entries: DataFrame, least: int = 3) -> DataFrame:
    """domain, sitemap, jobs, sample: each domain's sitemap with most addresses of single postings, ``least`` or more, one of whose first three pages has a posting's data.

    ``entries``: domain, sitemap, nth (order of the sitemap), at (order in it), url, has_posting (of fetched pages, else null).
    Sitemaps on platforms that adapters read do not count; at equal numbers the first in order wins.
    """
    rows = entries.where(~F.lower(authority(F.col("sitemap"))).rlike(READ_BY_ADAPTER) & is_detail(F.col("url")))
    place = F.row_number().over(Window.partitionBy("domain", "sitemap").orderBy("at", "url"))
    tried = rows.withColumn("place", place)
    sample = F.min_by("url", F.when((F.col("place") <= 3) & F.coalesce("has_posting", F.lit(False)), F.col("place")))
    each = tried.groupBy("domain", "sitemap").agg(F.min("nth").alias("nth"), F.count(F.lit(1)).alias("jobs"), sample.alias("sample")).where((F.col("jobs") >= least) & F.col("sample").isNotNull())
    return each.groupBy("domain").agg(F.max_by(F.struct("sitemap", "jobs", "sample"), F.struct("jobs", (-F.col("nth")).alias("n"), "sitemap")).alias("b")).select("domain", "b.*")


def _site(domain: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(domain, "^https?://", ""), "/.*$|^/+", "")), r"^www\.", "")


def guessed_slugs(domain: Column) -> Column:
    """Slugs that a board of the domain's owner may have."""
    base = F.split(_site(domain), r"\.")[0]
    return F.array_distinct(F.filter(F.array(base, F.replace(base, F.lit("-"), F.lit("")), F.replace(base, F.lit("-"), F.lit("_"))), lambda s: F.length(s) >= 2))


def careers_hosts(domain: Column) -> Column:
    """Hosts on which the domain's owner may list jobs, the likeliest first."""
    d = _site(domain)
    name = F.split(d, r"\.")[0]
    hosts = [F.concat(F.lit("www."), d), d, *(F.concat(F.lit(p), d) for p in ("werkenbij.", "careers.", "jobs.")), *(F.concat(F.lit(p), name, F.lit(".nl")) for p in ("werkenbij", "www.werkenbij", "werkenbij-"))]
    return F.array_distinct(F.array(*hosts))
