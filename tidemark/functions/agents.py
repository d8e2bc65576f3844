"""Column functions over the fields of a web request: user agents, paths, referrers and visitors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.normalize import folded

# Crawlers by user agent, in order of trial.
BOTS = [
    ("Googlebot", r"googlebot|google-inspectiontool|googleother"),
    ("bingbot", r"bingbot|bingpreview"),
    ("GPTBot", r"gptbot"),
    ("ChatGPT", r"chatgpt-user|oai-searchbot"),
    ("ClaudeBot", r"claudebot|claude-user"),
    ("PerplexityBot", r"perplexity"),
    ("Applebot", r"applebot"),
    ("DuckDuckBot", r"duckduckbot"),
    ("YandexBot", r"yandex"),
    ("Baiduspider", r"baiduspider"),
    ("AhrefsBot", r"ahrefsbot"),
    ("SemrushBot", r"semrushbot"),
    ("MJ12bot", r"mj12bot"),
    ("DotBot", r"dotbot"),
    ("PetalBot", r"petalbot"),
    ("facebookexternalhit", r"facebookexternalhit|meta-externalagent"),
    ("LinkedInBot", r"linkedinbot"),
    ("Twitterbot", r"twitterbot"),
    ("Slackbot", r"slackbot"),
    ("WhatsApp", r"whatsapp"),
    ("Discordbot", r"discordbot"),
    ("Uptime monitor", r"uptimerobot|pingdom|statuscake|betteruptime"),
    ("curl", r"^curl/"),
    ("python", r"python-requests|python-httpx|aiohttp|urllib"),
    ("Go client", r"go-http-client"),
    ("Headless", r"headlesschrome|phantomjs|puppeteer|playwright"),
    ("Bot", r"bot\b|crawler|spider|scrape"),
]
# Browsers, systems and devices, in order of trial.
BROWSERS = [("Edge", r"edg/|edga/|edgios/"), ("Opera", r"opr/|opera"), ("Samsung Internet", r"samsungbrowser"), ("Firefox", r"firefox/|fxios/"), ("Chrome", r"chrome/|crios/"), ("Safari", r"safari/")]
SYSTEMS = [("iOS", r"iphone|ipad|ipod"), ("Android", r"android"), ("Windows", r"windows"), ("macOS", r"mac os x|macintosh"), ("ChromeOS", r"cros"), ("Linux", r"linux")]
DEVICES = [("tablet", r"ipad|tablet"), ("mobile", r"mobi|iphone|android")]
# Paths that are not counted, and paths of pages.
SKIPPED = r"^/(static/|metrics|healthz|readyz|favicon|api/version|api/admin|api/me|api/e$|admin/)"
PAGES = r"^/(|nl/?|vacatures/.+|jobs/.+|company/.+|companies|privacy|nl/privacy)$"


def _first(text: Column, rules: list[tuple[str, str]], other: str | None) -> Column:
    return F.coalesce(*(F.when(text.rlike(folded(rx)), F.lit(name)) for name, rx in rules), F.lit(other))


def parse_agent(agent: Column) -> Column:
    """struct(browser, os, device, bot); an empty agent is a bot."""
    text = F.coalesce(agent, F.lit(""))
    bot = _first(text, BOTS, None)
    known = F.struct(F.coalesce(bot, _first(text, BROWSERS, "Other")).alias("browser"), _first(text, SYSTEMS, "Other").alias("os"), F.when(bot.isNotNull(), "bot").otherwise(_first(text, DEVICES, "desktop")).alias("device"), bot.isNotNull().alias("bot"))
    unknown = F.struct(F.lit("Unknown").alias("browser"), F.lit("Unknown").alias("os"), F.lit("unknown").alias("device"), F.lit(True).alias("bot"))
    return F.when(text == "", unknown).otherwise(known)


def classify_path(path: Column) -> Column:
    """'crawl', 'api', 'page' or 'other'; null for paths that are not counted."""
    return F.when(path.rlike(SKIPPED), None).when(path.isin("/robots.txt", "/sitemap.xml"), "crawl").when(path.startswith("/api/"), "api").when(path.rlike(PAGES), "page").otherwise("other")


def referrer_host(header: Column, own: str) -> Column:
    host = F.regexp_replace(F.lower(F.try_parse_url(header, F.lit("HOST"))), r"^www\.", "")
    return F.when((host == "") | host.isin(own, "localhost", "127.0.0.1"), None).otherwise(F.left(host, F.lit(120)))


def visitor_id(salt: Column, ip: Column, agent: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", salt, ip, agent), 256), F.lit(16))


SEARCH_KEYS = ["q", "city", "role", "seniority", "skill", "language", "remote", "sponsorship", "english_only", "experience", "org_size"]


def search_detail(query: Column) -> Column:
    """The filters of a search's first page; null for later pages, id lists and searches without a filter."""
    value = lambda k: F.try_url_decode(F.replace(F.regexp_extract(query, rf"(?:^|&){k}=([^&]*)", 1), F.lit("+"), F.lit(" ")))
    later = ~value("page").isin("", "1") | (value("ids") != "")
    parts = F.array_compact(F.array(*(F.when(~value(k).isin("", "false"), F.concat(F.lit(f"{k}="), F.left(value(k), F.lit(40)))) for k in SEARCH_KEYS)))
    return F.when(~later & (F.size(parts) > 0), F.left(F.array_join(parts, "&"), F.lit(200)))


def recorded(requests, own_host: str, salt: Column):
    """Page-view rows of requests (ts, path, query, method, status, ms, bytes, referer, country, ip, agent, event, detail, and what else they have); paths that are not counted go."""
    api = (F.col("_kind") == "api") & F.col("path").isNotNull()
    search = api & (F.col("path") == "/api/postings") & (F.col("method") == "GET")
    found = search_detail(F.coalesce("query", F.lit("")))
    event = F.when(search, F.when(found.isNotNull(), "search")).when(api & (F.col("path") == "/api/gap"), "gap").when(api & (F.col("path") == "/api/auth/request"), "login_request").otherwise(F.col("event"))
    utm = F.try_url_decode(F.regexp_extract(F.coalesce("query", F.lit("")), r"(?:^|&)utm_source=([^&]*)", 1))
    rows = requests.withColumn("_kind", F.when(F.coalesce(F.length("event"), F.lit(0)) > 0, "event").otherwise(classify_path(F.col("path")))).where("_kind is not null")
    agent = parse_agent(F.col("agent"))
    own = {
        "kind": F.col("_kind"),
        "path": F.left("path", F.lit(300)),
        "ms": F.col("ms").cast("long"),
        "bytes": F.coalesce(F.col("bytes").cast("long"), F.lit(0)),
        "referrer": F.when(F.col("_kind") == "page", referrer_host(F.col("referer"), own_host)),
        "utm_source": F.nullif(F.left(utm, F.lit(60)), F.lit("")),
        "country": F.nullif(F.left("country", F.lit(2)), F.lit("")),
        **{k: agent[k] for k in ("browser", "os", "device", "bot")},
        "visitor": visitor_id(salt, F.col("ip"), F.coalesce("agent", F.lit(""))),
        "event": event,
        "detail": F.nullif(F.left(F.when(search, found).otherwise(F.col("detail")), F.lit(200)), F.lit("")),
    }
    kept = [c for c in requests.columns if c not in own and c not in ("query", "method", "referer", "ip", "agent")]
    return rows.select(*kept, *(e.alias(c) for c, e in own.items()))
