"""Addresses, link checks and employers' names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.normalize import folded, slug

# Phrases of a page whose posting is gone.
GONE_TEXT = (
    r"no longer (?:available|accepting|open)|this (?:job|position|vacancy|posting|role) (?:has been|is) (?:filled|closed|removed|expired)|position has been filled|job not found|vacancy not found|"
    r"applications? (?:are|is) (?:now )?closed|(?:we are|we're) no longer (?:recruiting|hiring) for|this (?:job|vacancy|posting) (?:has )?expired|(?:the )?application (?:deadline|period) has (?:passed|ended)|"
    r"vacature is (?:gesloten|vervuld|verlopen|ingevuld|niet meer (?:beschikbaar|actief|open))|deze vacature (?:bestaat niet|is niet meer|is inmiddels)|niet langer beschikbaar|"
    r"sollicitatietermijn is (?:verlopen|gesloten|voorbij)|de sluitingsdatum is verstreken|reageren (?:op deze vacature )?is niet meer mogelijk|deze functie is (?:inmiddels )?(?:vervuld|ingevuld)|"
    r"stelle ist (?:bereits )?besetzt|nicht mehr verf.gbar"
)
GONE_TITLE = r"not found|404|no longer|expired|gesloten|niet gevonden|bestaat niet"
LISTING_PATHS = ["", "/jobs", "/careers", "/vacatures", "/en", "/nl"]
STARTING_PATHS = ["", "/jobs", "/careers"]
# What the address of one posting looks like.
JOB_WORD = r"/(?:jobs?|vacatures?|vacancies|vacancy|vacature|careers?/[a-z-]*jobs?|job-?offers?|werken-bij[^/]*/vacatures?|carriere/vacatures?|positions?|openings?)/"
DETAIL = r"(?:\d{3,}|[a-z0-9]+(?:[-_]+[a-z0-9]+){2,})(?:\.html?|\.aspx?)?/?(?:\?.*)?$"
LISTING_TAIL = r"/(?:jobs?|vacatures?|vacancies|search|zoeken|alle-vacatures|overview)/?$"
# Legal and other words that do not tell employers apart, and words too common to.
LEGAL = (
    r"\b(b\.?\s?v\.?|n\.?\s?v\.?|v\.?o\.?f\.?|c\.?v\.?|ltd\.?|limited|gmbh|inc\.?|llc|s\.?a\.?|s\.?e\.?|plc|ag|holding|holdings|stichting|coöperatie|cooperatie|u\.?a\.?|branch|filiaal|"
    r"nederland|netherlands|the netherlands|europe|benelux|international|group|groep)\b"
)
COMMON = ["the", "and", "en", "van", "de", "der", "het", "of", "for", "services", "service", "solutions", "systems", "technologies", "technology", "consulting", "company", "global", "management", "software", "digital"]
PARKED = r"domain (?:is )?for sale|buy this domain|this domain|parked|coming soon|under construction|website coming|domeinnaam|te koop|default web site page|index of /|welcome to nginx|it works"
TLDS = ["nl", "com", "eu", "io"]
AGES = {"en": ("today", "yesterday", "d ago"), "nl": ("vandaag", "gisteren", " dagen geleden")}
# Letters that lose an accent; what is left beyond ASCII goes.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def visible_text(html: Column) -> Column:
    """A page's text without scripts, so that code is no evidence."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")


def link_verdict(status: Column, content_type: Column, url: Column, final_url: Column, html: Column, title: Column) -> Column:
    """'ok', 'gone', 'redirected' or 'error' for a fetched address; a null status is a fetch that failed, a null page an empty one.

    The posting's own title on the page counts more than any phrase. As the rule has it, the first 60,000 characters
    of a page are looked at.
    """
    page = F.when(content_type.startswith("text/html"), F.left(F.coalesce(html, F.lit("")), F.lit(60000)))
    visible = visible_text(page)
    named = (F.length(title) >= 8) & F.contains(F.lower(visible), F.left(F.lower(title), F.lit(40)))
    page_title = F.regexp_extract(F.left(page, F.lit(5000)), r"(?is)<title[^>]*>(.*?)</title>", 1)
    gone = page_title.rlike(folded(GONE_TITLE)) | F.left(visible, F.lit(20000)).rlike(folded(GONE_TEXT))
    bare = lambda u: F.regexp_replace(path_of(u), "/+$", "")
    moved = (authority(final_url) != authority(url)) | (bare(final_url).isin(LISTING_PATHS) & ~bare(url).isin(STARTING_PATHS))
    return (
        F.when(status.isNull(), "error")
        .when(status.isin(404, 410), "gone")
        .when(status >= 400, "error")
        .when(F.coalesce(moved, F.lit(False)), "redirected")
        .when(F.coalesce(named, F.lit(False)), "ok")
        .when(F.coalesce(gone, F.lit(False)), "gone")
        .otherwise("ok")
    )


def is_detail(url: Column) -> Column:
    """Whether an address looks like one posting's, not a listing's."""
    path = path_of(url)
    return F.concat(path, F.lit("/")).rlike(folded(JOB_WORD)) & path.rlike(folded(DETAIL)) & ~path.rlike(folded(LISTING_TAIL))


def registrable(host: Column) -> Column:
    """The last two labels of a host."""
    bare = F.regexp_replace(F.split(F.lower(F.coalesce(host, F.lit(""))), ":")[0], r"^www\.", "")
    return F.regexp_extract(bare, r"([^.]*\.[^.]*|[^.]*)$", 1)


def site_domain(url: Column) -> Column:
    """The registrable domain of an address, with or without its scheme; '' if it has none."""
    full = F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("https://"), url))
    return registrable(F.regexp_replace(F.regexp_extract(full, r"//([^/?#]*)", 1), r"^.*@", ""))


def head_count(text: Column) -> Column:
    """The first number of a text, grouped or not, from 1 to 3,000,000; references and number templates are seen through."""
    t = F.regexp_replace(text, r"(?s)<ref.*?(?:</ref>|/>)", " ")
    t = F.regexp_replace(t, r"(?i)\{\{(?:formatnum|nts|nowrap|circa|c\.)\s*:?\|?\s*([^}|]+)[^}]*\}\}", "$1")
    n = F.regexp_replace(F.regexp_extract(t, r"(\d{1,3}(?:[.,\s]\d{3})+|\d+)", 1), r"[.,\s]", "").try_cast("long")
    return F.when(n.between(1, 3_000_000), n)


def to_ascii(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def clean_name(name: Column) -> Column:
    """An employer's name without accents, brackets, legal words and signs."""
    n = F.regexp_replace(to_ascii(name), "[\"']", " ")
    n = F.regexp_replace(F.regexp_replace(n, r"\(.*?\)", " "), "(?i)" + LEGAL, " ")
    n = F.regexp_replace(F.regexp_replace(n, r"[^A-Za-z0-9&@+ -]+", " "), r"\s+", " ")
    return F.regexp_replace(n, r"^[ &-]+|[ &-]+$", "")


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(clean_name(name)), "[^a-z0-9]", "")


def name_words(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(clean_name(name)), F.lit("([a-z0-9]+)"), F.lit(1))


def name_tokens(name: Column) -> Column:
    """The words of a name that tell it from others."""
    return F.filter(name_words(name), lambda w: (F.length(w) >= 4) & ~w.isin(COMMON))


def domain_candidates(name: Column) -> Column:
    """Up to ten domains that an employer of this name may have, the likeliest first."""
    words = name_words(name)
    first = F.get(words, F.lit(0))
    labels = F.array(F.array_join(words, ""), F.array_join(words, "-"), F.when((F.size(words) > 1) & (F.length(first) >= 5), first))
    fitting = F.filter(labels, lambda x: F.length(x).between(2, 40))
    return F.slice(F.array_distinct(F.flatten(F.transform(fitting, lambda x: F.transform(F.array(*map(F.lit, TLDS)), lambda t: F.concat(x, F.lit("."), t))))), 1, 10)


def names_employer(name: Column, domain: Column, html: Column) -> Column:
    """Whether a home page clearly belongs to an employer: by one telling word if the domain is the whole name, else by two; a parked page does not."""
    head = F.left(html, F.lit(60000))
    title = F.regexp_replace(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")
    site = F.regexp_extract(head, r"""(?i)<meta[^>]+property=["']og:site_name["'][^>]+content=["']([^"']+)""", 1)
    label = F.lower(F.concat(title, F.lit(" "), site))
    words, key = name_tokens(name), name_key(name)
    needed = F.when((F.regexp_replace(F.split(domain, r"\.")[0], "[^a-z0-9]", "") == key) | (F.size(words) <= 1), 1).otherwise(2)
    plain = to_ascii(label)
    by_words = F.size(F.filter(words, lambda w: F.contains(plain, w))) >= needed
    by_key = (key != "") & F.contains(F.regexp_replace(plain, "[^a-z0-9]", ""), key)
    parked = (F.trim(label) == "") | label.rlike(folded(PARKED)) | F.left(head, F.lit(3000)).rlike(folded(PARKED))
    return F.coalesce(~parked & F.when(F.size(words) > 0, by_words).otherwise(by_key), F.lit(False))


def job_path(posting_id: Column, title: Column, lang: str = "en") -> Column:
    s = slug(title)
    return F.concat(F.lit("/nl/vacature/" if lang == "nl" else "/job/"), posting_id.cast("string"), F.lit("/"), F.when(s == "", "company").otherwise(s))


def company_path(company_slug: Column, lang: str = "en") -> Column:
    return F.concat(F.lit("/nl/bedrijf/" if lang == "nl" else "/company/"), company_slug)


def age_label(since: Column, as_of: str, lang: str = "en") -> Column:
    """Whole days since a time, in words."""
    today, yesterday, ago = AGES[lang]
    days = F.floor(F.timestamp_diff("SECOND", since, F.lit(as_of).cast("timestamp_ntz")) / 86400).cast("long")
    return F.when(days <= 0, today).when(days == 1, yesterday).otherwise(F.concat(days.cast("string"), F.lit(ago)))


def jobs_link(filters: Column, city: Column, lang: str = "en") -> Column:
    """The address of the job list with a page's filters: a map of name to value, false and empty values left out, and its city."""
    every = F.when(city.isNotNull(), F.map_concat(F.map_filter(filters, lambda k, v: k != "city"), F.create_map(F.lit("city"), city))).otherwise(filters)
    kept = F.filter(F.map_entries(every), lambda e: e["value"].isNotNull() & ~e["value"].isin("false", ""))
    query = F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), F.replace(F.url_encode(e["value"]), F.lit("%2C"), F.lit(",")))), "&")
    return F.concat(F.lit("/nl/#jobs" if lang == "nl" else "/#jobs"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
