"""Queries over texts, titles and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import agents, normalize, skills, text
from tidemark.operators import duplicates
from tidemark.operators.landing import slugify
from tidemark.operators.rows import by_distinct, with_positions
from tidemark.sources import standin
from tidemark.sources.standin import POSTINGS_SQL

QUERIES, ORACLE_SQL = {}, {}


def register_in(queries: dict, oracles: dict):
    """What adds a query, and its SQL if there is any, to a module's tables."""

    def register(name: str, query, sql: str | None = None) -> None:
        queries[name] = query
        if sql:
            oracles[name] = sql

    return register


register = register_in(QUERIES, ORACLE_SQL)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _listed(values: list[str]) -> str:
    """An array of texts, valid in Spark and DuckDB by its brackets."""
    return ", ".join(map(_sql, values))


def _spark(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _pick(values: list[str], n: str = "id") -> str:
    """The text of a row in Spark."""
    return f"element_at(array({', '.join(map(_spark, values))}), cast({n} % {len(values)} + 1 as int))"


def _picked(values: list[str], n: str = "id") -> str:
    """The text of a row in DuckDB."""
    return f"([{_listed(values)}])[{n} % {len(values)} + 1]"


def _case(text: str, patterns: dict[str, str], other: str = "NULL") -> str:
    """The first name whose pattern occurs in ``text``."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_sql('(?i)' + rx)}) THEN {_sql(name)}" for name, rx in patterns.items()) + f" ELSE {other} END"


_NAMED_PLACES = [p.replace("\\b", "") for rx in normalize.CITIES.values() for p in rx.split("|")]
_PLACES = [f"{p.title() if k % 2 else p} {('office', ', NL', '(hybrid)', '/ elsewhere')[k % 4]}" for k, p in enumerate(_NAMED_PLACES)] + ["Bestwick", "Delfter Weg", "Gent", "", "Edegem"]
_ABROAD = [p for p in normalize.ABROAD.removeprefix(r"\b(").removesuffix(r")\b").split("|") if p.isascii() and p.replace(" ", "").isalpha()]
_LOCATIONS = _PLACES + _ABROAD + ["Remote", "Remote - Netherlands", "Nederland", "anywhere in Holland", "Work from home", "thuiswerken", "Somewhere", "Parisian"]


_TEXT = "coalesce(text, '')"
_PATTERNS = {n: p.replace("'", "''") for n, p in (("nl", text.DUTCH_WORDS), ("en", text.ENGLISH_WORDS), ("de", text.GERMAN_WORDS))}
_COUNT = {n: f"len(regexp_extract_all(lower({_TEXT}), '{p}'))" for n, p in _PATTERNS.items()}
# RE2's word boundary is ASCII: the oracle folds accented letters to plain ones around words
register("x14_language", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", text.detect_language(F.concat_ws(" ", "title", F.when(F.col("id") % 2 == 0, "wij zoeken een collega voor het team").otherwise("join the team and work with us"))).alias("language")),
         f"WITH {POSTINGS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'nl' ELSE 'en' END AS language FROM postings")
# DuckDB's word boundary is ASCII: accented letters count as a plain one
_FOLDED = f"regexp_replace(lower({_TEXT}), '[À-ɏ]', 'x', 'g')"
_HITS = {n: f"len(regexp_extract_all({_FOLDED}, {_sql(p.replace('für', 'fxr'))}))" for n, p in (("nl", text.DUTCH_WORDS), ("en", text.ENGLISH_WORDS), ("de", text.GERMAN_WORDS))}
register("x14_document_language", lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", text.detect_language(F.coalesce("text", F.lit(""))).alias("language")),
         f"WITH c AS (SELECT doc_id, {', '.join(f'{e} AS {n}' for n, e in _HITS.items())} FROM documents) SELECT doc_id, CASE WHEN nl = 0 AND en = 0 OR de > greatest(nl, en) THEN 'other' WHEN nl > en THEN 'nl' ELSE 'en' END AS language FROM c")
register("x5_scrub_contact", lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", F.sha1(normalize.scrub_contact(F.coalesce("text", F.lit("")))).alias("hash")),
         f"SELECT doc_id, sha1(regexp_replace(regexp_replace({_TEXT}, {_sql(normalize.E_MAIL)}, '[e-mail]', 'g'), {_sql(normalize.PHONE)}, '[telefoon]', 'g')) AS hash FROM documents")
register("x6_norm_title", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", normalize.norm_title(F.col("title")).alias("title")),
         f"WITH {POSTINGS_SQL} SELECT id, trim(regexp_replace(lower(title), '[^a-z0-9+#.]+', ' ', 'g')) AS title FROM postings")
register("x6_dedup_key", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", normalize.dedup_key(F.col("company"), F.col("title"), F.col("city")).alias("key")),
         f"WITH {POSTINGS_SQL} SELECT id, sha1(lower(company) || '|' || trim(regexp_replace(lower(title), '[^a-z0-9+#.]+', ' ', 'g')) || '|' || lower(coalesce(city, ''))) AS key FROM postings")
register("x6_content_hash", lambda spark, sf_dir: docs(spark, sf_dir).select("doc_id", normalize.content_hash(F.col("source"), F.coalesce("text", F.lit(""))).alias("hash")),
         f"SELECT doc_id, sha256(trim(source) || chr(10) || trim({_TEXT})) AS hash FROM documents")
register("x1_detect_city", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", normalize.detect_city(F.expr(_pick(_PLACES))).alias("city")),
         f"WITH {POSTINGS_SQL}, t AS (SELECT id, {_picked(_PLACES)} AS place FROM postings) SELECT id, {_case('place', normalize.CITIES)} AS city FROM t")
_HOME = " OR ".join(f"regexp_matches(place, {_sql('(?i)' + rx)})" for rx in (*normalize.CITIES.values(), normalize.HOME))
register("x2_detect_country", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", normalize.detect_country(F.expr(_pick(_LOCATIONS)), F.expr("case id % 11 when 0 then 'nl' when 1 then '' end")).alias("country")),
         f"WITH {POSTINGS_SQL}, t AS (SELECT id, {_picked(_LOCATIONS)} AS place FROM postings) SELECT id, CASE WHEN id % 11 = 0 THEN 'NL' WHEN {_HOME} THEN 'NL' WHEN regexp_matches(place, {_sql('(?i)' + normalize.ABROAD)}) THEN 'XX' END AS country FROM t")
register("x3_is_remote", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", normalize.is_remote(F.expr(_pick(_LOCATIONS)), F.expr("if(id % 5 = 0, null, remote)")).alias("remote")),
         f"WITH {POSTINGS_SQL}, t AS (SELECT id, remote, {_picked(_LOCATIONS)} AS place FROM postings) SELECT id, (id % 5 <> 0 AND remote) OR regexp_matches(place, {_sql('(?i)' + normalize.ANYWHERE)}) AS remote FROM t")
register("x7_plausible_posted", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", normalize.plausible_posted(F.col("posted_at"), "2001-06-01 00:00:00").alias("posted_at")),
         f"WITH {POSTINGS_SQL} SELECT id, CASE WHEN posted_at <= TIMESTAMP '2001-06-03' AND year(posted_at) >= 2000 THEN posted_at END AS posted_at FROM postings")
register("x30_slugs", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("company").distinct().select("company", slugify(F.col("company")).alias("slug")),
         f"WITH {POSTINGS_SQL} SELECT DISTINCT company, trim(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM postings")
register("x31_url_helpers", lambda spark, sf_dir: standin.table(spark, sf_dir, "pages").select("page_id", duplicates.url_stem(F.col("url")).alias("stem"), duplicates.language_stem(F.col("url")).alias("lang_stem"), duplicates.language_rank(F.col("url")).alias("lang_rank")), """
    SELECT page_id, lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '')) AS stem,
           regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www\\.', '') || '/' || array_to_string(list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda s: s NOT IN ('', 'en', 'fr', 'de', 'es')), '/') AS lang_stem,
           CASE regexp_extract(url, '://[^/?#]*/([a-z]{2})/', 1) WHEN 'en' THEN 0 WHEN '' THEN 1 ELSE 3 END AS lang_rank FROM pages""")
_TITLES = {  # a title of each kind of job that a plain word names
    "PhD candidate optics": "phd_research", "Product Manager (m/f/d)": "product_manager", "Product Owner - payments": "product_owner", "Scrum Master": "scrum_agile", "Projectleider ICT": "project_manager", "Head of Engineering": "engineering_manager",
    "UX Designer": "ux_designer", "Privacy Officer": "security_officer", "SOC Engineer": "security_engineer", "Data Scientist": "data_scientist", "MLOps Engineer": "ml_engineer", "Data Governance Lead": "data_consultant", "Data Architect": "data_architect",
    "Data-analist": "bi_analyst", "Data Engineer, Utrecht": "data_engineer", "Business Analyst": "business_analyst", "Enterprise Architect": "architect", "Presales Expert": "sales_engineer", "Mendix Developer": "low_code", "Firmware Engineer": "embedded",
    "PLC Programmer": "plc_automation", "Hardware Engineer": "hardware", "CFD Specialist": "simulation", "Test Automation Engineer": "qa_test", "Dev-Ops Engineer": "devops", "Site Reliability Engineer": "platform_sre", "Azure Engineer": "cloud",
    "Netwerkbeheerder": "network", "Linux Administrator": "systems", "Applicatiebeheerder": "app_admin", "Helpdesk medewerker": "it_support", "SAP ABAP Developer": "software_engineer", "ERP Consultant": "it_consultant", "Android Developer": "mobile",
    "Front-end Developer": "frontend", "Full Stack Developer": "fullstack", "Java Programmeur": "software_engineer", "Automation Engineer": "plc_automation", "Mechanical Engineer": "software_engineer", "Kok": "other",
}
register("x26_positions", lambda spark, sf_dir: with_positions(standin.postings(spark, sf_dir, skills=False).select("id", F.expr(_pick(list(_TITLES))).alias("title"))).select("id", "position"),
         f"WITH {POSTINGS_SQL} SELECT id, {_picked(list(_TITLES.values()))} AS position FROM postings")
# the skills whose patterns DuckDB can read too; tests hold all of them against plain Python
_PLAIN_SKILLS = {name: rx for name, rx in skills.TAXONOMY.items() if not any(x in rx for x in ("(?=", "(?!", "(?<"))}
_SKILL_TEXTS = [f"We use {a.lower() if k % 2 else a} and ({b}) daily." for k, (a, b) in enumerate(zip(skills.TAXONOMY, [*skills.TAXONOMY][7:] + [*skills.TAXONOMY][:7]))]
_FOUND_SKILLS = ", ".join(f"CASE WHEN regexp_matches(t, {_sql('(?i)' + rx)}) THEN {_sql(name)} END" for name, rx in _PLAIN_SKILLS.items())
register("x12_find_skills", lambda spark, sf_dir: by_distinct(standin.postings(spark, sf_dir, skills=False), F.concat_ws(" ", "title", F.expr(_pick(_SKILL_TEXTS))), found=lambda t: skills.find_skills(t, _PLAIN_SKILLS)).select(F.explode("found").alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n")),
         f"WITH {POSTINGS_SQL}, s AS (SELECT id, title || ' ' || {_picked(_SKILL_TEXTS)} AS t FROM postings), f AS (SELECT unnest([{_FOUND_SKILLS}]) AS skill FROM s) SELECT skill, count(*) AS n FROM f WHERE skill IS NOT NULL GROUP BY skill")
_LEVEL_TITLES = [("Senior Engineer", "senior"), ("Stage Data", "intern"), ("Data Traineeship", "trainee"), ("Junior Cook", "junior"), ("Medior Tester", "medior"), ("Principal Engineer", "staff"), ("Head of Data", "manager"), ("Tech Lead Java", "lead"), ("Product Manager", ""), ("Engineer", ""),
           ("Backstage Host", ""), ("Starter", "trainee"), ("Landscape Architect", ""), ("Solution architect", "lead"), ("Sr. Nurse", "senior"), ("Afstudeerder Bouw", "intern"), ("Senior Account Manager", "senior"), ("Associate", "junior"), ("Headline Writer", ""), ("WERKSTUDENT", "intern")]
register("x20_seniority", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", text.detect_seniority(F.expr(_pick([t for t, _ in _LEVEL_TITLES])), F.col("years_experience")).alias("seniority")),
         f"WITH {POSTINGS_SQL} SELECT id, coalesce(nullif({_picked([x for _, x in _LEVEL_TITLES])}, ''), CASE WHEN years_experience >= 5 THEN 'senior' WHEN years_experience >= 3 THEN 'medior' WHEN years_experience IS NOT NULL THEN 'junior' ELSE 'unknown' END) AS seniority FROM postings")
_PAY = "CASE id % 7 WHEN 0 THEN concat('We offer € ', id % 60 + 10, '.000 - € ', id % 60 + 20, '.000 per year.') WHEN 1 THEN concat('EUR ', id % 9 + 1, ',500 per month') WHEN 2 THEN concat('€', id % 80 + 10, 'k-€', id % 80 + 5, 'k') WHEN 3 THEN concat('a laptop of €2500, and salaris euro ', id % 9 + 2, '250 tot eur ', id % 9 + 3, '250 bruto per maand') WHEN 4 THEN '€500 for a laptop' WHEN 5 THEN 'EUR 450.000 - EUR 600.000' END"
_LOW = "CASE id % 7 WHEN 0 THEN (id % 60 + 10) * 1000 WHEN 1 THEN (id % 9 + 1) * 12000 + 6000 WHEN 2 THEN (id % 80 + 10) * 1000 WHEN 3 THEN ((id % 9 + 2) * 1000 + 250) * 12 END"
_HIGH = "CASE id % 7 WHEN 0 THEN (id % 60 + 20) * 1000 WHEN 3 THEN ((id % 9 + 3) * 1000 + 250) * 12 END"
register("x22_salary", lambda spark, sf_dir: by_distinct(standin.postings(spark, sf_dir, skills=False).select("id"), F.expr(_PAY), s=text.parse_salary).select("id", "s.low", "s.high"),
         f"WITH {POSTINGS_SQL}, p AS (SELECT id, {_LOW} AS low, {_HIGH} AS high FROM postings) SELECT id, CASE WHEN low BETWEEN 20000 AND 400000 THEN low END AS low, CASE WHEN low BETWEEN 20000 AND 400000 THEN high END AS high FROM p")
register("x9_html_to_text", lambda spark, sf_dir: standin.table(spark, sf_dir, "pages").select("page_id", F.sha1(text.html_to_text(F.col("html"))).alias("hash")), r"""
    WITH a AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    b AS (SELECT page_id, CASE WHEN NOT contains(t, '<') AND contains(t, '&lt;') THEN replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') ELSE t END AS t FROM a),
    c AS (SELECT page_id, regexp_replace(t, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') AS t FROM b),
    d AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|ul|ol)\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM c),
    e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS t FROM d),
    f AS (SELECT page_id, regexp_replace(regexp_replace(t, '[ \t\r\f\x0B]+', ' ', 'g'), ' ?\n ?', chr(10), 'g') AS t FROM e)
    SELECT page_id, sha1(trim(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))) AS hash FROM f""")
# user agents of every system and browser, some of them crawlers': (text, what it is)
_SYSTEMS = [("iPhone; CPU iPhone OS 17_0 like Mac OS X", "iOS", "mobile"), ("iPad; CPU OS 16_0 like Mac OS X", "iOS", "tablet"), ("Linux; Android 14; Mobile", "Android", "mobile"), ("Linux; Android 13; Tablet", "Android", "tablet"),
            ("Windows NT 10.0; Win64", "Windows", "desktop"), ("Macintosh; Intel Mac OS X 10_15", "macOS", "desktop"), ("X11; CrOS x86_64", "ChromeOS", "desktop"), ("X11; Linux x86_64", "Linux", "desktop"), ("SymbianOS/9.1", "Other", "desktop")]
_BROWSERS = [("Chrome/120.0 Safari/537.36 Edg/120.0", "Edge"), ("Chrome/119.0 Safari/537.36 OPR/105", "Opera"), ("SamsungBrowser/23.0 Chrome/115.0 Safari/537.36", "Samsung Internet"), ("Gecko/20100101 Firefox/121.0", "Firefox"), ("AppleWebKit/605 CriOS/120 Safari/604", "Chrome"), ("Version/17.0 Safari/605", "Safari"), ("Konqueror/5.0", "Other")]
_CRAWLERS = [("", None), (" ", None), (" rv:1", None), (" (compatible; Googlebot/2.1)", "Googlebot"), (" bingbot/2.0", "bingbot"), (" GPTBot/1.1", "GPTBot"), (" PetalBot", "PetalBot"), (" my-crawler 1", "Bot"), (" HeadlessChrome/119", "Headless"), (" UptimeRobot/2.0", "Uptime monitor"), (" Slackbot-LinkExpanding", "Slackbot")]
_AT = ("event_id", "(event_id {div} 9)", "(event_id {div} 63)")
_spark_at, _duck_at = ([x.replace("{div}", d) for x in _AT] for d in ("div", "//"))
_AGENT = f"if(event_id % 101 = 0, null, concat('Mozilla/5.0 (', {_pick([x[0] for x in _SYSTEMS], _spark_at[0])}, ') ', {_pick([x[0] for x in _BROWSERS], _spark_at[1])}, {_pick([x[0] for x in _CRAWLERS], _spark_at[2])}))"
_CRAWLER = f"nullif({_picked([x[1] or '' for x in _CRAWLERS], _duck_at[2])}, '')"
register("c1_parse_agent", lambda spark, sf_dir: by_distinct(standin.page_views(spark, sf_dir).select("event_id"), F.expr(_AGENT), a=agents.parse_agent).select("event_id", "a.*"),
         f"""WITH a AS (SELECT event_id, event_id % 101 = 0 AS none, {_CRAWLER} AS crawler, {_picked([x[1] for x in _BROWSERS], _duck_at[1])} AS browser, {_picked([x[1] for x in _SYSTEMS], _duck_at[0])} AS os, {_picked([x[2] for x in _SYSTEMS], _duck_at[0])} AS device FROM events)
    SELECT event_id, CASE WHEN none THEN 'Unknown' ELSE coalesce(crawler, browser) END AS browser, CASE WHEN none THEN 'Unknown' ELSE os END AS os,
           CASE WHEN none THEN 'unknown' WHEN crawler IS NOT NULL THEN 'bot' ELSE device END AS device, none OR crawler IS NOT NULL AS bot FROM a""")  # fmt: skip
register("c2_classify_path", lambda spark, sf_dir: standin.page_views(spark, sf_dir).groupBy(agents.classify_path(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
         "SELECT CASE event_type WHEN 'error' THEN 'api' ELSE 'page' END AS kind, count(*) AS n FROM events GROUP BY 1")
register("c3_referrer", lambda spark, sf_dir: standin.table(spark, sf_dir, "pages").select("page_id", agents.referrer_host(F.col("url"), "ththre.example.com").alias("host")),
         r"SELECT page_id, nullif(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', ''), 'ththre.example.com') AS host FROM pages")
register("c4_visitor", lambda spark, sf_dir: standin.page_views(spark, sf_dir).select("event_id", agents.visitor_id(F.lit("salt"), F.col("visitor"), F.col("browser")).alias("visitor")),
         "SELECT event_id, left(sha256('salt|' || lpad(CAST(user_id AS VARCHAR), 8, '0') || '|' || CASE WHEN user_id % 10 = 9 THEN 'Bot' || (user_id % 3) ELSE 'Browser' || (user_id % 5) END), 16) AS visitor FROM events")
_QUERY = "concat('page=', event_id % 3, '&q=', if(user_id % 5 = 0, '', concat('data+', repeat('x', cast(event_id % 60 as int)), user_id)), '&city=', if(user_id % 3 = 0, 'Den%20Haag', ''), '&remote=', user_id % 2 = 0, if(event_id % 7 = 0, '&ids=1,2', '&ids='), '&junk=', user_id, '&skill=C%2B%2B')"
register("c5_search_detail", lambda spark, sf_dir: standin.table(spark, sf_dir, "events").select("event_id", agents.search_detail(F.expr(_QUERY)).alias("detail")),
         """SELECT event_id, CASE WHEN event_id % 3 = 1 AND event_id % 7 <> 0 THEN concat_ws('&', CASE WHEN user_id % 5 <> 0 THEN 'q=' || left('data ' || repeat('x', CAST(event_id % 60 AS INTEGER)) || user_id, 40) END,
            CASE WHEN user_id % 3 = 0 THEN 'city=Den Haag' END, 'skill=C++', CASE WHEN user_id % 2 = 0 THEN 'remote=true' END) END AS detail FROM events""")  # fmt: skip
