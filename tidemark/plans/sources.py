"""Queries over board payloads and pages: the payloads are made from postings, so that the SQL can state what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import normalize
from tidemark.operators import ingest, upkeep
from tidemark.plans.ingest import CRC_TABLE, crc_sql
from tidemark.plans.stats import NOW
from tidemark.sources import boards, sitemaps, standin, structured
from tidemark.sources.standin import AS_OF, POSTINGS_SQL

QUERIES, ORACLE_SQL = {}, {}
_STATED = {"source_id": "source_id", "external_id": "CAST(id AS VARCHAR)", "title": "title", "url": "url", "location": "NULL", "city": "NULL", "country": "NULL", "remote": "NULL", "description_html": "NULL", "posted_at": "first_seen"}
_KINDS = {"source_id": "BIGINT", "remote": "BOOLEAN", "posted_at": "TIMESTAMP"}


def register(name: str, query, sql: str) -> None:
    QUERIES[name] = query
    ORACLE_SQL[name] = f"WITH {POSTINGS_SQL} {sql}"


def landing(spark: SparkSession, sf_dir: str, payload: str, slug: str = "'board'") -> DataFrame:
    """A payload for each posting."""
    rows = standin.postings(spark, sf_dir, skills=False)
    return rows.select("id", F.col("source_id").cast("long").alias("source_id"), "url", "title", F.expr(slug).alias("slug"), F.expr(payload).alias("payload"))


def adapter(name: str, read, payload: str, where: str = "true", slug: str = "'board'", **stated: str) -> None:
    """Register an adapter over payloads made by the Spark expression ``payload``; ``stated`` is what SQL says of each column."""
    columns = _STATED | stated
    sql = ", ".join(f"CAST({e} AS {_KINDS.get(c, 'VARCHAR')}) AS {c}" for c, e in columns.items())
    register(name, lambda spark, sf_dir: read(landing(spark, sf_dir, payload, slug)).select(*columns), f"SELECT {sql} FROM postings WHERE {where}")


_DAY = "date_format(first_seen, 'yyyy-MM-dd')"
adapter(
    "s1_greenhouse", boards.greenhouse,
    f"""to_json(named_struct('jobs', array(named_struct('id', id, 'title', title, 'absolute_url', url, 'location', if(id % 3 = 0, named_struct('name', company), null),
        'offices', array(named_struct('location', '', 'name', 'HQ'), named_struct('location', company, 'name', 'x')), 'content', if(id % 2 = 0, '<p>text</p>', null),
        'first_published', if(id % 4 = 0, {_DAY}, null), 'updated_at', {_DAY}))))""",
    location="CASE WHEN id % 3 = 0 THEN company ELSE 'HQ, ' || company END", description_html="CASE WHEN id % 2 = 0 THEN '<p>text</p>' END",
)
adapter(
    "s2_lever", boards.lever,
    """to_json(array(named_struct('id', id, 'text', title, 'hostedUrl', if(id % 5 = 0, '', url), 'applyUrl', concat(url, '/apply'), 'categories', named_struct('location', if(id % 3 = 0, company, ''), 'allLocations', array('A', company)),
        'country', 'NL', 'workplaceType', if(id % 7 = 0, 'Remote', 'hybrid'), 'description', '<p>a</p>', 'lists', array(named_struct('text', 'Needs', 'content', '<li>x</li>')), 'additional', '<p>z</p>', 'createdAt', unix_millis(timestamp(first_seen)))))""",
    url="CASE WHEN id % 5 = 0 THEN url || '/apply' ELSE url END", location="CASE WHEN id % 3 = 0 THEN company ELSE 'A, ' || company END", country="'NL'", remote="CASE WHEN id % 7 = 0 THEN true END",
    description_html="'<p>a</p>' || chr(10) || '<h3>Needs</h3>' || chr(10) || '<ul><li>x</li></ul>' || chr(10) || '<p>z</p>'",
)
adapter(
    "s3_ashby", boards.ashby,
    f"""to_json(named_struct('jobs', array(named_struct('id', concat('a', id), 'title', title, 'jobUrl', url, 'location', company, 'secondaryLocations', if(id % 2 = 0, array(named_struct('location', 'B')), null), 'isRemote', id % 3 = 0, 'descriptionHtml', '<i>t</i>', 'publishedAt', {_DAY}))))""",
    external_id="'a' || id", location="company || CASE WHEN id % 2 = 0 THEN '; B' ELSE '' END", remote="CASE WHEN id % 3 = 0 THEN true END", description_html="'<i>t</i>'",
)
adapter(
    "s4_workable", boards.workable,
    f"""to_json(named_struct('jobs', array(named_struct('shortcode', concat('w', id), 'title', title, 'url', '', 'shortlink', url, 'city', if(id % 2 = 0, 'Top', ''), 'country', if(id % 3 = 0, 'Netherlands', 'Belgium'),
        'locations', if(id % 5 = 0, null, array(named_struct('city', 'First', 'region', '', 'country', 'Belgium', 'countryCode', if(id % 7 = 0, 'be', '')), named_struct('city', 'Second', 'region', null, 'country', 'X', 'countryCode', if(id % 11 = 0, 'NL', 'X')))),
        'workplace', if(id % 13 = 0, 'remote', 'on_site'), 'telecommuting', id % 17 = 0, 'description', 'd', 'requirements', '', 'benefits', 'b', 'published_on', {_DAY}))))""",
    external_id="'w' || id", location="CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 'Top, ' ELSE '' END || CASE WHEN id % 3 = 0 THEN 'Netherlands' ELSE 'Belgium' END ELSE 'First, Belgium; Second, X' END",
    city="CASE WHEN id % 2 = 0 THEN 'Top' WHEN id % 5 <> 0 THEN 'First' END", country="CASE WHEN id % 5 <> 0 AND id % 7 = 0 THEN 'BE' WHEN id % 3 = 0 OR id % 5 <> 0 AND id % 11 = 0 THEN 'NL' END",
    remote="CASE WHEN id % 13 = 0 OR id % 17 = 0 THEN true END", description_html="'d' || chr(10) || 'b'",
)
adapter(
    "s5_recruitee", boards.recruitee,
    f"""to_json(named_struct('offers', array(named_struct('id', id, 'status', if(id % 4 = 0, 'draft', if(id % 4 = 1, 'published', null)), 'title', title, 'careers_url', url, 'location', company, 'city', 'C', 'country_code', if(id % 3 = 0, 'nl', 'NLD'), 'remote', id % 5 = 0,
        'description', 'd', 'requirements', if(id % 2 = 0, 'r', null), 'published_at', null, 'created_at', {_DAY}))))""",
    where="id % 4 <> 0", location="company", city="'C'", country="CASE WHEN id % 3 = 0 THEN 'NL' END", remote="CASE WHEN id % 5 = 0 THEN true END", description_html="CASE WHEN id % 2 = 0 THEN 'd' || chr(10) || 'r' ELSE 'd' END",
)
_POSTING_JSON = f"""named_struct('@type', if(id % 4 = 0, array('JobPosting', 'Thing'), array('JobPosting')), 'title', title, 'url', if(id % 5 = 0, '/', if(id % 5 = 1, substr(url, 21), url)),
    'identifier', if(id % 3 = 0, named_struct('name', 'n', 'value', concat('v', id)), null), 'datePosted', {_DAY}, 'description', 'text', 'jobLocationType', if(id % 7 = 0, 'telecommute', null), 'hiringOrganization', named_struct('name', company),
    'jobLocation', if(id % 6 = 0, null, array(named_struct('address', named_struct('addressLocality', array('', 'Town'), 'addressRegion', named_struct('name', 'Region'), 'addressCountry', if(id % 2 = 0, 'nl', 'Nederland'), 'streetAddress', null)), named_struct('address', named_struct('addressLocality', null, 'addressRegion', null, 'addressCountry', null, 'streetAddress', 'Street 1')))))"""
_ADDRESS = "CASE WHEN id % 6 = 0 THEN NULL WHEN id % 2 = 0 THEN 'Town, Region, nl; Street 1' ELSE 'Town, Region, Nederland; Street 1' END"
_OWN_URL = "CASE WHEN id % 5 = 0 OR id % 101 = 0 THEN page_url WHEN id % 5 = 1 THEN 'https://jobs.example' || substr(url, 21) ELSE url END"
# a page's address: each tenth names a city, which counts where the posting has no place
_PAGE = "'https://jobs.example/en/page-' || id || CASE WHEN id % 10 = 0 THEN '-Delft' ELSE '' END"
_MAPPED = {"source_id": "source_id", "external_id": f"CASE WHEN id % 3 = 0 THEN 'v' || id ELSE {_OWN_URL} END", "title": "title", "url": _OWN_URL, "company": "company", "location": f"coalesce({_ADDRESS}, CASE WHEN id % 10 = 0 THEN 'Delft, Netherlands' END)",
           "city": "CASE WHEN id % 6 <> 0 THEN 'Town' END", "country": "CASE WHEN id % 6 <> 0 AND id % 2 = 0 THEN 'NL' END", "remote": "CASE WHEN id % 7 = 0 THEN true END", "description_html": "'text'", "posted_at": "first_seen"}


def _mapped_sql(**stated: str) -> str:
    columns = ", ".join(f"CAST({e} AS {_KINDS.get(c, 'VARCHAR')}) AS {c}" for c, e in (_MAPPED | stated).items())
    return f"SELECT {columns} FROM (SELECT *, {_PAGE} AS page_url FROM postings)"


def _pages(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    rows = landing(spark, sf_dir, body)
    return rows.select("source_id", F.expr("concat('https://jobs.example/en/page-', id, if(id % 10 = 0, '-Delft', ''))").alias("url"), F.col("payload").alias("html"))


# alone, in a graph, or two with a stray comma, one of which is no posting
_SCRIPTS = f"""concat('<html><script type="application/ld+json">', case id % 3 when 0 then to_json({_POSTING_JSON}) when 1 then to_json(named_struct('@graph', array({_POSTING_JSON}))) else concat('{{"@type":"Thing","a":"x\n y"}} , ', to_json({_POSTING_JSON}), ' ,') end, '</script><p>page</p>')"""
register("s10_jsonld", lambda spark, sf_dir: structured.pages(_pages(spark, sf_dir, _SCRIPTS)).select(*_MAPPED), _mapped_sql())
_MICRODATA = """concat('<div itemscope itemtype="http://schema.org/JobPosting"><h1 itemprop="title"> ', title, '</h1><meta itemprop="datePosted" content="', date_format(first_seen, 'yyyy-MM-dd'), '"><a itemprop="url" href="', url, '">go</a>',
    '<div itemprop="jobLocation"><span itemprop="address"><b itemprop="addressLocality">Town</b><meta itemprop="addressCountry" content="NL"></span></div><div itemprop="hiringOrganization"><i itemprop="name">', company, '</i></div><div itemprop="description"><p>some<br>text</p></div></div>')"""
register("s11_microdata", lambda spark, sf_dir: structured.pages(_pages(spark, sf_dir, _MICRODATA)).select(*_MAPPED),
         _mapped_sql(external_id="CASE WHEN id % 101 = 0 THEN page_url ELSE url END", url="CASE WHEN id % 101 = 0 THEN page_url ELSE url END", location="'Town, NL'", city="'Town'", country="'NL'", remote="NULL", description_html="'<p>some<br>text</p>'"))
register("s6_teamtailor", lambda spark, sf_dir: structured.teamtailor(landing(spark, sf_dir, f"""to_json(named_struct('items', array(named_struct('id', id, 'url', if(id % 2 = 0, url, ''), 'title', concat('item ', title), 'content_html', '<b>c</b>', 'date_published', '2001-02-03', '_jobposting', if(id % 8 = 0, null, {_POSTING_JSON})))))""")).select(*_MAPPED), """
    SELECT CAST(source_id AS BIGINT) AS source_id, CAST(id AS VARCHAR) AS external_id, 'item ' || title AS title, CASE WHEN id % 2 = 0 THEN url WHEN id % 8 = 0 OR id % 5 IN (0, 1) OR id % 101 = 0 THEN '' ELSE url END AS url, CASE WHEN id % 8 <> 0 THEN company END AS company,
           CASE WHEN id % 8 = 0 OR id % 6 = 0 THEN NULL WHEN id % 2 = 0 THEN 'Town, Region, nl; Street 1' ELSE 'Town, Region, Nederland; Street 1' END AS location, CASE WHEN id % 8 <> 0 AND id % 6 <> 0 THEN 'Town' END AS city,
           CASE WHEN id % 8 <> 0 AND id % 6 <> 0 AND id % 2 = 0 THEN 'NL' END AS country, CASE WHEN id % 8 <> 0 AND id % 7 = 0 THEN true END AS remote, '<b>c</b>' AS description_html,
           CASE WHEN id % 8 = 0 THEN TIMESTAMP '2001-02-03' ELSE CAST(first_seen AS TIMESTAMP) END AS posted_at FROM postings""")
adapter(
    "s7_personio", boards.personio,
    f"""concat('<feed><position><id> ', id, '</id><name>', if(id % 5 = 0, '', replace(title, '&', '&amp;')), '</name><office>', company, '</office><createdAt>', {_DAY}, '</createdAt><jobDescriptions><jobDescription><value>a</value></jobDescription><jobDescription><value>b</value></jobDescription></jobDescriptions></position></feed>')""",
    where="id % 5 <> 0", url="'https://board.jobs.personio.de/job/' || id", location="company", description_html="'a' || chr(10) || 'b'",
)
adapter(
    "s12_amazon", boards.amazon,
    """to_json(named_struct('jobs', array(named_struct('id_icims', if(id % 2 = 0, id, null), 'id', concat('z', id), 'title', concat(' ', title), 'job_path', if(id % 3 = 0, '/en/x', ''), 'location', '', 'normalized_location', if(id % 5 = 0, company, ''), 'city', 'C', 'country_code', if(id % 7 = 0, 'nld', 'FRA'),
        'description', 'd', 'posted_date', if(id % 2 = 0, date_format(first_seen, 'MMMM d, yyyy'), date_format(first_seen, 'yyyy-MM-dd'))))))""",
    external_id="CASE WHEN id % 2 = 0 THEN '' ELSE 'z' END || id", url="'https://www.amazon.jobs' || CASE WHEN id % 3 = 0 THEN '/en/x' WHEN id % 2 = 0 THEN '/en/jobs/' || id ELSE '/en/jobs/z' || id END", location="CASE WHEN id % 5 = 0 THEN company ELSE 'C' END", city="'C'",
    country="CASE WHEN id % 7 = 0 THEN 'NL' END", description_html="'d'",
)


def _smart(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    listing = landing(spark, sf_dir, """to_json(named_struct('content', array(named_struct('id', id, 'name', title, 'location', named_struct('city', 'Ede', 'region', '', 'country', if(id % 3 = 0, 'be', 'nl'), 'remote', id % 7 = 0), 'releasedDate', date_format(first_seen, 'yyyy-MM-dd')))))""")
    ad = "to_json(named_struct('postingUrl', if(id % 2 = 0, concat(url, '-long'), ''), 'jobAd', named_struct('sections', named_struct('a', named_struct('title', 'One', 'text', 'first'), 'b', named_struct('title', '', 'text', ''), 'c', named_struct('text', 'third')))))"
    details = landing(spark, sf_dir, ad).where("id % 5 <> 0").select("source_id", F.col("id").cast("string").alias("external_id"), "payload")
    known = landing(spark, sf_dir, "''").where("id % 4 = 0").select("source_id", F.col("id").cast("string").alias("external_id"))
    return structured.smartrecruiters(listing, details, known, 200)


_DUE = f", {CRC_TABLE}, s AS (SELECT *, id % 3 <> 0 AND id % 4 = 0 AND ({crc_sql('CAST(id AS VARCHAR)')} + 200) % 20 <> 0 AS skip FROM postings, crc)"
register("s9_smartrecruiters", lambda spark, sf_dir: _smart(spark, sf_dir)[0].select(*_STATED), _DUE + """
    SELECT CAST(source_id AS BIGINT) AS source_id, CAST(id AS VARCHAR) AS external_id, title, CASE WHEN id % 3 <> 0 AND id % 5 <> 0 AND id % 2 = 0 THEN url || '-long' ELSE 'https://jobs.smartrecruiters.com/board/' || id END AS url, 'Ede, ' || CASE WHEN id % 3 = 0 THEN 'be' ELSE 'nl' END AS location, 'Ede' AS city,
           CASE WHEN id % 3 = 0 THEN 'BE' ELSE 'NL' END AS country, CASE WHEN id % 7 = 0 THEN true END AS remote, CASE WHEN id % 3 <> 0 AND id % 5 <> 0 THEN '<h2>One</h2>first' || chr(10) || '<h2></h2>third' END AS description_html, CAST(first_seen AS TIMESTAMP) AS posted_at FROM s WHERE NOT skip""")
register("s9_still_listed", lambda spark, sf_dir: _smart(spark, sf_dir)[1], _DUE + " SELECT CAST(source_id AS BIGINT) AS source_id, CAST(id AS VARCHAR) AS external_id FROM s WHERE skip")


def _listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages of one posting each, numbered on each board; odd boards were searched."""
    rows = landing(spark, sf_dir, "to_json(named_struct('jobPostings', array(named_struct('title', title, 'externalPath', concat('/job/', id), 'locationsText', case id % 3 when 0 then 'Delft' when 1 then 'Gent' else 'Anywhere, Netherlands' end, 'bulletFields', if(id % 2 = 0, array(concat('R', id)), array())))))", "'acme.wd3/Careers'")
    return rows.select("source_id", "slug", (F.row_number().over(Window.partitionBy("source_id").orderBy("id")) - 1).alias("offset"), (F.col("source_id") % 2 == 1).alias("by_search"), "payload", "id")


def _workday(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = "to_json(named_struct('jobPostingInfo', named_struct('jobDescription', 'full', 'startDate', date_format(first_seen, 'yyyy-MM-dd'), 'country', named_struct('descriptor', if(id % 4 = 0, 'Belgium', 'Netherlands')))))"
    details = landing(spark, sf_dir, info).where("id % 7 <> 0").select("source_id", F.concat(F.lit("/job/"), "id").alias("path"), "payload")
    return structured.workday(_listing_pages(spark, sf_dir), details).select(*_STATED)


register("s8_workday", _workday, """, o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) - 1 AS page FROM postings), w AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS nth FROM o WHERE page < 2000 AND (source_id % 2 = 0 OR id % 3 <> 1))
    SELECT CAST(source_id AS BIGINT) AS source_id, CASE WHEN id % 2 = 0 THEN 'R' || id ELSE '/job/' || id END AS external_id, title, 'https://acme.wd3.myworkdayjobs.com/Careers/job/' || id AS url, CASE id % 3 WHEN 0 THEN 'Delft' WHEN 1 THEN 'Gent' ELSE 'Anywhere, Netherlands' END AS location, CAST(NULL AS VARCHAR) AS city,
           CASE WHEN id % 7 = 0 OR id % 4 <> 0 THEN 'NL' END AS country, CAST(NULL AS BOOLEAN) AS remote, CASE WHEN id % 7 <> 0 THEN 'full' END AS description_html, CASE WHEN id % 7 <> 0 THEN CAST(first_seen AS TIMESTAMP) END AS posted_at FROM w WHERE nth <= 400""")
_FACETS = """concat('{"facets":[{"facetParameter":"', if(id % 2 = 0, 'Location_Country', 'city'), '","values":[{"descriptor":"Netherlands ","id":"flat', id, '","count":', id % 50, '}]},',
    '{"facetParameter":"main","values":[{"descriptor":"Country/Region","facetParameter":"h1","values":[{"descriptor":"Nederland","id":"deep', id, '","count":', id % 40, '}]},{"descriptor":"Town","facetParameter":"h2","values":[{"descriptor":"Netherlands","id":"t","count":99}]}]}]}')"""
register("s8_home_facet", lambda spark, sf_dir: structured.home_facet(landing(spark, sf_dir, _FACETS)), """, c AS (SELECT source_id, 'Location_Country' AS param, 'flat' || id AS value_id, id % 50 AS count FROM postings WHERE id % 2 = 0 UNION ALL SELECT source_id, 'h1', 'deep' || id, id % 40 FROM postings)
    SELECT CAST(source_id AS BIGINT) AS source_id, param, value_id, CAST(count AS BIGINT) AS count FROM c QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY count DESC, param DESC, value_id DESC) = 1""")
register("s13_sitemap", lambda spark, sf_dir: boards.sitemap_urls(landing(spark, sf_dir, "concat('<urlset><url><loc> ', url, '?a=1&amp;b=2 </loc></url><url><loc>https://x.example/vacatures/', id, if(id % 3 = 0, '/apply', ''), '</loc></url></urlset>')")),
         """, l AS (SELECT source_id, 'https://x.example/vacatures/' || id AS url FROM postings WHERE id % 3 <> 0 UNION SELECT source_id, url || '?a=1&b=2' FROM postings), j AS (SELECT *, url LIKE '%/vacatures/%' AS job FROM l)
    SELECT CAST(source_id AS BIGINT) AS source_id, url FROM j WHERE job OR source_id NOT IN (SELECT source_id FROM j WHERE job)""")  # fmt: skip


def _landed_sitemaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every source's sitemaps, made of its postings: an index of twelve children for even sources (job maps only for every fourth), else one list."""
    rows = standin.postings(spark, sf_dir, skills=False).select(F.col("source_id").cast("long"), "id", "url")
    child = F.when(F.col("source_id") % 2 == 0, F.concat(F.expr("if(source_id % 4 = 0, '/job-map-', '/map-')"), F.lpad((F.col("id") % 12).cast("string"), 2, "0"))).otherwise("/all")
    place = F.expr("CASE id % 3 WHEN 0 THEN 'delft' WHEN 1 THEN 'gent' ELSE 'x-nl-' END")
    own = F.concat(F.lit("<url><loc> https://x.example/"), F.expr("if(id % 5 = 0, 'about', 'vacatures')"), F.lit("/"), place, F.lit("/"), "id", F.expr("if(id % 7 = 0, '/apply', '')"), F.lit("?a=1&amp;b=2 </loc></url>"))
    lists = rows.select("source_id", F.concat(F.lit("https://x.example"), child, F.lit(".xml")).alias("url"), F.struct("id", own.alias("entry")).alias("e"))
    maps = lists.groupBy("source_id", "url").agg(F.array_sort(F.collect_list("e")).alias("e"))  # one made sitemap
    maps = maps.select("source_id", "url", F.concat(F.lit("<urlset>"), F.array_join(F.transform("e", lambda x: x["entry"]), ""), F.lit("</urlset>")).alias("payload"))
    index = maps.where("source_id % 2 = 0").groupBy("source_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("url")), lambda u: F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc></sitemap>"))), "").alias("payload"))
    landed = maps.unionByName(index.select("source_id", F.lit("https://x.example/sitemap.xml").alias("url"), "payload"))
    starts = rows.select("source_id").distinct().select("source_id", F.expr("if(source_id % 2 = 0, 'https://x.example/sitemap.xml', 'https://x.example/all.xml')").alias("url"))
    return landed, starts


register("s13_sitemap_pages", lambda spark, sf_dir: sitemaps.sitemap_pages(*_landed_sitemaps(spark, sf_dir)),
         """, e AS (SELECT source_id, id, id % 12 AS c, 'https://x.example/' || CASE WHEN id % 5 = 0 THEN 'about' ELSE 'vacatures' END || '/' || CASE id % 3 WHEN 0 THEN 'delft' WHEN 1 THEN 'gent' ELSE 'x-nl-' END || '/' || id || CASE WHEN id % 7 = 0 THEN '/apply' ELSE '' END || '?a=1&b=2' AS url, id % 7 <> 0 AS page, id % 5 <> 0 AS job FROM postings),
    k AS (SELECT DISTINCT source_id, c, dense_rank() OVER (PARTITION BY source_id ORDER BY c) AS place FROM e WHERE source_id % 2 = 0),
    p AS (SELECT e.*, CASE WHEN source_id % 2 = 0 THEN place ELSE 0 END AS child FROM e LEFT JOIN k USING (source_id, c) WHERE page AND (source_id % 2 = 1 OR place <= CASE WHEN source_id % 4 = 0 THEN 10 ELSE 5 END)),
    j AS (SELECT *, bool_or(job) OVER (PARTITION BY source_id, child) AS any_job FROM p), l AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM j WHERE job OR NOT any_job)
    SELECT CAST(source_id AS BIGINT) AS source_id, row_number() OVER (PARTITION BY source_id ORDER BY child, id) AS nth, url FROM l WHERE n <= 2500 OR id % 3 <> 1""")  # fmt: skip
register("s15_unique_ids", lambda spark, sf_dir: ingest.unique_ids(standin.postings(spark, sf_dir, skills=False).select("source_id", F.expr("concat('e', id % 97)").alias("external_id"), F.expr("concat('https://jobs.example/', source_id, '/', id % 194)").alias("url"), F.expr("concat('h', id)").alias("content_hash"))),
         """, r AS (SELECT source_id, 'e' || (id % 97) AS external_id, 'https://jobs.example/' || source_id || '/' || (id % 194) AS url, 'h' || id AS content_hash FROM postings), n AS (SELECT *, min(url) OVER w <> max(url) OVER w AS shared FROM r WINDOW w AS (PARTITION BY source_id, external_id))
    SELECT source_id, CASE WHEN shared THEN url ELSE external_id END AS external_id, url, max(content_hash) AS content_hash FROM n GROUP BY ALL""")  # fmt: skip
register("s19_register", lambda spark, sf_dir: boards.register_rows(landing(spark, sf_dir, "concat('<table><tr><th scope=row> ', company, ' </th> <td>', lpad(id, 8, '0'), '</td></tr><tr><td>short</td><td>123</td></tr></table>')").withColumnRenamed("payload", "html")),
         "SELECT company AS name, lpad(CAST(id AS VARCHAR), 8, '0') AS number FROM postings")
register("s20_slugs", lambda spark, sf_dir: boards.slugs_from_text(landing(spark, sf_dir, "concat('https://', if(id % 9 = 0, 'www', if(id % 9 = 1, 'X', concat('Board-', id % 50))), '.recruitee.com/o/job-', id)").withColumnRenamed("payload", "line"), "recruitee"),
         "SELECT DISTINCT 'board-' || (id % 50) AS slug FROM postings WHERE id % 9 NOT IN (0, 1)")
register("s21_recall_sample", lambda spark, sf_dir: structured.recall_sample(landing(spark, sf_dir, "to_json(named_struct('results', array(named_struct('id', string(id % 500), 'title', title, 'company', named_struct('display_name', company), 'redirect_url', url), named_struct('id', '', 'title', 'none', 'company', null, 'redirect_url', ''))))").withColumn("page", F.col("id"))),
         """SELECT CAST(id % 500 AS VARCHAR) AS id, title, company, '' AS location, url, '' AS created, '' AS description FROM postings QUALIFY row_number() OVER (PARTITION BY id % 500 ORDER BY postings.id) = 1""")  # fmt: skip


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.expr("concat(upper(c_name), if(c_custkey % 2 = 0, ' B.V.', ''))").alias("company"), F.col("c_custkey").alias("employees"))


register("j3_company_sizes", lambda spark, sf_dir: upkeep.with_sizes(standin.postings(spark, sf_dir, skills=False).select("id", "company"), _sizes(spark, sf_dir)).select("id", "employees"),
         "SELECT id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS employees FROM postings JOIN customer ON company = c_name")
_PLACES = "CASE id % 8 WHEN 0 THEN 'Veldhoven, NL' WHEN 1 THEN 'Den Haag' WHEN 2 THEN 'Berlin, Germany' WHEN 3 THEN 'Remote - Netherlands' WHEN 4 THEN 'kamerik aan de kade' WHEN 5 THEN 'Netherlands' WHEN 6 THEN '' END"


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.postings(spark, sf_dir, skills=False)
    raw = rows.select("external_id", "title", F.concat("company", F.lit(" B.V.")).alias("company"), F.expr(_PLACES).alias("location"), F.lit(None).cast("string").alias("city"), F.expr("if(id % 8 = 4, 'nl', null)").alias("country"), F.lit(None).cast("boolean").alias("remote"), "url",
                      F.expr("if(id % 8 = 5, concat('Standplaats: Breda. Mail a.b@c.example of bel 06-12345678. ', id), null)").alias("description_text"), F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), F.lit(None).cast("timestamp_ntz").alias("valid_through"))
    return normalize.normalized(raw, AS_OF).select("external_id", "title", "company", "location_raw", "city", "country", "remote", "description", "content_hash", "dedup_key", "posted_at")


_CITY = "CASE id % 8 WHEN 0 THEN 'Eindhoven' WHEN 1 THEN 'The Hague' WHEN 4 THEN 'Kamerik aan de Kade' WHEN 5 THEN 'Breda' END"
register("x8_normalized", _normalized, f""", n AS (SELECT *, {_CITY} AS place, CASE WHEN id % 8 = 5 THEN 'Standplaats: Breda. Mail [e-mail] of bel [telefoon]. ' || id ELSE '' END AS text FROM postings)
    SELECT external_id, title, company, nullif({_PLACES}, '') AS location_raw, place AS city, CASE WHEN id % 8 = 2 THEN 'XX' WHEN id % 8 < 6 THEN 'NL' END AS country, id % 8 = 3 AS remote, text AS description, sha256(trim(title) || chr(10) || trim(text)) AS content_hash,
           sha1(lower(company) || '|' || trim(regexp_replace(lower(title), '[^a-z0-9+#.]+', ' ', 'g')) || '|' || lower(coalesce(place, ''))) AS dedup_key, CASE WHEN posted_at <= {NOW} + INTERVAL 2 DAY AND year(posted_at) >= 2000 THEN CAST(posted_at AS TIMESTAMP) END AS posted_at FROM n""")
register("x4_places", lambda spark, sf_dir: standin.postings(spark, sf_dir, skills=False).select("id", normalize.plausible_place(F.expr(_PLACES)).alias("place"), normalize.is_generic_location(F.expr(_PLACES)).alias("generic"),
                                                                                        normalize.city_from_text(F.col("title"), F.expr("case id % 3 when 0 then 'Ons kantoor in Zwolle is leuk' when 1 then 'Work in Haarlem' else 'no place' end")).alias("city")),
         "SELECT id, CASE id % 8 WHEN 0 THEN 'Veldhoven' WHEN 1 THEN 'Den Haag' WHEN 2 THEN 'Berlin' WHEN 4 THEN 'Kamerik aan de Kade' END AS place, id % 8 IN (5, 6, 7) AS generic, CASE id % 3 WHEN 0 THEN 'Zwolle' WHEN 1 THEN 'Haarlem' END AS city FROM postings")
