"""Queries over the row view: filters, reports, listings, matching and landing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import landing, stats
from tidemark.operators.filters import Filters
from tidemark.operators.rows import row_view, with_positions
from tidemark.sources import standin
from tidemark.sources.standin import AS_OF, POSTINGS_SQL

HAVE = ["Brand#11", "Brand#12", "Brand#21", "Brand#33"]

ROWS_SQL = f"""{POSTINGS_SQL}, open_roles AS (
        SELECT company, count(*) AS org_roles FROM postings WHERE closed_at IS NULL AND duplicate_of IS NULL GROUP BY company
    ), rows AS (
        SELECT p.*, s.ats, coalesce(s.kind, 'employer') AS kind, coalesce(r.org_roles, 0) AS org_roles, 'other' AS sector,
               coalesce(posted_at, first_seen) AS effective_at,
               greatest(last_seen, CASE WHEN link_status = 'ok' THEN link_checked_at END) AS confirmed_at,
               list_concat(skills_required, list_filter(skills_nice, lambda x: NOT list_contains(skills_required, x))) AS skills,
               CASE WHEN years_experience IS NULL OR years_experience = 0 THEN CASE WHEN seniority IN ('intern', 'trainee', 'junior') THEN 'none' ELSE 'unspecified' END
                    WHEN years_experience <= 1 THEN '1' WHEN years_experience <= 3 THEN '2-3' WHEN years_experience <= 5 THEN '4-5' ELSE '6+' END AS experience,
               CASE degree_required WHEN 'phd' THEN 'phd' WHEN 'msc' THEN 'master' WHEN 'bsc' THEN 'bachelor' WHEN 'hbo' THEN 'bachelor' WHEN 'mbo' THEN 'mbo' ELSE 'unstated' END AS degree,
               CASE WHEN employees IS NULL THEN 'unknown' WHEN employees < 50 THEN '1-49' WHEN employees < 250 THEN '50-249' WHEN employees < 5000 THEN '250-4999' ELSE '5000+' END AS employee_band,
               CASE WHEN coalesce(r.org_roles, 0) >= 100 THEN 'large' WHEN coalesce(r.org_roles, 0) >= 10 THEN 'medium' ELSE 'small' END AS org_size
        FROM postings p JOIN sources s USING (source_id) LEFT JOIN open_roles r USING (company)
        WHERE is_tech AND duplicate_of IS NULL
    )"""
NOW = f"TIMESTAMP '{AS_OF}'"


def rows(spark: SparkSession, sf_dir: str, skills: bool = True) -> DataFrame:
    """The row view; queries that read no skills leave them out, as a join for them cannot be pruned."""
    return row_view(standin.postings(spark, sf_dir, skills), standin.sources(spark, sf_dir))


def live(spark: SparkSession, sf_dir: str, skills: bool = True) -> DataFrame:
    return Filters().apply(rows(spark, sf_dir, skills), AS_OF)


QUERIES, ORACLE_SQL = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = f"WITH {ROWS_SQL} {sql}"


# name -> the filter and the condition that it must equal; open rows only unless the first says otherwise
FILTER_CASES = {
    "f1_include_closed": (Filters(include_closed=True), "true"),
    "f1_open_only": (Filters(), "true"),
    "f2_ids": (Filters(ids="1, 5,x7, 32,33"), "id IN (1, 5, 32, 33)"),
    "f3_days": (Filters(days=365), f"effective_at >= {NOW} - INTERVAL 365 DAY"),
    "f4_since": (Filters(since="2000-01-01T00:00:00Z"), "first_seen > TIMESTAMP '2000-01-01'"),
    "f5_role": (Filters(role="Building,machinery"), "role_family IN ('building', 'machinery')"),
    "f6_seniority": (Filters(seniority="urgent,junior"), "seniority IN ('urgent', 'junior')"),
    "f7_experience": (Filters(experience="none,2-3,6+"), "experience IN ('none', '2-3', '6+')"),
    "f8_degree": (Filters(degree="bachelor,phd"), "degree IN ('bachelor', 'phd')"),
    "f9_employees": (Filters(employees="5000+,1-49,unknown"), "employee_band IN ('5000+', '1-49', 'unknown')"),
    "f10_sector": (Filters(sector="other"), "sector = 'other'"),
    "f12_confirmed_days": (Filters(confirmed_days=90), f"confirmed_at >= {NOW} - INTERVAL 90 DAY"),
    "f13_org_size": (Filters(org_size="medium,large"), "org_size IN ('medium', 'large')"),
    "f14_enrollment_open": (Filters(enrollment="open"), "enrollment_required IS DISTINCT FROM true"),
    "f14_enrollment_required": (Filters(enrollment="required"), "enrollment_required"),
    "f14_enrollment_stated_open": (Filters(enrollment="stated_open"), "enrollment_required = false"),
    "f15_city": (Filters(city="Nation_3,remote"), "coalesce(lower(city) IN ('nation_3', 'remote'), false) OR remote OR len(list_filter(coalesce(also_in, []), lambda x: lower(x) = 'nation_3')) > 0"),
    "f16_company": (Filters(company="customer#000000011"), "lower(company) = 'customer#000000011'"),
    "f17_exclude_companies": (Filters(exclude_companies="Customer#000000011, customer#000000012"), "lower(company) NOT IN ('customer#000000011', 'customer#000000012')"),
    "f18_exclude_agencies": (Filters(exclude_agencies=True), "kind <> 'agency'"),
    "f19_english_only": (Filters(english_only=True), "english_only"),
    "f20_language_nl": (Filters(language="nl"), "(dutch_required OR posting_language = 'nl') AND english_required = false"),
    "f20_language_any": (Filters(language="any"), "true"),
    "f21_sponsorship": (Filters(sponsorship=True), "visa_sponsorship"),
    "f22_remote": (Filters(remote="remote"), "remote_policy = 'remote' OR (remote AND remote_policy IN ('unknown', 'remote'))"),
    "f22_remote_all": (Filters(remote="remote,hybrid,onsite"), "true"),
    "f22_hybrid": (Filters(remote="hybrid"), "remote_policy = 'hybrid'"),
    "f23_skill": (Filters(skill="Brand#11"), "list_contains(skills, 'Brand#11')"),
    "f24_skills_any": (Filters(skills_any="Brand#11,Brand#55,Nope"), "len(list_intersect(skills, ['Brand#11', 'Brand#55'])) > 0"),
    "f25_q": (Filters(q="brand#5"), "contains(lower(title), 'brand#5') OR contains(lower(company), 'brand#5') OR len(list_filter(skills, lambda s: contains(lower(s), 'brand#5'))) > 0"),
    "f_combined": (Filters(days=900, seniority="urgent", exclude_agencies=True, skills_any="Brand#11,Brand#12"), f"effective_at >= {NOW} - INTERVAL 900 DAY AND seniority = 'urgent' AND kind <> 'agency' AND len(list_intersect(skills, ['Brand#11', 'Brand#12'])) > 0"),
}
for _name, (_filter, _condition) in FILTER_CASES.items():
    _open = "true" if _filter.include_closed else "closed_at IS NULL"
    register(_name, lambda spark, sf_dir, f=_filter: f.apply(rows(spark, sf_dir, bool(f.skill or f.skills_any or f.q)), AS_OF).select("id"), f"SELECT id FROM rows WHERE {_open} AND ({_condition})")

def _with_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = standin.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 4").select(F.col("c_name").alias("company"), F.expr("element_at(array('finance', 'health', 'staffing', 'software'), cast(c_custkey % 5 + 1 as int))").alias("sector"))
    return row_view(standin.postings(spark, sf_dir, False), standin.sources(spark, sf_dir), sectors)


_SECTORS = "SELECT rows.id, CASE c_custkey % 5 WHEN 0 THEN 'finance' WHEN 1 THEN 'health' WHEN 2 THEN 'staffing' WHEN 3 THEN 'software' ELSE 'other' END AS sector, CASE WHEN c_custkey % 5 = 2 THEN 'agency' ELSE kind END AS kind FROM rows JOIN customer ON company = c_name WHERE closed_at IS NULL"
register("f10_sectors", lambda spark, sf_dir: Filters(sector="Finance, other").apply(_with_sectors(spark, sf_dir), AS_OF).select("id"), f"SELECT id FROM ({_SECTORS}) WHERE sector IN ('finance', 'other')")
register("f18_without_staffing", lambda spark, sf_dir: Filters(exclude_agencies=True).apply(_with_sectors(spark, sf_dir), AS_OF).select("id"), f"SELECT id FROM ({_SECTORS}) WHERE kind <> 'agency'")
register("a6_breakdown_by_sector", lambda spark, sf_dir: stats.breakdown(Filters().apply(_with_sectors(spark, sf_dir), AS_OF), "sector", 20), f"SELECT sector AS key, count(*) AS count, round(count(*) / (SELECT greatest(count(*), 1) FROM ({_SECTORS})), 4) AS share FROM ({_SECTORS}) GROUP BY sector")

register("f11_position", lambda spark, sf_dir: Filters(position="software_engineer,other").apply(_positioned(spark, sf_dir), AS_OF).select("id"), "SELECT id FROM rows WHERE closed_at IS NULL AND role_family <> 'automobile'")  # 'mobile' is a position of its own


def _positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_positions(rows(spark, sf_dir, False))


register("s16_live_rows", lambda spark, sf_dir: rows(spark, sf_dir, False).select("id", "company", "ats", "kind", "org_roles", "effective_at", "confirmed_at", "experience", "degree", "employee_band", "org_size"),
         "SELECT id, company, ats, kind, org_roles, effective_at, confirmed_at, experience, degree, employee_band, org_size FROM rows")
register("j1_postings_sources", lambda spark, sf_dir: standin.postings(spark, sf_dir, False).join(standin.sources(spark, sf_dir), "source_id").groupBy("ats").agg(F.count(F.lit(1)).alias("n")),
         "SELECT ats, count(*) AS n FROM postings JOIN sources USING (source_id) GROUP BY ats")
register("a1_overview", lambda spark, sf_dir: stats.overview(standin.postings(spark, sf_dir, False), standin.sources(spark, sf_dir), AS_OF), f"""
    , f AS (SELECT posted_at, first_seen FROM postings JOIN sources USING (source_id) WHERE first_seen >= {NOW} - INTERVAL 14 DAY AND first_seen > first_success_at + INTERVAL 10 MINUTE AND first_seen >= posted_at)
    SELECT (SELECT count(*) FROM postings WHERE closed_at IS NULL AND duplicate_of IS NULL) AS live_postings,
           (SELECT count(*) FROM postings WHERE closed_at IS NULL AND duplicate_of IS NULL AND is_tech) AS live_tech_postings,
           (SELECT count(DISTINCT company) FROM postings WHERE closed_at IS NULL AND is_tech) AS companies,
           (SELECT count(*) FROM postings JOIN sources USING (source_id) WHERE closed_at IS NULL AND duplicate_of IS NULL AND is_tech AND (posted_at >= {NOW} - INTERVAL 7 DAY
               OR (posted_at IS NULL AND first_seen >= {NOW} - INTERVAL 7 DAY AND first_seen > first_success_at + INTERVAL 10 MINUTE))) AS new_last_7d,
           (SELECT count(*) FROM postings WHERE is_tech AND closed_at >= {NOW} - INTERVAL 7 DAY) AS closed_last_7d,
           (SELECT round(median(date_diff('second', posted_at, first_seen) / 3600), 1) FROM f) AS freshness_median_hours,
           (SELECT count(*) FROM sources) AS sources_total, (SELECT count(*) FROM sources WHERE active) AS sources_active,
           (SELECT count(*) FROM sources WHERE last_status = 'ok') AS sources_ok, (SELECT max(last_run_at) FROM sources WHERE last_status = 'ok') AS last_crawl_at""")
# the freshness figure of its own
register("a2_freshness", lambda spark, sf_dir: stats.overview(standin.postings(spark, sf_dir, False), standin.sources(spark, sf_dir), "2001-08-05 00:00:00").select("freshness_median_hours"),
         """SELECT round(median(date_diff('second', posted_at, first_seen) / 3600), 1) AS freshness_median_hours FROM postings JOIN sources USING (source_id)
            WHERE first_seen >= TIMESTAMP '2001-08-05' - INTERVAL 14 DAY AND first_seen > first_success_at + INTERVAL 10 MINUTE AND first_seen >= posted_at""")  # fmt: skip
register("a3_new_7d", lambda spark, sf_dir: stats.overview(standin.postings(spark, sf_dir, False), standin.sources(spark, sf_dir), AS_OF).select("new_last_7d"),
         f"""SELECT count(*) AS new_last_7d FROM postings JOIN sources USING (source_id) WHERE closed_at IS NULL AND duplicate_of IS NULL AND is_tech AND (posted_at >= {NOW} - INTERVAL 7 DAY
             OR (posted_at IS NULL AND first_seen >= {NOW} - INTERVAL 7 DAY AND first_seen > first_success_at + INTERVAL 10 MINUTE))""")  # fmt: skip

_SKILL_SQL = """, live AS (SELECT * FROM rows WHERE closed_at IS NULL), named AS (SELECT id, unnest(skills) AS skill, skills_required FROM live),
    counted AS (SELECT skill, count(*) AS n, count(*) FILTER (WHERE list_contains(skills_required, skill)) AS required FROM named GROUP BY skill)"""
register("a4_skill_counts", lambda spark, sf_dir: stats.skill_counts(live(spark, sf_dir), 40),
         _SKILL_SQL + " SELECT skill, n AS count, round(n / greatest((SELECT count(*) FROM live), 1), 4) AS share, required FROM counted ORDER BY n DESC, skill LIMIT 40")
register("a5_cooccurrence", lambda spark, sf_dir: stats.cooccurrence(live(spark, sf_dir), 15, 3), _SKILL_SQL + """,
    best AS (SELECT skill, n FROM counted ORDER BY n DESC, skill LIMIT 15),
    pair AS (SELECT a.skill AS source, b.skill AS target, count(*) AS weight FROM named a JOIN named b ON a.id = b.id AND a.skill < b.skill WHERE a.skill IN (SELECT skill FROM best) AND b.skill IN (SELECT skill FROM best) GROUP BY 1, 2)
    SELECT source, target, weight, round(weight * (SELECT count(*) FROM live) / greatest(x.n * y.n, 1), 2) AS lift FROM pair JOIN best x ON x.skill = source JOIN best y ON y.skill = target
    WHERE weight >= 3 ORDER BY weight DESC, source, target LIMIT 200""")
_KEYS = {"city": "coalesce(city, CASE WHEN remote THEN 'Remote' ELSE 'Unknown' END)", "employees": "employee_band"}
for _key in stats.BREAKDOWN_KEYS:
    if _key != "position":
        _value = _KEYS.get(_key, f"coalesce({_key}, 'unknown')")
        register(f"a6_breakdown_{_key}", lambda spark, sf_dir, k=_key: stats.breakdown(live(spark, sf_dir, False), k, 20),
                 f", live AS (SELECT * FROM rows WHERE closed_at IS NULL) SELECT {_value} AS key, count(*) AS count, round(count(*) / greatest((SELECT count(*) FROM live), 1), 4) AS share FROM live GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
register("a6_breakdown_position", lambda spark, sf_dir: stats.breakdown(Filters().apply(_positioned(spark, sf_dir), AS_OF), "position", 20),
         "SELECT CASE role_family WHEN 'automobile' THEN 'mobile' ELSE 'software_engineer' END AS key, count(*) AS count, round(count(*) / (SELECT count(*) FROM rows WHERE closed_at IS NULL), 4) AS share FROM rows WHERE closed_at IS NULL GROUP BY 1")
_TREND_SQL = f""", recent AS (SELECT strftime(first_seen, '%G-W%V') AS week, skills FROM rows WHERE first_seen >= {NOW} - INTERVAL 84 DAY), named AS (SELECT week, unnest(skills) AS series FROM recent),
    total AS (SELECT week, count(*) AS count FROM recent GROUP BY week)"""
_GRID_SQL = " SELECT 'total' AS series, week, count FROM total UNION ALL SELECT chosen.series, total.week, (SELECT count(*) FROM named n WHERE n.series = chosen.series AND n.week = total.week) FROM total, chosen"
register("a7_trends", lambda spark, sf_dir: stats.trends(rows(spark, sf_dir), AS_OF), _TREND_SQL + ", chosen AS (SELECT series FROM named GROUP BY series ORDER BY count(*) DESC, series LIMIT 5)" + _GRID_SQL)
register("a7_trends_chosen", lambda spark, sf_dir: stats.trends(rows(spark, sf_dir), AS_OF, ["Brand#11", "Brand#55"]), _TREND_SQL + ", chosen AS (SELECT DISTINCT series FROM named WHERE series IN ('Brand#11', 'Brand#55'))" + _GRID_SQL)
register("a8_salary", lambda spark, sf_dir: stats.salary(live(spark, sf_dir, False)), """
    , v AS (SELECT CASE WHEN salary_max_eur <> 0 THEN (salary_min_eur + salary_max_eur) / 2 ELSE salary_min_eur END AS mid FROM rows WHERE closed_at IS NULL AND salary_min_eur <> 0),
    s AS (SELECT list(mid ORDER BY mid) AS x, count(*) AS n FROM v), j AS (SELECT i, x, n, greatest(1, least((i * (n + 1)) // 4, n - 1)) AS j FROM s, (VALUES (1), (2), (3)) t(i)),
    q AS (SELECT i, (x[j] * (4 - (i * (n + 1) - 4 * j)) + x[j + 1] * (i * (n + 1) - 4 * j)) / 4 AS v FROM j)
    SELECT n, CAST(round_even((SELECT v FROM q WHERE i = 1), 0) AS BIGINT) AS p25, CAST(round_even((SELECT v FROM q WHERE i = 2), 0) AS BIGINT) AS median, CAST(round_even((SELECT v FROM q WHERE i = 3), 0) AS BIGINT) AS p75,
           CAST(round_even(x[1], 0) AS BIGINT) AS min, CAST(round_even(x[n], 0) AS BIGINT) AS max FROM s""")
register("a9_gap_missing", lambda spark, sf_dir: stats.gap_missing(live(spark, sf_dir), HAVE),
         _SKILL_SQL + f" SELECT skill, n AS count, round(n / greatest((SELECT count(*) FROM live), 1), 4) AS share FROM counted WHERE skill NOT IN {tuple(HAVE)} ORDER BY n DESC, skill LIMIT 15")
_MATCH_SQL = f""", scored AS (SELECT *, len(list_intersect(skills, {HAVE})) AS overlap, CASE WHEN len(skills) = 0 THEN 0.0 ELSE len(list_intersect(skills, {HAVE})) / greatest(len(skills), 3) END AS score FROM rows WHERE closed_at IS NULL)"""
register("m1_match_score", lambda spark, sf_dir: live(spark, sf_dir).select("id", F.round(stats.match_score(HAVE), 4).alias("score")), _MATCH_SQL + " SELECT id, round(score, 4) AS score FROM scored")
register("m2_gap_matches", lambda spark, sf_dir: stats.gap_matches(live(spark, sf_dir), HAVE).select("id", "title", "company", "city", "url", "match", F.array_join("matched", ",").alias("matched"), F.array_join("missing", ",").alias("missing")),
         _MATCH_SQL + f""" SELECT id, title, company, city, url, round(score, 2) AS match, array_to_string(list_sort(list_intersect(skills, {HAVE})), ',') AS matched,
         array_to_string(list_sort(list_filter(skills, lambda s: NOT list_contains({HAVE}, s))), ',') AS missing FROM scored WHERE len(skills) > 0 ORDER BY score DESC, overlap DESC, id LIMIT 20""")  # fmt: skip
register("m2_gap_coverage", lambda spark, sf_dir: stats.gap_coverage(live(spark, sf_dir), HAVE), _SKILL_SQL + f" SELECT round(count(*) FILTER (WHERE skill IN {tuple(HAVE)}) / greatest(count(*), 1), 3) AS demand_coverage FROM named")
_PAGE_SQL = """SELECT rank, id, title, company, CAST(effective_at AS DATE) AS posted_on, org_size, greatest(0, CAST(floor(date_diff('second', effective_at, {now}) / 86400) AS BIGINT)) AS age_days, array_to_string(skills[1:12], ',') AS skills FROM
    (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {of}) WHERE rank > {low} AND rank <= {high}"""
_PAGE_COLUMNS = ["rank", "id", "title", "company", "posted_on", "org_size", "age_days"]


def _page(spark: SparkSession, sf_dir: str, page: int, size: int, sort: str, have: list[str] | None = None) -> DataFrame:
    return stats.posting_page(live(spark, sf_dir), AS_OF, page, size, sort, have).select(*_PAGE_COLUMNS, F.array_join("skills", ",").alias("skills"))


_LIVE = ", live AS (SELECT * FROM rows WHERE closed_at IS NULL) "
register("o1_page_newest", lambda spark, sf_dir: _page(spark, sf_dir, 2, 50, "newest"), _LIVE + _PAGE_SQL.format(now=NOW, order="effective_at DESC, id", of="live", low=50, high=100))
register("o1_page_match", lambda spark, sf_dir: _page(spark, sf_dir, 1, 50, "match", HAVE), _MATCH_SQL + _PAGE_SQL.format(now=NOW, order="score DESC, effective_at DESC, id", of="scored", low=0, high=50))
register("o1_page_size_small", lambda spark, sf_dir: _page(spark, sf_dir, 1, 50, "size_small"), _LIVE + _PAGE_SQL.format(now=NOW, order="employees IS NULL, coalesce(employees, 0), org_roles, effective_at DESC, id", of="live", low=0, high=50))
register("o1_page_size_large", lambda spark, sf_dir: _page(spark, sf_dir, 1, 50, "size_large"), _LIVE + _PAGE_SQL.format(now=NOW, order="employees IS NULL, coalesce(employees, 0) DESC, org_roles DESC, effective_at DESC, id", of="live", low=0, high=50))
register("o2_newest_of_company", lambda spark, sf_dir: Filters(company="Customer#000000011").apply(rows(spark, sf_dir, False), AS_OF).orderBy(F.desc("effective_at"), "id").limit(50).select("id", "effective_at"),
         "SELECT id, effective_at FROM rows WHERE closed_at IS NULL AND company = 'Customer#000000011' ORDER BY effective_at DESC, id LIMIT 50")
register("a10_open_roles", lambda spark, sf_dir: stats.open_roles(standin.postings(spark, sf_dir, False)), "SELECT company, org_roles AS open_roles FROM open_roles")
register("a11_sources_by_kind", lambda spark, sf_dir: stats.sources_by_kind(standin.sources(spark, sf_dir)), "SELECT coalesce(kind, 'employer') AS kind, count(*) AS sources, count(*) FILTER (WHERE last_status = 'ok') AS healthy FROM sources GROUP BY 1")
register("a27_source_status", lambda spark, sf_dir: stats.source_status(standin.sources(spark, sf_dir)), "SELECT coalesce(last_status, 'pending') AS status, count(*) AS sources FROM sources GROUP BY 1")
_OPTIONS = " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS dimension, {c} AS key, count(*) AS count FROM rows WHERE closed_at IS NULL AND {c} IS NOT NULL GROUP BY {c} ORDER BY 3 DESC, 2 LIMIT 50)" for c in ("city", "company", "role_family", "seniority", "sector"))
register("a26_filter_options", lambda spark, sf_dir: stats.filter_options(rows(spark, sf_dir)), _OPTIONS)
register("a22_company_index", lambda spark, sf_dir: landing.company_index(live(spark, sf_dir, False)), """, n AS (SELECT company, count(*) AS n, trim(regexp_replace(lower(company), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM rows WHERE closed_at IS NULL GROUP BY company)
    SELECT slug, arg_min(company, (-n, company)) AS name, CAST(sum(n) AS BIGINT) AS postings FROM n GROUP BY slug""")
register("a23_employer_figures", lambda spark, sf_dir: landing.employer_figures(rows(spark, sf_dir, False)), "SELECT company, count(*) AS open, count(*) FILTER (WHERE english_only) AS english, count(*) FILTER (WHERE visa_sponsorship) AS visa, max(employees) AS employees FROM rows WHERE closed_at IS NULL GROUP BY company")
register("a23_employer_top_skills", lambda spark, sf_dir: landing.employer_top(rows(spark, sf_dir), "skills"), _SKILL_SQL + """, c AS (SELECT company, s AS key, count(*) AS count FROM (SELECT company, unnest(skills) AS s FROM live) GROUP BY 1, 2)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY company ORDER BY count DESC, key) <= 5""")
register("a24_page_figures", lambda spark, sf_dir: landing.page_figures(live(spark, sf_dir, False)), """SELECT count(*) AS postings, count(DISTINCT company) AS employers, CAST(coalesce(round(100 * count(*) FILTER (WHERE english_only) / nullif(count(*), 0)), 0) AS BIGINT) AS no_dutch_percent,
    count(*) FILTER (WHERE visa_sponsorship) AS visa, count(*) FILTER (WHERE coalesce(seniority IN ('intern', 'trainee', 'junior') OR experience = 'none', false)) AS entry_level FROM rows WHERE closed_at IS NULL""")
_PAGES_SQL = """, live AS (SELECT *, list_distinct(list_concat([upper(city)], coalesce(also_in, []))) AS names FROM rows WHERE closed_at IS NULL),
    cities AS (SELECT city AS page_city, row_number() OVER (ORDER BY count(*) DESC, city) AS place FROM live WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 8 ORDER BY count(*) DESC, city LIMIT 14),
    theme AS (SELECT id, unnest([CASE WHEN english_only THEN 'english' END, CASE WHEN visa_sponsorship THEN 'visa' END, CASE WHEN experience IN ('none', '1') THEN 'junior' END,
                                 CASE WHEN remote_policy = 'remote' OR (remote AND remote_policy = 'unknown') THEN 'remote' END]) AS theme FROM live),
    placed AS (SELECT live.id, role_family, page_city, place FROM live JOIN cities ON list_contains(names, upper(page_city))),
    pages AS (
        SELECT 'city' AS kind, NULL AS role, NULL AS theme, page_city AS city, count(*) AS postings FROM placed GROUP BY page_city HAVING count(*) >= 8
        UNION ALL SELECT 'role', role_family, NULL, NULL, count(*) FROM live GROUP BY role_family HAVING count(*) >= 8
        UNION ALL SELECT 'role_city', role_family, NULL, page_city, count(*) FROM placed WHERE place <= 8 GROUP BY role_family, page_city HAVING count(*) >= 20
        UNION ALL SELECT 'theme', NULL, theme, NULL, count(*) FROM theme WHERE theme IS NOT NULL GROUP BY theme HAVING count(*) >= 8
        UNION ALL SELECT 'theme_city', NULL, theme, page_city, count(*) FROM theme JOIN placed USING (id) WHERE theme IN ('english', 'visa', 'junior') AND place <= 6 GROUP BY theme, page_city HAVING count(*) >= 20)"""
register("a25_landing_pages", lambda spark, sf_dir: landing.landing_pages(rows(spark, sf_dir, False), AS_OF), _PAGES_SQL + " SELECT kind, role, theme, city, postings FROM pages")
register("o7_popular_pages", lambda spark, sf_dir: landing.popular(landing.landing_pages(rows(spark, sf_dir, False), AS_OF)), _PAGES_SQL + " SELECT * FROM pages ORDER BY postings DESC, kind, role NULLS FIRST, theme NULLS FIRST, city NULLS FIRST LIMIT 18")
register("o7_related_pages", lambda spark, sf_dir: landing.related(landing.landing_pages(rows(spark, sf_dir, False), AS_OF), "building", "NATION_3"), _PAGES_SQL + """ SELECT * FROM pages WHERE coalesce(role = 'building' OR city = 'NATION_3', false) AND NOT (role IS NOT DISTINCT FROM 'building' AND city IS NOT DISTINCT FROM 'NATION_3')
    ORDER BY postings DESC, kind, role NULLS FIRST, theme NULLS FIRST, city NULLS FIRST LIMIT 14""")
