"""Queries over the maintenance verbs, and over addresses and names, with tables made from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import agents, links, normalize, skills
from tidemark.operators import copying, discovery, headcounts, ingest, upkeep
from tidemark.operators.rows import by_distinct
from tidemark.plans.stats import NOW
from tidemark.sources import standin
from tidemark.sources.standin import AS_OF, POSTINGS_SQL

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = f"WITH {POSTINGS_SQL} {sql}"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.postings(spark, sf_dir, skills=False)


# ---------- postings ----------

register("l6_text_guard", lambda spark, sf_dir: _guarded(spark, sf_dir), f""", n AS (SELECT source_id, external_id, id % 3 <> 0 AND id % 4 = 0 AS lost, id % 3 <> 0 AS differs FROM postings)
    SELECT CAST(source_id AS BIGINT) AS source_id, external_id, CASE WHEN lost OR NOT differs THEN 'touched' ELSE 'updated' END AS change, CASE WHEN differs AND NOT lost THEN 'new title' ELSE 'old title' END AS title,
           CASE WHEN differs AND NOT lost THEN repeat('fresh words ', 6) ELSE repeat('stored words ', 6) END AS description, CASE WHEN differs AND NOT lost THEN 'h2' ELSE 'h1' END AS content_hash, {NOW} AS last_seen FROM n""")


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting is seen again; two in three have another hash, and each fourth of them an empty text."""
    rows = postings(spark, sf_dir).select(F.col("source_id").cast("long").alias("source_id"), "external_id", "id", "first_seen", "last_seen")
    content = {c: F.lit(None).cast("timestamp_ntz" if c in ("posted_at", "valid_through") else "boolean" if c == "remote" else "string") for c in ingest.CONTENT} | {"country": F.lit("NL"), "url": F.col("external_id")}
    old = rows.withColumns(content | {"title": F.lit("old title"), "description": F.repeat(F.lit("stored words "), F.lit(6)), "content_hash": F.lit("h1"), "closed_at": F.lit(None).cast("timestamp_ntz")}).drop("id")
    text = F.when(F.col("id") % 4 == 0, "  too short  ").otherwise(F.repeat(F.lit("fresh words "), F.lit(6)))
    new = rows.withColumns(content | {"title": F.lit("new title"), "description": text, "content_hash": F.when(F.col("id") % 3 == 0, "h1").otherwise("h2")}).drop("id", "first_seen", "last_seen")
    sources = standin.sources(spark, sf_dir).withColumns({"source_id": F.col("source_id").cast("long"), "last_nl_count": F.lit(None).cast("long")})
    return ingest.merge(old, new, sources, AS_OF).select("source_id", "external_id", "change", "title", "description", "content_hash", "last_seen")


register("l13_needs_extraction", lambda spark, sf_dir: ingest.needs_extraction(postings(spark, sf_dir).select("id", "is_tech", F.expr("if(id % 5 = 0, null, '{}')").alias("extraction"), F.expr("if(id % 7 = 0, null, concat('v', id % 3))").alias("extractor_version"), F.expr("concat('h', id % 2)").alias("extracted_hash"), F.lit("h0").alias("content_hash")), "v1").select("id"),
         "SELECT id FROM postings WHERE is_tech AND (id % 5 = 0 OR id % 2 = 1 OR (id % 7 <> 0 AND id % 3 <> 1))")
register("l14_reclassified", lambda spark, sf_dir: upkeep.reclassified(postings(spark, sf_dir), F.when(F.col("id") % 4 != 3, F.col("title").rlike("engineer [AM]"))).groupBy("is_tech", "flipped").agg(F.count(F.lit(1)).alias("n")),
         ", n AS (SELECT is_tech AS old, id % 4 <> 3 AND regexp_matches(title, 'engineer [AM]') AS new FROM postings) SELECT new AS is_tech, new <> old AS flipped, count(*) AS n FROM n GROUP BY ALL")
_RAW_PLACE = "CASE id % 7 WHEN 0 THEN 'Veldhoven' WHEN 1 THEN 'kamerik' WHEN 2 THEN 'Netherlands' WHEN 3 THEN '' WHEN 4 THEN 'Office 3' WHEN 5 THEN 'gasselte, Drenthe' END"
register("l15_filled_cities", lambda spark, sf_dir: upkeep.with_filled_cities(postings(spark, sf_dir).withColumns({"location_raw": F.expr(_RAW_PLACE), "description": F.expr("if(id % 2 = 0, 'Onze locatie: Gouda, vlak bij het station', 'somewhere')")})).select("id", "city", "city_from"), f""",
    n AS (SELECT id, city, id % 7 AS k, city IS NULL AND closed_at IS NULL AND NOT remote AS open_here, id % 2 = 0 AS says FROM postings)
    SELECT id, CASE WHEN open_here AND k = 1 THEN 'Kamerik' WHEN open_here AND k = 5 THEN 'Gasselte' WHEN open_here AND k IN (2, 3, 6) AND says THEN 'Gouda' ELSE city END AS city,
           CASE WHEN open_here AND k IN (1, 5) THEN 'place' WHEN open_here AND k IN (2, 3, 6) AND says THEN 'text' END AS city_from FROM n""")
register("l16_scrubbed", lambda spark, sf_dir: upkeep.scrubbed(postings(spark, sf_dir).select("id", "title", F.expr("case id % 4 when 0 then concat('mail jan.', id, '@firm.example now') when 1 then 'call 06-12345678' when 2 then 'nothing' end").alias("description"), F.expr("concat('h', id % 2)").alias("content_hash"), F.lit("h0").alias("extracted_hash"))), """,
    n AS (SELECT id, title, id % 4 AS k, 'h' || (id % 2) AS hash, CASE id % 4 WHEN 0 THEN 'mail [e-mail] now' WHEN 1 THEN 'call [telefoon]' WHEN 2 THEN 'nothing' ELSE '' END AS description FROM postings),
    m AS (SELECT *, k <> 2 AS scrubbed, CASE WHEN k <> 2 THEN sha256(trim(title) || chr(10) || trim(description)) ELSE hash END AS new_hash FROM n)
    SELECT id, title, description, new_hash AS content_hash, CASE WHEN scrubbed AND hash = 'h0' THEN new_hash ELSE 'h0' END AS extracted_hash, scrubbed FROM m""")


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.sources(spark, sf_dir).withColumnRenamed("source_company", "company").withColumn("url", F.expr("if(source_id % 2 = 0, null, concat('https://', slug))"))


def _renamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    boards = _boards(spark, sf_dir)
    pretty = boards.select("slug", F.initcap("slug").alias("name"))
    curated = spark.createDataFrame([("Nation_4", "The Fourth"), ("NATION_5", "The Fifth"), ("NATION_8", "never, its board is renamed first")], "raw string, name string")
    return upkeep.renamed(boards, postings(spark, sf_dir).drop("company").join(boards.select("source_id", "company"), "source_id"), pretty, curated)


_NAMED = "CASE WHEN kind = 'employer' THEN CASE WHEN source_company = 'NATION_4' THEN 'The Fourth' ELSE 'Nation' || substr(source_company, 7) END WHEN source_company = 'NATION_5' THEN 'The Fifth' ELSE source_company END"
register("l17_renamed_sources", lambda spark, sf_dir: _renamed(spark, sf_dir)[0].select("source_id", "company"), f"SELECT source_id, {_NAMED} AS company FROM sources")
register("l17_renamed_postings", lambda spark, sf_dir: _renamed(spark, sf_dir)[1].groupBy("company").agg(F.count(F.lit(1)).alias("n")), f"SELECT {_NAMED} AS company, count(*) AS n FROM postings JOIN sources USING (source_id) GROUP BY 1")

# ---------- boards and candidates ----------

register("l11_source_status", lambda spark, sf_dir: ingest.source_after_run(standin.sources(spark, sf_dir).withColumn("consecutive_failures", F.expr("if(source_id % 7 = 0, null, source_id % 5)")), standin.table(spark, sf_dir, "nation").where("n_nationkey % 6 <> 5").selectExpr("n_nationkey AS source_id", "element_at(array('ok', 'partial', 'error', 'not_found', 'exception'), cast(n_nationkey % 5 + 1 as int)) AS result", "1 AS count", "n_nationkey AS nl_count"), AS_OF)
         .select("source_id", "last_status", "last_run_at", "first_success_at", "last_nl_count", "consecutive_failures", "active"), f""", r AS (SELECT *, CASE WHEN source_id % 6 <> 5 THEN ['ok', 'partial', 'error', 'not_found', 'exception'][source_id % 5 + 1] END AS result, CASE WHEN source_id % 7 <> 0 THEN source_id % 5 END AS before FROM sources),
    f AS (SELECT *, CASE WHEN result IS NULL THEN before WHEN result IN ('ok', 'partial') THEN 0 ELSE coalesce(before, 0) + 1 END AS failures FROM r)
    SELECT source_id, coalesce(result, last_status) AS last_status, CASE WHEN result IS NULL THEN last_run_at ELSE {NOW} END AS last_run_at, first_success_at, CASE WHEN result = 'ok' THEN source_id ELSE last_nl_count END AS last_nl_count, failures AS consecutive_failures,
           active AND NOT (result IS NOT NULL AND (result = 'not_found' OR failures >= 5)) AS active FROM f""")  # fmt: skip


def _kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("board", "nation_3"), ("agency", "NATION_3"), ("aggregator", "nation_1"), ("agency", "ation_2"), ("test", "on_7"), ("board", "demo-nation")], "kind string, needle string")


_KIND = """CASE WHEN {k} = 3 THEN 'board' WHEN {k} = 1 THEN 'aggregator' WHEN {k} % 11 = 5 THEN 'test' WHEN {k} BETWEEN 10 AND 19 THEN 'aggregator' WHEN {k} = 2 OR {k} BETWEEN 20 AND 29 THEN 'agency' ELSE 'employer' END"""
_SLUGGED = "if(source_id % 11 = 5, concat('demo-', source_id), slug)"
register("l20_classified", lambda spark, sf_dir: upkeep.classified(_boards(spark, sf_dir).withColumn("slug", F.expr(_SLUGGED)), _kinds(spark)).select("source_id", "kind", "active", "last_status"),
         f""", k AS (SELECT *, {_KIND.format(k='source_id')} AS new FROM sources) SELECT source_id, new AS kind, active AND new NOT IN ('aggregator', 'test') AS active, CASE WHEN active AND new IN ('aggregator', 'test') THEN new ELSE last_status END AS last_status FROM k""")


def _found_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards found again, two in three with the platform that they have, and some twice."""
    rows = _boards(spark, sf_dir)
    found = rows.select("company", F.expr("if(source_id % 3 = 2, 'ashby', ats)").alias("ats"), "slug", F.concat(F.lit("https://found/"), "slug").alias("url"))
    return found.unionByName(found.where("slug = 'nation_8'").withColumn("company", F.lit("AAA")))


register("l20_upserted_sources", lambda spark, sf_dir: upkeep.upserted_sources(_boards(spark, sf_dir), _found_boards(spark, sf_dir), _kinds(spark)).select("source_id", "company", "ats", "slug", "url", "kind", "active", "is_new"), f""",
    b AS (SELECT *, {_KIND.replace("{k} % 11 = 5", "false").format(k='source_id')} AS new FROM sources)
    SELECT source_id, source_company AS company, ats, slug, CASE WHEN source_id % 2 = 1 THEN 'https://' || slug WHEN source_id % 3 <> 2 THEN 'https://found/' || slug END AS url, kind, active, false AS is_new FROM b
    UNION ALL SELECT NULL, CASE WHEN slug = 'nation_8' THEN 'AAA' ELSE source_company END, 'ashby', slug, 'https://found/' || slug, new, new NOT IN ('aggregator', 'test'), true FROM b WHERE source_id % 3 = 2""")
register("l22_candidate_status", lambda spark, sf_dir: upkeep.candidate_status(standin.table(spark, sf_dir, "supplier").selectExpr("s_name AS key", "if(s_suppkey % 5 = 0, array('x'), if(s_suppkey % 5 = 1, cast(array() as array<string>), null)) AS ats", "s_suppkey % 7 = 0 AS jsonld", "if(s_suppkey % 11 = 0, 'map', null) AS sitemap", "case s_suppkey % 3 when 0 then 'a.example' when 1 then '' end AS domain")),
         ", c AS (SELECT s_name, s_suppkey AS k FROM supplier) SELECT 'sponsor' AS kind, s_name AS key, CASE WHEN k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0 THEN 'board' WHEN k % 3 = 0 THEN 'no_board' ELSE 'no_domain' END AS status, 0 AS nl FROM c")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    return rows.selectExpr("concat('ats', s_suppkey % 3) AS kind", "s_name AS key", "if(s_suppkey % 4 = 0, 'ok', 'error') AS status", "cast(s_suppkey % 6 as bigint) AS nl", f"timestamp_ntz'{AS_OF}' - make_dt_interval(cast(s_suppkey % 120 as int)) AS checked_at")


_CANDIDATES = f"candidates AS (SELECT 'ats' || (s_suppkey % 3) AS kind, s_name AS key, CASE WHEN s_suppkey % 4 = 0 THEN 'ok' ELSE 'error' END AS status, s_suppkey % 6 AS nl, {NOW} - to_days(CAST(s_suppkey % 120 AS INTEGER)) AS checked_at FROM supplier WHERE s_suppkey % 2 = 0)"
_RESULTS = "if(s_suppkey % 9 = 0, repeat('k', 301), s_name)"
register("l22_imported_candidates", lambda spark, sf_dir: upkeep.imported_candidates(_candidates(spark, sf_dir), standin.table(spark, sf_dir, "supplier").selectExpr("concat('ats', s_suppkey % 3) AS kind", f"{_RESULTS} AS key", "element_at(array('ok', 'error', 'exception', 'not_found', null), cast(s_suppkey % 5 + 1 as int)) AS status", "if(s_suppkey % 4 = 0, null, s_suppkey) AS nl"), AS_OF), f""", {_CANDIDATES}
    SELECT * FROM candidates UNION ALL SELECT 'ats' || (s_suppkey % 3), s_name, CASE s_suppkey % 5 WHEN 0 THEN 'ok' WHEN 3 THEN 'not_found' ELSE 'error' END, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_suppkey END, {NOW} FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 9 <> 0 AND s_suppkey % 5 NOT IN (1, 2)""")
register("l22_new_candidates", lambda spark, sf_dir: ingest.new_candidates(standin.table(spark, sf_dir, "supplier").selectExpr("concat('ats', s_suppkey % 3) AS kind", f"{_RESULTS} AS key"), _candidates(spark, sf_dir)),
         "SELECT 'ats' || (s_suppkey % 3) AS kind, s_name AS key FROM supplier WHERE s_suppkey % 2 = 1 AND s_suppkey % 9 <> 0")
register("o4_stalest", lambda spark, sf_dir: ingest.stalest(_candidates(spark, sf_dir), AS_OF, 10), f", {_CANDIDATES} SELECT * FROM candidates WHERE (status = 'ok' AND nl = 0 AND checked_at < {NOW} - INTERVAL 90 DAY) OR (status <> 'ok' AND checked_at < {NOW} - INTERVAL 7 DAY) ORDER BY checked_at, key LIMIT 10")
register("o5_rotation", lambda spark, sf_dir: ingest.rotation(standin.table(spark, sf_dir, "part").select(F.col("p_brand").alias("ats")), AS_OF),
         f", p AS (SELECT p_brand AS platform, row_number() OVER (ORDER BY p_brand) - 1 AS place, count(*) OVER () AS n, count(*) AS boards FROM part GROUP BY p_brand), t AS (SELECT *, (place - week({NOW}) * 3 % n + n) % n AS turn FROM p) SELECT platform, CAST(turn AS INTEGER) AS turn, boards FROM t WHERE turn < 3")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = _boards(spark, sf_dir).select("slug", F.expr("element_at(array('ok', 'ok', 'not_found', 'error', 'exception'), cast(source_id % 5 + 1 as int))").alias("status"))
    listed = postings(spark, sf_dir).join(_boards(spark, sf_dir).select("source_id", "slug"), "source_id").where("source_id % 10 <> 1")
    return upkeep.probe_results(fetched, listed.select("slug", F.expr("case id % 4 when 0 then 'Delft' when 1 then 'Berlin' when 2 then 'Somewhere' end").alias("location"), F.expr("if(id % 9 = 0, 'nl', null)").alias("country")))


_PROBES = """n AS (SELECT source_id, count(*) AS total, count(*) FILTER (WHERE id % 4 = 0 OR id % 9 = 0) AS nl FROM postings WHERE source_id % 10 <> 1 GROUP BY source_id),
    probes AS (SELECT slug, source_id, ['ok', 'ok', 'not_found', 'error', 'exception'][source_id % 5 + 1] AS status, CASE WHEN source_id % 5 < 2 THEN coalesce(total, 0) END AS total, CASE WHEN source_id % 5 < 2 THEN coalesce(nl, 0) ELSE 0 END AS nl FROM sources LEFT JOIN n USING (source_id))"""
register("l25_probe_results", _probes, f", {_PROBES} SELECT slug, status, total, nl FROM probes")
register("l25_to_probe", lambda spark, sf_dir: upkeep.to_probe(_boards(spark, sf_dir).select("slug").union(spark.createDataFrame([("new",), ("new",)], "slug string")), _probes(spark, sf_dir)), f", {_PROBES} SELECT slug FROM probes WHERE status IN ('error', 'exception') UNION ALL SELECT 'new'")
register("a29_probe_summary", lambda spark, sf_dir: ingest.probe_summary(_probes(spark, sf_dir)), f", {_PROBES} SELECT count(*) AS probed, count(*) FILTER (WHERE status = 'ok') AS alive, count(*) FILTER (WHERE nl > 0) AS with_nl, CAST(sum(nl) AS BIGINT) AS nl FROM probes")
register("l23_boards_to_register", lambda spark, sf_dir: upkeep.boards_to_register(_probes(spark, sf_dir), _boards(spark, sf_dir), "lever"), f", {_PROBES} SELECT 'lever' AS ats, p.slug FROM probes p JOIN sources s USING (slug) WHERE p.status = 'ok' AND nl >= 1 AND ats <> 'lever'")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "named_struct('ats', '{a}', 'slug', concat('{a}', s_suppkey), 'works', {w})"
    kinds = ", ".join(
        f"array({', '.join(c.format(a=a, w=w) for a, w in row)})" if row else "null"
        for row in ([("lever", "true"), ("ashby", "true")], [("odd", "true"), ("lever", "false"), ("ashby", "s_suppkey % 2 = 0")], [("homerun", "false")], [("odd", "false")], [])
    )
    return standin.table(spark, sf_dir, "supplier").selectExpr("s_name AS company", f"element_at(array({kinds}), cast(s_suppkey % 5 + 1 as int)) AS candidates", "if(s_suppkey % 3 = 0, null, concat('https://c/', s_suppkey)) AS careers_url", "s_suppkey % 4 = 0 AS jsonld", "if(s_suppkey % 7 = 0, named_struct('sitemap', 'map', 'sample', 'sample'), null) AS sitemap", "s_suppkey % 6 = 0 AS guessed")


register("l23_employers_to_register", lambda spark, sf_dir: upkeep.employers_to_register(_entries(spark, sf_dir), ["lever", "ashby"]), """, e AS (SELECT s_name AS company, s_suppkey AS k, s_suppkey % 5 AS t, CASE WHEN s_suppkey % 3 <> 0 THEN 'https://c/' || s_suppkey END AS careers, CASE WHEN s_suppkey % 6 = 0 THEN 'discovery-guess' ELSE 'discovery' END AS how FROM supplier),
    w AS (SELECT *, t IN (0, 2) OR (t = 1 AND k % 2 = 0) AS won, k % 4 = 0 AND careers IS NOT NULL AS page FROM e)
    SELECT company, 'lever' AS ats, 'lever' || k AS slug, careers AS url, how AS discovered_by, true AS active FROM w WHERE t = 0 UNION ALL SELECT company, 'odd', 'odd' || k, careers, 'discovery', false FROM w WHERE t IN (1, 3)
    UNION ALL SELECT company, 'ashby', 'ashby' || k, careers, how, true FROM w WHERE t = 1 AND k % 2 = 0 UNION ALL SELECT company, 'jsonld', 'https://homerun' || k || '.homerun.co/sitemap.xml', careers, 'discovery', true FROM w WHERE t = 2
    UNION ALL SELECT company, 'jsonld', careers, careers, 'discovery', true FROM w WHERE NOT won AND page UNION ALL SELECT company, 'jsonld', 'map', 'sample', 'ind-register', true FROM w WHERE NOT won AND NOT page AND k % 7 = 0""")

# ---------- accounts and runs ----------

_USERS = {"user_id": "c_custkey", "email": "concat(c_name, '@mail.example')", "alerts": "CASE c_custkey % 3 WHEN 0 THEN 'daily' WHEN 1 THEN 'weekly' END"}
_SINCE = "interval {d} day"


def _accounts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    customer, ago = standin.table(spark, sf_dir, "customer"), lambda days: F.expr(f"timestamp_ntz'{AS_OF}' - make_dt_interval(cast({days} as int))")
    base = customer.select("c_custkey", *(F.expr(e).alias(c) for c, e in _USERS.items()), ago("c_custkey % 900").alias("created_at"), F.when(F.expr("c_custkey % 4 <> 0"), ago("c_custkey % 800")).alias("last_login_at"))
    return {
        "users": base.drop("c_custkey"),
        "sessions": base.select(F.concat(F.lit("s"), "user_id").alias("session_id"), "user_id", ago("c_custkey % 5 - 2").alias("expires_at")),
        "tokens": base.select(F.concat(F.lit("t"), "user_id").alias("token"), "email", ago("c_custkey % 5").alias("created_at")),
        "user_data": base.where("c_custkey % 5 <> 0").select("user_id", F.lit('{"a":1}').alias("profile"), F.expr("if(c_custkey % 2 = 0, null, array(c_custkey))").alias("saved")),
        "feedback": base.select("user_id", ago("c_custkey % 500").alias("created_at")),
    }


_ACCOUNTS = f"""u AS (SELECT c_custkey AS k, {", ".join(f"{e} AS {c}" for c, e in _USERS.items())}, {NOW} - to_days(CAST(c_custkey % 900 AS INTEGER)) AS created_at, CASE WHEN c_custkey % 4 <> 0 THEN {NOW} - to_days(CAST(c_custkey % 800 AS INTEGER)) END AS last_login_at FROM customer),
    live AS (SELECT * FROM u WHERE NOT coalesce(last_login_at, created_at) < {NOW} - INTERVAL 730 DAY)"""


def _kept(table: str, key: str):
    return lambda spark, sf_dir: upkeep.account_cleanup(**_accounts(spark, sf_dir), as_of=AS_OF)[table].select(key)


register("l19_users_kept", _kept("users", "user_id"), f", {_ACCOUNTS} SELECT k AS user_id FROM live")
register("l19_sessions_kept", _kept("sessions", "session_id"), f", {_ACCOUNTS} SELECT 's' || k AS session_id FROM live WHERE k % 5 <= 2")
register("l19_tokens_kept", _kept("tokens", "token"), f", {_ACCOUNTS} SELECT 't' || k AS token FROM u WHERE k % 5 <= 2")
register("l19_user_data_kept", _kept("user_data", "user_id"), f", {_ACCOUNTS} SELECT k AS user_id FROM live WHERE k % 5 <> 0")
register("l19_feedback_kept", _kept("feedback", "user_id"), f", {_ACCOUNTS} SELECT k AS user_id FROM u WHERE k % 500 <= 365")


def _without_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _accounts(spark, sf_dir)
    left = upkeep.without_account(tables["users"], tables["sessions"], tables["tokens"], tables["user_data"], 3)
    counted = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, rows in left.items()]
    return counted[0].union(counted[1]).union(counted[2]).union(counted[3])


register("l24_account_deleted", _without_three, ", n AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_custkey % 5 <> 0) AS d FROM customer) SELECT unnest(['users', 'sessions', 'tokens', 'user_data']) AS table_name, unnest([n - 1, n - 1, n - 1, d - 1]) AS n FROM n")
register("l24_account_export", lambda spark, sf_dir: _exported(spark, sf_dir), f""", {_ACCOUNTS} SELECT k AS user_id, email, coalesce(alerts, 'off') AS alerts, CASE WHEN k % 5 <> 0 THEN '{{"a":1}}' ELSE '{{}}' END AS profile, CASE WHEN k % 5 <> 0 AND k % 2 = 1 THEN k END AS saved FROM u""")


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _accounts(spark, sf_dir)
    get = lambda path: F.get_json_object("document", path)
    return upkeep.account_export(tables["users"], tables["user_data"]).select("user_id", get("$.email").alias("email"), get("$.job_alerts").alias("alerts"), get("$.profile").alias("profile"), get("$.saved_job_ids[0]").cast("long").alias("saved"))


register("l24_upsert", lambda spark, sf_dir: ingest.upsert(standin.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS key", "'old' AS value"), standin.table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").selectExpr("s_suppkey * 2 AS key", "'new' AS value"), ["key"]),
         "SELECT s_suppkey AS key, 'old' AS value FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey * 2 FROM supplier WHERE s_suppkey % 3 = 0) UNION ALL SELECT s_suppkey * 2, 'new' FROM supplier WHERE s_suppkey % 3 = 0")
register("o6_latest_runs", lambda spark, sf_dir: upkeep.latest_runs(standin.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))).select("run_id"), "SELECT o_orderkey AS run_id FROM orders ORDER BY 1 DESC LIMIT 20")

# ---------- addresses, names, labels ----------

_FETCHED = {
    "status": "CASE id % 12 WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 503 WHEN 3 THEN NULL ELSE 200 END",
    "content_type": "CASE WHEN id % 13 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END",
    "final_url": "CASE id % 12 WHEN 4 THEN 'https://other.example/x' WHEN 5 THEN 'https://jobs.example/vacatures/' ELSE url END",
    "html": "CASE id % 12 WHEN 6 THEN concat('<title>Page not found</title><p>nothing') WHEN 7 THEN '<p>Deze vacature is niet meer online</p>' WHEN 8 THEN concat('<title>Expired</title><b>', upper(title), '</b>') WHEN 9 THEN '<script>var a = \"this job is closed\"</script><p>Welcome</p>' ELSE '<p>fine</p>' END",
}
register("x35_link_verdicts", lambda spark, sf_dir: postings(spark, sf_dir).select("id", "url", "title", *(F.expr(e).alias(c) for c, e in _FETCHED.items())).select("id", links.link_verdict(*(F.col(c) for c in ("status", "content_type", "url", "final_url", "html", "title"))).alias("verdict")),
         """SELECT id, CASE WHEN id % 12 IN (0, 1) THEN 'gone' WHEN id % 12 IN (2, 3) THEN 'error' WHEN id % 12 IN (4, 5) THEN 'redirected' WHEN id % 13 <> 0 AND id % 12 IN (6, 7) THEN 'gone' ELSE 'ok' END AS verdict FROM postings""")  # fmt: skip
_DETAIL_URL = "CASE id % 6 WHEN 0 THEN concat('https://a.example/jobs/', id + 100) WHEN 1 THEN 'https://a.example/vacatures/data-engineer-team' WHEN 2 THEN 'https://a.example/vacatures/' WHEN 3 THEN 'https://a.example/werken-bij-ons/vacature/senior-data-engineer.html' WHEN 4 THEN 'https://a.example/blog/a-long-title-here' ELSE 'https://a.example/careers/search' END"
register("x34_detail_urls", lambda spark, sf_dir: postings(spark, sf_dir).select("id", links.is_detail(F.expr(_DETAIL_URL)).alias("detail")), "SELECT id, id % 6 IN (0, 1, 3) AS detail FROM postings")
register("x46_domains", lambda spark, sf_dir: standin.table(spark, sf_dir, "pages").select("page_id", links.site_domain(F.col("url")).alias("domain"), links.head_count(F.expr("case page_id % 5 when 0 then '3.600' when 1 then '43,520 (2024)' when 2 then concat('{{formatnum:', page_id, '}}') when 3 then '4 000 000' else 'none <ref>12</ref>' end")).alias("heads")), r"""
    SELECT page_id, regexp_extract(regexp_replace(split_part(lower(regexp_extract(url, '//([^/?#]*)', 1)), ':', 1), '^www\.', ''), '([^.]*\.[^.]*|[^.]*)$', 1) AS domain, CASE page_id % 5 WHEN 0 THEN 3600 WHEN 1 THEN 43520 WHEN 2 THEN CASE WHEN page_id >= 1 THEN page_id END END AS heads FROM pages""")
_NAME = "CASE c_custkey % 5 WHEN 0 THEN concat('Café Noord ', c_custkey, ' B.V.') WHEN 1 THEN 'Acme Robotics Holding (NL)' WHEN 2 THEN 'The ABN Group' WHEN 3 THEN 'van der Berg & Zonen N.V.' ELSE 'GmbH' END"
register("x29_names", lambda spark, sf_dir: standin.table(spark, sf_dir, "customer").withColumn("name", F.expr(_NAME)).select("c_custkey", links.clean_name(F.col("name")).alias("clean"), links.name_key(F.col("name")).alias("key"), F.array_join(links.name_tokens(F.col("name")), " ").alias("tokens"), F.array_join(links.domain_candidates(F.col("name")), " ").alias("domains")), """
    SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Cafe Noord ' || c_custkey WHEN 1 THEN 'Acme Robotics' WHEN 2 THEN 'The ABN' WHEN 3 THEN 'van der Berg & Zonen' ELSE '' END AS clean,
           CASE c_custkey % 5 WHEN 0 THEN 'cafenoord' || c_custkey WHEN 1 THEN 'acmerobotics' WHEN 2 THEN 'theabn' WHEN 3 THEN 'vanderbergzonen' ELSE '' END AS key,
           CASE c_custkey % 5 WHEN 0 THEN 'cafe noord' || CASE WHEN c_custkey >= 1000 THEN ' ' || c_custkey ELSE '' END WHEN 1 THEN 'acme robotics' WHEN 3 THEN 'berg zonen' ELSE '' END AS tokens,
           CASE c_custkey % 5 WHEN 0 THEN replace('cafenoord#.nl cafenoord#.com cafenoord#.eu cafenoord#.io cafe-noord-#.nl cafe-noord-#.com cafe-noord-#.eu cafe-noord-#.io', '#', CAST(c_custkey AS VARCHAR)) WHEN 1 THEN 'acmerobotics.nl acmerobotics.com acmerobotics.eu acmerobotics.io acme-robotics.nl acme-robotics.com acme-robotics.eu acme-robotics.io'
                WHEN 2 THEN 'theabn.nl theabn.com theabn.eu theabn.io the-abn.nl the-abn.com the-abn.eu the-abn.io' WHEN 3 THEN 'vanderbergzonen.nl vanderbergzonen.com vanderbergzonen.eu vanderbergzonen.io van-der-berg-zonen.nl van-der-berg-zonen.com van-der-berg-zonen.eu van-der-berg-zonen.io' ELSE '' END AS domains FROM customer""")
_HOME = "CASE c_custkey % 6 WHEN 0 THEN '<title>Acme makes arms</title>' WHEN 1 THEN '<title>Acme Robotics</title>' WHEN 2 THEN '<title>Acme Robotics - domain for sale</title>' WHEN 3 THEN '<title>Somebody</title>' WHEN 4 THEN '' ELSE '<meta property=\"og:site_name\" content=\"ACME\">' END"
register("x43_verified", lambda spark, sf_dir: standin.table(spark, sf_dir, "customer").select("c_custkey", links.names_employer(F.lit("Acme Robotics B.V."), F.expr("if(c_custkey % 2 = 0, 'acmerobotics.nl', 'acme.nl')"), F.expr(_HOME)).alias("verified")),
         "SELECT c_custkey, c_custkey % 6 IN (0, 1) AS verified FROM customer")
register("x42_paths", lambda spark, sf_dir: postings(spark, sf_dir).select("id", links.job_path(F.col("id"), F.col("title"), "nl").alias("job"), links.company_path(F.lit("a-b")).alias("company"), links.age_label(F.coalesce("posted_at", "first_seen").cast("timestamp_ntz") + F.expr("interval 3 years"), AS_OF, "en").alias("age"),
                                                                               links.jobs_link(F.expr("map('role', if(id % 2 = 0, 'data,it', ''), 'remote', if(id % 3 = 0, 'true', 'false'))"), F.expr("if(id % 5 = 0, 'Den Haag', null)")).alias("link")), f"""
    , d AS (SELECT *, CAST(floor(epoch({NOW} - (CAST(coalesce(posted_at, first_seen) AS TIMESTAMP) + INTERVAL 3 YEAR)) / 86400) AS BIGINT) AS days FROM postings),
    q AS (SELECT *, list_filter([CASE WHEN id % 2 = 0 THEN 'role=data,it' END, CASE WHEN id % 3 = 0 THEN 'remote=true' END, CASE WHEN id % 5 = 0 THEN 'city=Den+Haag' END], lambda x: x IS NOT NULL) AS parts FROM d)
    SELECT id, '/nl/vacature/' || id || '/' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS job, '/company/a-b' AS company, CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN 'yesterday' ELSE days || 'd ago' END AS age,
           '/#jobs' || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS link FROM q""")  # fmt: skip
register("x47_overrides", lambda spark, sf_dir: upkeep.with_overrides(
    standin.table(spark, sf_dir, "part").selectExpr("p_partkey AS item_id", "p_type AS role_family", "'junior' AS seniority", "array(p_brand, 'SQL', 'Go') AS skills_required", "array('Java') AS skills_nice"),
    standin.table(spark, sf_dir, "part").where("p_partkey % 2 = 0").selectExpr("p_partkey AS item_id", "if(p_partkey % 4 = 0, 'data', null) AS role_family", "cast(null as string) AS seniority", "array('Go') AS remove", "if(p_partkey % 6 = 0, array('SQL', 'Rust'), null) AS add", "array('Java', 'Rust', 'Ada') AS add_nice"),
).withColumns({c: F.array_join(c, " ") for c in ("skills_required", "skills_nice")}), """
    SELECT p_partkey AS item_id, CASE WHEN p_partkey % 4 = 0 THEN 'data' ELSE p_type END AS role_family, 'junior' AS seniority, p_brand || CASE WHEN p_partkey % 6 = 0 THEN ' SQL Rust' WHEN p_partkey % 2 = 0 THEN ' SQL' ELSE ' SQL Go' END AS skills_required,
           'Java' || CASE WHEN p_partkey % 6 = 0 THEN ' Ada' WHEN p_partkey % 2 = 0 THEN ' Rust Ada' ELSE '' END AS skills_nice FROM part""")  # fmt: skip
_TYPED = "CASE c_custkey % 8 WHEN 0 THEN ' K8s ' WHEN 1 THEN 'ml' WHEN 2 THEN 'python' WHEN 3 THEN 'postgres' WHEN 4 THEN 'knitting' WHEN 5 THEN '' WHEN 6 THEN 'google cloud' ELSE 'senior python work' END"
register("x13_canonical_skills", lambda spark, sf_dir: by_distinct(standin.table(spark, sf_dir, "customer").select("c_custkey"), F.expr(_TYPED), skill=skills.canonical_skill, several=lambda t: F.array_join(skills.canonical_skills(F.array(t, F.lit("LLM"), F.lit("genai"), F.lit("chess "))), ","), kept=lambda t: F.array_join(skills.canonical_skills(F.array(t, F.lit("chess ")), True), ",")), """
    , s AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Kubernetes' WHEN 1 THEN 'Machine Learning' WHEN 2 THEN 'Python' WHEN 3 THEN 'PostgreSQL' WHEN 6 THEN 'GCP' WHEN 7 THEN 'Python' END AS skill FROM customer)
    SELECT c_custkey, skill, CASE WHEN skill IS NULL THEN 'LLMs' ELSE skill || ',LLMs' END AS several, CASE WHEN c_custkey % 8 = 4 THEN 'knitting,chess' WHEN skill IS NULL THEN 'chess' ELSE skill || ',chess' END AS kept FROM s""")  # fmt: skip

# ---------- discovery ----------


def _customers(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return standin.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), *(F.expr(e).alias(c) for c, e in columns.items()))


_MARKUP = """concat('<a href="https://boards.greenhouse.io/Acme', page_id % 50, '">x</a> https://api.ashbyhq.com/posting-api/job-board/acme', if(page_id % 2 = 0, ' https://Careers.recruitee.com https://acme-', ' https://acme-'), page_id, '.recruitee.com/ https://t.wd3.myworkdayjobs.com/en-US/Site', page_id % 3,
    ' https://boards.greenhouse.io/Acme', page_id % 50, if(page_id % 3 = 0, ' https://static.homerun.co/a.js https://acme.homerun.co', ''), ' apply.workable.com/api/v1/widget/accounts/w', page_id, ' apply.workable.com/j/ABC')""".replace("page_id", "c_custkey")
register("x33_boards_on_pages", lambda spark, sf_dir: discovery.boards_on_pages(_customers(spark, sf_dir, html=_MARKUP)), """
    , b AS (SELECT c_custkey AS k, list_filter([{'ats': 'greenhouse', 'slug': 'Acme' || (c_custkey % 50)}, {'ats': 'ashby', 'slug': 'acme'}, {'ats': 'workable', 'slug': 'w' || c_custkey}, {'ats': 'recruitee', 'slug': 'acme-' || c_custkey}, {'ats': 'workday', 'slug': 't.wd3/Site' || (c_custkey % 3)},
        CASE WHEN c_custkey % 3 = 0 THEN {'ats': 'homerun', 'slug': 'acme'} END], lambda x: x IS NOT NULL) AS l FROM customer), e AS (SELECT k, unnest(l) AS b, unnest(range(len(l))) AS nth FROM b) SELECT k AS page_id, CAST(nth AS INTEGER) AS nth, b.ats AS ats, b.slug AS slug FROM e""")
_LINKS = """concat('<a class=x href="/about">About us</a><a href=\\'jobs/all\\'><b>Open</b> list</a><a href="https://jobs.lever.co/acme', c_custkey, '">apply</a><a href="/team#top">Join us</a><a href="https://other.example/careers">elsewhere</a>', '<a href="https://www.acme.example/jobs/all">Vacatures</a><a href="https://other.example/x">jobs</a>')"""
register("x33_careers_links", lambda spark, sf_dir: discovery.careers_links(_customers(spark, sf_dir, url="'https://www.acme.example/'", html=_LINKS)),
         "SELECT c_custkey AS page_id, unnest([1, 2, 3]) AS rank, unnest(['https://jobs.lever.co/acme' || c_custkey, 'https://www.acme.example/jobs/all', 'https://www.acme.example/team']) AS href FROM customer")
_ROBOTS = """concat('# file of ', c_custkey, '\\nUser-agent: *\\nDisallow: /private\\nAllow: /private/open*end$\\n', if(c_custkey % 3 = 0, 'User-agent: other\\nUser-agent: TideBot\\nDisallow: /jobs\\nDisallow:\\nAllow: /jobs/it\\n', ''), if(c_custkey % 4 = 0, 'User-Agent: *\\nDisallow: /*.pdf$ # files\\nAllow: /a+b\\nDisallow: /a+b\\n', ''))"""
_PATH = "element_at(array('/private/x', '/private/open/the/end', '/private/open/the/end/not', '/jobs/it/1', '/jobs/hr', '/x.pdf', '/x.pdf?a', '/a+b', '/aab'), cast({k} % 9 + 1 as int))"


def _robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _customers(spark, sf_dir, host="concat('h', c_custkey)", text=_ROBOTS)
    urls = standin.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("concat('h', o_custkey + if(o_orderkey % 20 = 0, 100000000, 0))").alias("host"), F.expr(_PATH.format(k="o_orderkey")).alias("path"))
    return discovery.with_robots_verdict(urls, discovery.robots_rules(files, "tidebot/1.0")).select("id", "allowed")


register("x32_robots", _robots, """, u AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 9 AS p, o_orderkey % 20 = 0 AS other FROM orders)
    SELECT id, CASE WHEN other THEN true WHEN c % 3 = 0 THEN p <> 4 ELSE p NOT IN (0, 2) AND NOT (c % 4 = 0 AND p = 5) END AS allowed FROM u""")


def _entries_of_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight addresses in each of three sitemaps of a domain; the second has most postings, the third is on a platform."""
    rows = standin.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("nth"))
    rows = rows.select("k", "nth", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("at"))
    return rows.selectExpr("concat('d', k) AS domain", "element_at(array('https://a.example/map1', 'https://a.example/map2', 'https://x.recruitee.com/map'), nth + 1) AS sitemap", "nth", "at",
                           "if(at < case nth when 0 then 3 when 1 then 2 + k % 4 else 8 end, concat('https://a.example/jobs/', 1000 + at), concat('https://a.example/about/', at)) AS url", "at = k % 5 AS has_posting")


register("x44_job_sitemaps", lambda spark, sf_dir: discovery.job_sitemaps(_entries_of_sitemaps(spark, sf_dir)), """, s AS (SELECT s_suppkey AS k, 2 + s_suppkey % 4 AS n, s_suppkey % 5 AS h FROM supplier)
    SELECT 'd' || k AS domain, CASE WHEN n > 3 THEN 'https://a.example/map2' ELSE 'https://a.example/map1' END AS sitemap, CASE WHEN n > 3 THEN n ELSE 3 END AS jobs, 'https://a.example/jobs/' || (1000 + h) AS sample FROM s WHERE h < 3""")
register("x45_guesses", lambda spark, sf_dir: _customers(spark, sf_dir, domain="concat(if(c_custkey % 2 = 0, 'https://www.', ''), 'Big-Firm', c_custkey, '.example', if(c_custkey % 3 = 0, '/', ''))").select("page_id", F.array_join(discovery.guessed_slugs(F.col("domain")), " ").alias("slugs"), F.array_join(discovery.careers_hosts(F.col("domain")), " ").alias("hosts")), """
    SELECT c_custkey AS page_id, replace('big-firm# bigfirm# big_firm#', '#', CAST(c_custkey AS VARCHAR)) AS slugs, replace('www.big-firm#.example big-firm#.example werkenbij.big-firm#.example careers.big-firm#.example jobs.big-firm#.example werkenbijbig-firm#.nl www.werkenbijbig-firm#.nl werkenbij-big-firm#.nl', '#', CAST(c_custkey AS VARCHAR)) AS hosts FROM customer""")

# ---------- page views ----------

_REQUEST = {
    "path": "CASE event_id % 6 WHEN 0 THEN '/api/postings' WHEN 1 THEN '/api/gap' WHEN 2 THEN '/api/auth/request' WHEN 3 THEN '/jobs/data-engineer' WHEN 4 THEN '/metrics' ELSE '/' END",
    "method": "CASE WHEN event_id % 12 = 6 THEN 'POST' ELSE 'GET' END",
    "query": "CASE WHEN event_id % 18 = 0 THEN 'page=2&q=x' WHEN event_id % 4 = 0 THEN 'q=data&utm_source=mail' ELSE 'utm_source=' END",
    "referer": "CASE WHEN event_id % 5 = 0 THEN 'https://www.search.example/x' WHEN event_id % 5 = 1 THEN 'https://own.example/' END",
    "event": "CASE WHEN event_id % 7 = 0 THEN 'nav' END",
    "country": "CASE WHEN event_id % 3 = 0 THEN 'NLD' WHEN event_id % 3 = 1 THEN '' END",
}
register("c6_recorded", lambda spark, sf_dir: agents.recorded(standin.table(spark, sf_dir, "events").select("event_id", "ts", F.lit(200).alias("status"), F.col("value").alias("ms"), F.lit(7).alias("bytes"), F.lit("1.2.3.4").alias("ip"), F.lit("curl/8.0").alias("agent"), F.lit(None).cast("string").alias("detail"), *(F.expr(e).alias(c) for c, e in _REQUEST.items())), "own.example", F.lit("salt"))
         .select("event_id", "kind", "path", "ms", "referrer", "utm_source", "country", "browser", "bot", "visitor", "event", "detail"), f""", r AS (SELECT event_id, value, {", ".join(f"{e} AS {c}" for c, e in _REQUEST.items())} FROM events),
    k AS (SELECT *, CASE WHEN event IS NOT NULL THEN 'event' WHEN path LIKE '/api/%' THEN 'api' ELSE 'page' END AS kind, CASE WHEN query LIKE 'q=data%' THEN 'q=data' END AS found FROM r WHERE event IS NOT NULL OR path <> '/metrics'),
    s AS (SELECT *, kind = 'api' AND path = '/api/postings' AND method = 'GET' AS search FROM k)
    SELECT event_id, kind, path, CAST(trunc(value) AS BIGINT) AS ms, CASE WHEN kind = 'page' AND event_id % 5 = 0 THEN 'search.example' END AS referrer, CASE WHEN query LIKE '%utm_source=mail' THEN 'mail' END AS utm_source, CASE WHEN event_id % 3 = 0 THEN 'NL' END AS country, 'curl' AS browser, true AS bot,
           left(sha256('salt|1.2.3.4|curl/8.0'), 16) AS visitor, CASE WHEN search THEN CASE WHEN found IS NOT NULL THEN 'search' END WHEN kind = 'api' AND path = '/api/gap' THEN 'gap' WHEN kind = 'api' AND path = '/api/auth/request' THEN 'login_request' ELSE event END AS event,
           CASE WHEN search THEN found END AS detail FROM s""")  # fmt: skip


def _headcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an employer, with entries and articles made of its numbers."""
    c = standin.table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    companies = c.select(F.col("c_name").alias("company"), F.expr("if(k % 7 = 0, null, array(concat('c', k, '.example')))").alias("domains"))
    claim = lambda n, year: f"""concat('{{"mainsnak":{{"datavalue":{{"value":{{"amount":"+', {n}, '"}}}}}},"qualifiers":{{"{headcounts.AT}":[{{"datavalue":{{"value":{{"time":"+', {year}, '-01-01T00:00:00Z"}}}}}}]}}}}')"""
    payload = f"""concat('{{"labels":{{"nl":{{"value":"', if(k % 3 = 0, upper(c_name), 'Other'), ' B.V."}}}},"aliases":{{"en":[{{"value":"x"}}]}},"claims":{{"{headcounts.SITE}":[{{"mainsnak":{{"datavalue":{{"value":"https://www.c', k + k % 2, '.example/nl"}}}}}}],',
        '"{headcounts.COUNTRY}":[{{"mainsnak":{{"datavalue":{{"value":{{"id":"', if(k % 9 < 6, 'Q55', 'Q31'), '"}}}}}}}}],"{headcounts.HEADCOUNT}":[', {claim('k % 500', '2015 + k % 5')}, ',', {claim('k % 400', '2017')}, ',{{"mainsnak":{{}}}}]}}}}')"""
    entries = c.select(F.col("c_name").alias("company"), F.lit(2).alias("nth"), F.concat(F.lit("Q"), "k").alias("entry_id"), F.expr(payload).alias("payload"))
    empty = c.select(F.col("c_name").alias("company"), F.lit(1).alias("nth"), F.lit("Q0").alias("entry_id"), F.lit('{"claims":{}}').alias("payload"))
    text = """concat('{{Infobox company\\n| website = [https://c', k, '.example/en site]\\n| num_employees = {{formatnum:', k % 900 + 1000, '}} (2021)\\n}}\\n', if(k % 4 < 2, c_name, 'Somebody'), ' is a firm.')"""
    articles = c.select(F.col("c_name").alias("company"), F.expr("if(k % 2 = 0, 'nl', 'en')").alias("lang"), F.lit(1).alias("nth"), F.expr("if(k % 8 = 2, lower(c_name), 'Some page')").alias("title"), F.expr(text).alias("wikitext"))
    listed = c.select(F.col("c_name").alias("company"), "k")
    return headcounts.headcounts(companies, entries.unionByName(empty), articles, listed.where("k % 10 = 1"), listed.where("k % 10 = 2"))


register("j13_headcounts", _headcounts, """, c AS (SELECT c_custkey AS k, c_name AS company, c_custkey % 7 <> 0 AS has FROM customer WHERE c_custkey % 10 NOT IN (1, 2)),
    kb AS (SELECT *, has AND k % 2 = 0 OR k % 3 = 0 AND k % 9 < 6 AS fits FROM c), y AS (SELECT *, 2015 + k % 5 AS y FROM kb)
    SELECT company, CASE WHEN y >= 2017 THEN k % 500 ELSE k % 400 END AS employees, CAST(greatest(y, 2017) AS VARCHAR) AS as_of, 'wikidata:Q' || k AS source FROM y WHERE fits
    UNION ALL
    SELECT company, k % 900 + 1000, '2021', CASE WHEN k % 2 = 0 THEN 'nl' ELSE 'en' END || 'wiki:' || CASE WHEN k % 8 = 2 THEN lower(company) ELSE 'Some page' END FROM y WHERE NOT fits AND has AND (k % 4 < 2 OR k % 8 = 2)""")  # fmt: skip


def _renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings and their boards under new ids."""
    tables = {"postings": standin.postings(spark, sf_dir, skills=False).select("id", "source_id", "duplicate_of", "title"), "sources": standin.sources(spark, sf_dir).where("source_id % 7 <> 3").select("source_id", "slug")}
    return copying.renumbered(tables, {"postings": "id", "sources": "source_id"}, [("postings", "source_id", "sources"), ("postings", "duplicate_of", "postings")])["postings"]


register("l26_renumbered_postings", _renumbered, """, p AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM postings), s AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS n FROM sources WHERE source_id % 7 <> 3)
    SELECT p.n AS id, s.n AS source_id, d.n AS duplicate_of, title FROM postings JOIN p USING (id) LEFT JOIN s ON s.source_id = postings.source_id LEFT JOIN p d ON d.id = duplicate_of""")
