"""Queries over the lifecycle of postings and boards, and over duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import alerts, duplicates, ingest, matching
from tidemark.operators.rows import with_positions
from tidemark.plans.stats import NOW, ROWS_SQL, rows
from tidemark.sources import standin
from tidemark.sources.standin import AS_OF

QUERIES, ORACLE_SQL = {}, {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = f"WITH {ROWS_SQL} {sql}"


_CONTENT = {
    "title": "title", "company": "company", "city": "city", "country": "'NL'", "remote": "remote", "url": "url", "description": "concat('text of ', title, ' that is long enough to be a text, version ', {v})",
    "posted_at": "posted_at", "valid_through": "{valid}", "content_hash": "concat(external_id, '-', {v})", "dedup_key": "lower(company)",
}
_AFTER = "timestamp_ntz'2001-06-01 00:00:00'"


def _content(version: str, valid: str) -> list:
    return [F.expr(e.format(v=version, valid=valid)).alias(c) for c, e in _CONTENT.items()]


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored: two in three postings."""
    rows = standin.postings(spark, sf_dir, skills=False).where("id % 3 <> 2")
    return rows.select(F.col("source_id").cast("long").alias("source_id"), "external_id", "first_seen", "last_seen", "closed_at", *_content("'1'", "cast(null as timestamp_ntz)"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl brings: every other posting of most boards, some changed, foreign, expired, or under a new id."""
    rows = standin.postings(spark, sf_dir, skills=False).where("(id % 2 = 0 or source_id % 5 = 1) and source_id % 7 <> 0 and (source_id % 4 <> 1 or id % 16 = 0)")
    out = rows.select(F.col("source_id").cast("long").alias("source_id"), "id", "external_id", *_content("case when id % 5 = 0 then '2' else '1' end", f"case when id % 29 = 0 then {_AFTER} end"))
    moved = F.when(F.col("id") % 31 == 0, F.concat(F.lit("moved-"), "external_id")).otherwise(F.col("external_id"))
    return out.withColumns({"country": F.when(F.col("id") % 37 == 0, "BE").otherwise("NL"), "external_id": moved}).drop("id")


_SNAPSHOT_SQL = """, state AS (SELECT source_id, external_id, first_seen, last_seen, closed_at, url, external_id || '-1' AS content_hash FROM postings WHERE id % 3 <> 2),
    snap AS (SELECT source_id, CASE WHEN id % 31 = 0 THEN 'moved-' || external_id ELSE external_id END AS external_id, external_id || CASE WHEN id % 5 = 0 THEN '-2' ELSE '-1' END AS content_hash, url,
             CASE WHEN id % 37 = 0 THEN 'BE' ELSE 'NL' END AS country, CASE WHEN id % 29 = 0 THEN TIMESTAMP '2001-06-01' END AS valid_through
             FROM postings WHERE (id % 2 = 0 OR source_id % 5 = 1) AND source_id % 7 <> 0 AND (source_id % 4 <> 1 OR id % 16 = 0)),
    trust AS (SELECT source_id, NOT (count(valid_through) >= 5 AND count(valid_through) FILTER (WHERE valid_through < {now}) / greatest(count(valid_through), 1) > 0.8) AS trusted FROM snap GROUP BY source_id),
    fated AS (SELECT snap.*, CASE WHEN country <> 'NL' THEN 'foreign' WHEN trusted AND coalesce(valid_through < {now}, false) THEN 'expired' ELSE 'seen' END AS fate FROM snap JOIN trust USING (source_id)),
    seen AS (SELECT * FROM fated WHERE fate = 'seen'),
    part AS (SELECT source_id, coalesce(last_nl_count, 0) >= 10 AND count(*) < 0.5 * last_nl_count AS partial FROM seen JOIN sources USING (source_id) GROUP BY source_id, last_nl_count),
    lost AS (SELECT source_id, url, min(external_id) AS old_id FROM state s WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.source_id = s.source_id AND x.external_id = s.external_id) GROUP BY source_id, url),
    keyed AS (SELECT seen.*, coalesce(CASE WHEN NOT EXISTS (SELECT 1 FROM state s WHERE s.source_id = seen.source_id AND s.external_id = seen.external_id) THEN lost.old_id END, seen.external_id) AS match_id
              FROM seen LEFT JOIN lost ON lost.source_id = seen.source_id AND lost.url = seen.url),
    merged AS (SELECT coalesce(k.source_id, s.source_id) AS source_id, coalesce(k.external_id, s.external_id) AS external_id,
                 CASE WHEN s.external_id IS NULL THEN 'new' WHEN k.match_id IS NOT NULL AND k.content_hash <> s.content_hash THEN 'updated' WHEN k.match_id IS NOT NULL AND s.closed_at IS NOT NULL THEN 'reopened'
                      WHEN k.match_id IS NOT NULL THEN 'touched'
                      WHEN s.source_id IN (SELECT source_id FROM snap) AND NOT coalesce((SELECT partial FROM part p WHERE p.source_id = s.source_id), false) AND s.closed_at IS NULL THEN 'closed' ELSE 'kept' END AS change,
                 s.closed_at AS old_closed, k.match_id IS NOT NULL AS found
               FROM state s FULL OUTER JOIN keyed k ON s.source_id = k.source_id AND s.external_id = k.match_id)""".replace("{now}", NOW)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.merge(state(spark, sf_dir), ingest.unique_ids(snapshot(spark, sf_dir)), standin.sources(spark, sf_dir), AS_OF)


register("l1_merge", lambda spark, sf_dir: _merged(spark, sf_dir).select("source_id", "external_id", "change", "closed_at"),
         _SNAPSHOT_SQL + f" SELECT source_id, external_id, change, CASE WHEN found THEN NULL WHEN change = 'closed' THEN {NOW} ELSE old_closed END AS closed_at FROM merged")
_TAKEN = "s.external_id IS NULL OR (k.match_id IS NOT NULL AND k.content_hash <> s.content_hash)"
register("l1_merged_content", lambda spark, sf_dir: _merged(spark, sf_dir).select("source_id", "external_id", "content_hash", F.right("description", F.lit(1)).alias("version"), "title", "url", "country", "valid_through", "first_seen", "last_seen"), _SNAPSHOT_SQL + f"""
    SELECT coalesce(k.source_id, s.source_id) AS source_id, coalesce(k.external_id, s.external_id) AS external_id, CASE WHEN {_TAKEN} THEN k.content_hash ELSE s.content_hash END AS content_hash, right(CASE WHEN {_TAKEN} THEN k.content_hash ELSE s.content_hash END, 1) AS version,
           p.title, coalesce(s.url, k.url) AS url, 'NL' AS country, CASE WHEN {_TAKEN} THEN k.valid_through END AS valid_through, coalesce(s.first_seen, {NOW}) AS first_seen, CASE WHEN k.match_id IS NOT NULL THEN {NOW} ELSE s.last_seen END AS last_seen
    FROM state s FULL OUTER JOIN keyed k ON s.source_id = k.source_id AND s.external_id = k.match_id JOIN postings p ON p.url = coalesce(s.url, k.url)""")
register("l3_l4_fates", lambda spark, sf_dir: ingest.split_snapshot(snapshot(spark, sf_dir), AS_OF).groupBy("source_id", "fate").agg(F.count(F.lit(1)).alias("n")), _SNAPSHOT_SQL + " SELECT source_id, fate, count(*) AS n FROM fated GROUP BY ALL")
register("l7_partial_sources", lambda spark, sf_dir: ingest.partial_sources(ingest.split_snapshot(snapshot(spark, sf_dir), AS_OF).where("fate = 'seen'"), standin.sources(spark, sf_dir)), _SNAPSHOT_SQL + " SELECT source_id, partial FROM part")
register("l9_counters", lambda spark, sf_dir: ingest.counters(_merged(spark, sf_dir), snapshot(spark, sf_dir), standin.sources(spark, sf_dir), AS_OF), _SNAPSHOT_SQL + """,
    a AS (SELECT source_id, count(*) FILTER (WHERE fate = 'seen') AS seen, count(*) FILTER (WHERE fate = 'foreign') AS foreign, count(*) FILTER (WHERE fate = 'expired') AS expired FROM fated GROUP BY source_id),
    b AS (SELECT source_id, count(*) FILTER (WHERE change = 'new') AS new, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'closed') AS closed FROM merged GROUP BY source_id)
    SELECT a.*, b.new, b.updated, b.closed, coalesce(partial, false) AS partial FROM a JOIN b USING (source_id) LEFT JOIN part USING (source_id)""")
register("l5_touch_still_listed", lambda spark, sf_dir: ingest.touch_still_listed(state(spark, sf_dir), snapshot(spark, sf_dir), AS_OF).select("source_id", "external_id", "last_seen", "closed_at"),
         _SNAPSHOT_SQL + f" SELECT s.source_id, s.external_id, CASE WHEN x.source_id IS NULL THEN last_seen ELSE {NOW} END AS last_seen, CASE WHEN x.source_id IS NULL THEN closed_at END AS closed_at FROM state s LEFT JOIN (SELECT DISTINCT source_id, external_id FROM snap) x USING (source_id, external_id)")
register("l12_due_sources", lambda spark, sf_dir: ingest.due_sources(standin.sources(spark, sf_dir), AS_OF), f""", c AS (SELECT *, CASE WHEN last_run_at IS NULL OR last_nl_count IS NULL THEN 0 WHEN last_nl_count >= 20 THEN 60 WHEN last_nl_count >= 1 THEN 180 ELSE 720 END AS base FROM sources),
    d AS (SELECT *, CASE WHEN ats = 'jsonld' AND base > 0 THEN greatest(base, 360) ELSE base END AS cadence_minutes FROM c) SELECT source_id, cadence_minutes FROM d WHERE active AND (last_run_at IS NULL OR date_diff('second', last_run_at, {NOW}) // 60 >= cadence_minutes)""")
register("l10_attributed", lambda spark, sf_dir: ingest.attributed(standin.postings(spark, sf_dir, skills=False), standin.sources(spark, sf_dir)).groupBy("company").agg(F.count(F.lit(1)).alias("n")),
         "SELECT source_company AS company, count(*) AS n FROM postings JOIN sources USING (source_id) GROUP BY 1")
register("l18_finalize_run", lambda spark, sf_dir: ingest.finalize_run(standin.sources(spark, sf_dir), standin.postings(spark, sf_dir, skills=False), "2001-07-25 00:00:00"), """SELECT (SELECT count(*) FROM sources WHERE last_run_at >= TIMESTAMP '2001-07-25' AND last_status = 'ok') AS sources_ok,
    (SELECT count(*) FROM sources WHERE last_run_at >= TIMESTAMP '2001-07-25' AND last_status <> 'ok') AS sources_failed, (SELECT count(*) FROM postings WHERE first_seen >= TIMESTAMP '2001-07-25') AS new, (SELECT count(*) FROM postings WHERE closed_at >= TIMESTAMP '2001-07-25') AS closed""")
register("l21_close_kinds", lambda spark, sf_dir: ingest.close_kinds(standin.postings(spark, sf_dir, skills=False), standin.sources(spark, sf_dir), AS_OF).select("id", "closed_at"),
         f"SELECT id, CASE WHEN closed_at IS NULL AND kind IN ('aggregator', 'test') THEN {NOW} ELSE closed_at END AS closed_at FROM postings JOIN sources USING (source_id)")
# CRC-32 of a text in DuckDB: the table of the polynomial, then one step a character
CRC_TABLE = """crc AS (WITH RECURSIVE t AS (SELECT i, CAST(i AS UBIGINT) AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::UBIGINT) ELSE v // 2 END, k + 1 FROM t WHERE k < 8) SELECT list(v ORDER BY i) AS l FROM t WHERE k = 8)"""


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, where the table ``crc`` is among the sources."""
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda h, c: xor(h // 256, l[CAST(xor(h % 256, c) AS BIGINT) + 1])), 4294967295::UBIGINT)"


register("s14_skip_known", lambda spark, sf_dir: ingest.skip_known(standin.postings(spark, sf_dir, skills=False).select("id", "url"), state(spark, sf_dir), 7).select("id", "fetch"),
         f", {CRC_TABLE} SELECT id, id % 3 = 2 OR ({crc_sql('url')} + 7) % 20 = 0 AS fetch FROM postings, crc")


def _open(spark: SparkSession, sf_dir: str, skills: bool = False) -> DataFrame:
    """Open postings with repeats: boards and addresses are made to coincide, each eighth posting has a twin and another eighth a copy in Dutch."""
    base = standin.postings(spark, sf_dir, skills).where("closed_at is null").withColumns({"base": F.col("id"), "tail": F.lit(""), "lang": F.expr("case id % 4 when 1 then '/nl' when 2 then '/en' else '' end")})
    copies = base.where("base % 4 = 0").withColumns({"id": F.col("base") + 12_000_000, "tail": F.expr("if(base % 8 = 0, '-2', '')"), "lang": F.expr("if(base % 8 = 4, '/nl', lang)")})
    address = F.expr("concat('https://jobs.example', lang, '/job-', base div 3, 'a', tail, if(base % 5 = 0, '?utm=1', ''))")
    text = F.concat(F.lit("We look for an engineer who likes long walks, short meetings and clear words, in "), F.coalesce("city", F.lit("town")), F.lit(" or elsewhere."))
    own = {"source_id": F.expr("cast(base % 3 as int)"), "url": address, "description": text, "content_hash": F.expr("concat('h', base div 9)")}
    return base.unionByName(copies).withColumns(own).drop("base", "tail", "lang")


_OPEN_SQL = """, kinds AS (SELECT source_id, ats, kind FROM sources),
    b AS (SELECT id, id AS base, '' AS tail, CASE id % 4 WHEN 1 THEN '/nl' WHEN 2 THEN '/en' ELSE '' END AS lang, company, title, city, first_seen FROM postings WHERE closed_at IS NULL),
    every AS (SELECT * FROM b UNION ALL SELECT id + 12000000, base, CASE WHEN base % 8 = 0 THEN '-2' ELSE '' END, CASE WHEN base % 8 = 4 THEN '/nl' ELSE lang END, company, title, city, first_seen FROM b WHERE base % 4 = 0),
    o AS (SELECT id, company, title, city, first_seen, CAST(base % 3 AS INTEGER) AS source_id, 'https://jobs.example' || lang || '/job-' || (base // 3) || 'a' || tail || CASE WHEN base % 5 = 0 THEN '?utm=1' ELSE '' END AS url, 'h' || (base // 9) AS content_hash, lang, 'jobs.example/job-' || (base // 3) || 'a' || tail AS lang_stem FROM every),
    p AS (SELECT o.*, lower(company) || '|' || title || '|' || lower(coalesce(city, '')) AS key, regexp_replace(url, '[?#].*$', '') AS stem, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[-_ ]?\\(?[0-9]{1,3}\\)?$', '') AS twin,
        CASE lang WHEN '/nl' THEN 2 WHEN '/en' THEN 0 ELSE 1 END AS lang_rank, CASE coalesce(kind, 'employer') WHEN 'agency' THEN 1 WHEN 'aggregator' THEN 2 ELSE 0 END AS k, CASE ats WHEN 'greenhouse' THEN 0 WHEN 'lever' THEN 0 WHEN 'jsonld' THEN 5 ELSE 3 END AS a FROM o JOIN kinds USING (source_id))"""


def _pairs(keys: str, order: str, condition: str = "true", where: str = "true") -> str:
    return f"{_OPEN_SQL}, w AS (SELECT id AS dup, source_id, first_value(id) OVER g AS canon, first_value(source_id) OVER g AS canon_source FROM p WHERE {where} WINDOW g AS (PARTITION BY {keys} ORDER BY {order})) SELECT dup, canon FROM w WHERE dup <> canon AND {condition}"


_ORDER = "k, a, first_seen, id"


def _prepared(spark: SparkSession, sf_dir: str, skills: bool = False) -> DataFrame:
    return duplicates.prepared(_open(spark, sf_dir, skills), standin.sources(spark, sf_dir))


register("d1_cross_source", lambda spark, sf_dir: duplicates.cross_source(_prepared(spark, sf_dir)), _pairs("key", _ORDER, "source_id <> canon_source"))
register("d2_twins", lambda spark, sf_dir: duplicates.twins(_prepared(spark, sf_dir)), _pairs("source_id, key, content_hash, twin", _ORDER))
register("d3_same_address", lambda spark, sf_dir: duplicates.same_address(_prepared(spark, sf_dir)), _pairs("stem", _ORDER))
register("d6_other_language", lambda spark, sf_dir: duplicates.other_language(_prepared(spark, sf_dir)), _pairs("source_id, lang_stem", "lang_rank, first_seen, id", "true", "(source_id, lang_stem) IN (SELECT (source_id, lang_stem) FROM p WHERE lang_rank <> 1)"))
register("d4_bilingual", lambda spark, sf_dir: duplicates.bilingual(_prepared(spark, sf_dir)))
register("d5_per_city", lambda spark, sf_dir: duplicates.per_city(_prepared(spark, sf_dir)))
register("d7_same_board", lambda spark, sf_dir: duplicates.same_board(_prepared(spark, sf_dir, True)))
register("d8_marked_duplicates", lambda spark, sf_dir: duplicates.mark_duplicates(_open(spark, sf_dir, True), standin.sources(spark, sf_dir)))


def _fragments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("customer", "retail"), ("=customer 000000011", "finance"), ("customer 000000012", "health")], "fragment string, sector string")


register("j5_listed_sectors", lambda spark, sf_dir: matching.listed_sectors(standin.postings(spark, sf_dir, skills=False), _fragments(spark)),
         "SELECT DISTINCT company, CASE company WHEN 'Customer#000000011' THEN 'finance' WHEN 'Customer#000000012' THEN 'health' ELSE 'retail' END AS sector FROM postings")
register("x40_sectors", lambda spark, sf_dir: matching.sectors(_open(spark, sf_dir), standin.sources(spark, sf_dir), spark.createDataFrame([("Customer#000000013", "energy")], "company string, sector string"),
                                                              spark.createDataFrame([("customer 000000014", "health")], "fragment string, sector string"), {"leisure": "walks|meetings|elsewhere", "it": "engineer|words"}),
         """, f AS (SELECT company, min(id) % 3 = 1 AS agency FROM postings WHERE closed_at IS NULL AND duplicate_of IS NULL AND is_tech GROUP BY company)
    SELECT company, CASE company WHEN 'Customer#000000013' THEN 'energy' WHEN 'Customer#000000014' THEN 'health' ELSE CASE WHEN agency THEN 'staffing' ELSE 'leisure' END END AS sector,
           CASE company WHEN 'Customer#000000013' THEN 'curated' WHEN 'Customer#000000014' THEN 'list' ELSE CASE WHEN agency THEN 'source' ELSE 'text' END END AS found_by FROM f""")  # fmt: skip


def _tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([("Eleven", ["customer000000011"]), ("Third", ["=nation3"]), ("Nobody", ["nobody at all"]), ("Seventh", ["nation7 "])], "name string, match array<string>")
    return matching.tracker(entries, standin.postings(spark, sf_dir, skills=False), standin.sources(spark, sf_dir))


_LIVE = """, live AS (SELECT company, count(*) AS n FROM postings WHERE closed_at IS NULL AND duplicate_of IS NULL GROUP BY company),
    t AS (SELECT 'Eleven' AS name, CASE WHEN count(*) > 0 THEN 'covered' ELSE 'missing' END AS status, CAST(coalesce(sum(n), 0) AS BIGINT) AS live_postings FROM live WHERE company = 'Customer#000000011'
    UNION ALL SELECT 'Third', 'registered', CAST(coalesce(max(last_nl_count), 0) AS BIGINT) FROM sources WHERE slug = 'nation_3' UNION ALL SELECT 'Seventh', 'registered', CAST(coalesce(max(last_nl_count), 0) AS BIGINT) FROM sources WHERE slug = 'nation_7' UNION ALL SELECT 'Nobody', 'missing', 0)"""
register("j6_tracker", lambda spark, sf_dir: _tracked(spark, sf_dir).select("name", "status", "live_postings"), _LIVE + " SELECT name, status, live_postings FROM t")
register("a12_tracker_summary", lambda spark, sf_dir: matching.tracker_summary(_tracked(spark, sf_dir)), _LIVE + " SELECT status, count(*) AS entries, CAST(sum(live_postings) AS BIGINT) AS live_postings FROM t GROUP BY status")


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standin.postings(spark, sf_dir, skills=False)
    return rows.where("id % 20 = 0").select("id", F.when(F.col("id") % 40 == 0, F.col("title")).otherwise("1-URGENT engineers BUILDING").alias("title"), F.when(F.col("id") % 60 == 0, "Unknown B.V.").otherwise(F.col("company")).alias("company"), (F.col("id") % 3 == 0).alias("tech"), (F.col("id") % 100 == 0).alias("agency"))


register("j7_match_sample", lambda spark, sf_dir: matching.match_sample(_sample(spark, sf_dir), standin.postings(spark, sf_dir, skills=False)))
register("a21_recall_report", lambda spark, sf_dir: matching.recall_report(matching.match_sample(_sample(spark, sf_dir), standin.postings(spark, sf_dir, skills=False))))
register("a21_missing_employers", lambda spark, sf_dir: matching.missing_employers(matching.match_sample(_sample(spark, sf_dir), standin.postings(spark, sf_dir, skills=False))), """
    , a AS (SELECT id, CASE WHEN id % 60 = 0 THEN 'Unknown B.V.' ELSE company END AS company FROM postings WHERE id % 20 = 0 AND id % 3 = 0 AND id % 100 <> 0)
    SELECT company, count(*) AS postings FROM a WHERE company NOT IN (SELECT company FROM postings WHERE closed_at IS NULL AND duplicate_of IS NULL) GROUP BY company ORDER BY postings DESC, company LIMIT 40""")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a reader: daily or weekly, with conditions by key."""
    key = "c_custkey"
    customer = standin.table(spark, sf_dir, "customer").join(standin.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sent = F.expr(f"CASE {key} % 4 WHEN 0 THEN timestamp_ntz'{AS_OF}' - interval 19 hours WHEN 1 THEN timestamp_ntz'{AS_OF}' - interval 3 days WHEN 2 THEN timestamp_ntz'{AS_OF}' - interval 30 days END")
    users = customer.select(F.col(key).alias("user_id"), F.expr(f"CASE {key} % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'daily' ELSE 'weekly' END").alias("alerts"), sent.alias("alerts_sent_at"))
    lists = {
        "roles": f"IF({key} % 2 = 0, array(upper(c_mktsegment), ' '), null)",
        "cities": f"IF({key} % 3 = 0, array(n_name, 'remote'), null)",
        "remote": f"CASE {key} % 7 WHEN 0 THEN array('remote', 'hybrid', 'onsite') WHEN 1 THEN array('hybrid') END",
        "degrees": f"IF({key} % 11 = 0, array('phd', 'master'), null)",
        "exclude": f"IF({key} % 13 = 0, array(concat('Customer#', lpad({key} - 1, 9, '0'))), null)",
        "skills": f"IF({key} % 2 = 1, array('Brand#11', 'Brand#23'), null)",
    }
    none = {c: "null" for c in alerts.CONDITIONS if c not in lists}
    flags = {"language": f"CASE {key} % 9 WHEN 0 THEN 'nl' WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END", "visa": f"{key} % 8 = 0", "agencies": f"{key} % 6 = 0", "noenrol": f"{key} % 10 = 3"}
    profiles = customer.where(f"{key} % 17 <> 1").select(F.col(key).alias("user_id"), *(F.expr(e).cast("array<string>").alias(c) for c, e in (lists | none).items()), *(F.expr(e).alias(c) for c, e in flags.items()))
    return alerts.alert_rows(users, with_positions(rows(spark, sf_dir)), profiles, AS_OF)


register("m3_alerts", _alerts, f""", u AS (SELECT c_custkey AS k, c_mktsegment, n_name, c_custkey % 17 <> 1 AS known, CASE c_custkey % 5 WHEN 0 THEN 'off' WHEN 1 THEN 'daily' ELSE 'weekly' END AS alerts,
        CASE c_custkey % 4 WHEN 0 THEN {NOW} - INTERVAL 19 HOUR WHEN 1 THEN {NOW} - INTERVAL 3 DAY WHEN 2 THEN {NOW} - INTERVAL 30 DAY END AS sent FROM customer JOIN nation ON c_nationkey = n_nationkey),
    due AS (SELECT *, greatest(coalesce(sent, TIMESTAMP '1900-01-01'), {NOW} - CASE alerts WHEN 'daily' THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END) AS since FROM u
        WHERE alerts <> 'off' AND (sent IS NULL OR sent <= {NOW} - CASE alerts WHEN 'daily' THEN INTERVAL 20 HOUR ELSE INTERVAL 164 HOUR END)),
    met AS (SELECT k, id, effective_at, CASE WHEN NOT known OR k % 2 = 0 OR len(skills) = 0 THEN 0.0 ELSE len(list_intersect(skills, ['Brand#11', 'Brand#23'])) / greatest(len(skills), 3) END AS score
        FROM due JOIN rows ON first_seen > since AND closed_at IS NULL AND (NOT known OR (
            (k % 2 <> 0 OR role_family = lower(c_mktsegment))
            AND (k % 3 <> 0 OR coalesce(lower(city) = lower(n_name), false) OR remote OR coalesce(list_contains(also_in, n_name), false))
            AND (k % 7 <> 1 OR remote_policy = 'hybrid') AND (k % 11 <> 0 OR degree IN ('phd', 'master'))
            AND (k % 13 <> 0 OR lower(company) <> 'customer#' || lpad(CAST(k - 1 AS VARCHAR), 9, '0'))
            AND (k % 9 <> 0 OR (coalesce(dutch_required, false) OR coalesce(posting_language = 'nl', false)) AND english_required IS NOT DISTINCT FROM false) AND (k % 9 <> 1 OR english_only IS NOT DISTINCT FROM true)
            AND (k % 8 <> 0 OR visa_sponsorship IS NOT DISTINCT FROM true) AND (k % 6 <> 0 OR kind <> 'agency') AND (k % 10 <> 3 OR enrollment_required IS DISTINCT FROM true))))
    SELECT k AS user_id, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, effective_at DESC, id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY k) AS total, id FROM met QUALIFY rank <= 15""")  # fmt: skip
