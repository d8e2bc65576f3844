"""Maintenance of stored postings, boards, candidates and accounts: every verb gives the new table, nothing is updated in place.

Nulls never match a condition, so a row with a null date or name stays as it is; empty tables give empty tables. Lookups
join on keys; lists that are kept by hand are read to the driver behind a stated bound.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import normalize
from tidemark.functions.normalize import folded

KINDS = ("board", "aggregator", "agency", "test")  # in order of trial
MAX_KINDS = 10_000  # rows of the hand-kept list of boards' kinds
MAX_KEY = 300
FAILED = ("error", "exception")
# Slugs of vendors' demonstration boards.
TEST_SLUG = r"^(acmecorp|acme-?corp|demo|sandbox|example|sample|dummy|playground)([-_]?\w*)?$|^(test|testing)([-_]\w*)?$|[-_](demo|sandbox|test|testing)$"


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def reclassified(postings: DataFrame, is_tech: Column) -> DataFrame:
    """``postings`` with ``is_tech`` computed anew and ``flipped``, whether that changed the class."""
    new = F.coalesce(is_tech, F.lit(False))
    return postings.withColumns({"flipped": new != F.coalesce("is_tech", F.lit(False)), "is_tech": new})


def with_filled_cities(postings: DataFrame) -> DataFrame:
    """Open postings at a place without a known city get one from the board's own place name, or, where that says nothing, from title and text.

    Needs title, description, location_raw, city, remote and closed_at; adds ``city_from``: place, text or null.
    """
    open_here = F.col("city").isNull() & F.col("closed_at").isNull() & ~F.coalesce("remote", F.lit(False)) & normalize.detect_city(F.coalesce("location_raw", F.lit(""))).isNull()
    place = F.when(open_here, normalize.plausible_place(F.col("location_raw")))
    text = F.when(open_here & normalize.is_generic_location(F.col("location_raw")), normalize.city_from_text(F.col("title"), F.coalesce("description", F.lit(""))))
    return postings.withColumns({"city_from": F.when(place.isNotNull(), "place").when(text.isNotNull(), "text"), "city": F.coalesce("city", place, text)})


def scrubbed(postings: DataFrame) -> DataFrame:
    """E-mail addresses and telephone numbers leave the descriptions; hashes follow, and an extraction that was current stays so."""
    clean = normalize.scrub_contact(F.coalesce("description", F.lit("")))
    changed = ~clean.eqNullSafe(F.col("description"))
    hash_ = normalize.content_hash(F.col("title"), clean)
    return postings.withColumns(
        {
            "description": F.when(changed, clean).otherwise(F.col("description")),
            "extracted_hash": F.when(changed & (F.col("extracted_hash") == F.col("content_hash")), hash_).otherwise(F.col("extracted_hash")),
            "content_hash": F.when(changed, hash_).otherwise(F.col("content_hash")),
            "scrubbed": changed,
        }
    )


def renamed(sources: DataFrame, postings: DataFrame, pretty: DataFrame, curated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boards and postings after a renaming: employers' boards take their slug's name (slug, name), curated names (raw, name) come last."""
    names = pretty.select(F.col("slug").alias("_slug"), F.col("name").alias("_pretty"))
    boards = sources.join(names, F.col("slug") == F.col("_slug"), "left")
    takes = (F.col("kind") == "employer") & F.col("_pretty").isNotNull() & (F.col("_pretty") != F.col("company"))
    boards = boards.withColumn("_new", F.when(takes, F.col("_pretty")))
    rows = postings.join(boards.where("_new is not null").select("source_id", F.col("_new").alias("_name")), "source_id", "left").withColumn("company", F.coalesce("_name", "company")).drop("_name")
    boards = boards.withColumn("company", F.coalesce("_new", "company")).drop("_slug", "_pretty", "_new")
    return normalize.with_display_names(boards, curated), normalize.with_display_names(rows, curated)


def account_cleanup(users: DataFrame, sessions: DataFrame, tokens: DataFrame, user_data: DataFrame, feedback: DataFrame, as_of: str, inactive_days: int = 730, feedback_days: int = 365) -> dict[str, DataFrame]:
    """What stays of each table: live sessions, login tokens of two days, accounts used within ``inactive_days`` with what belongs to them, feedback of a year."""
    before = lambda column, days: F.coalesce(F.col(column) < _now(as_of) - F.expr(f"interval {days} days"), F.lit(False))
    stale = users.where(F.coalesce(F.coalesce("last_login_at", "created_at") < _now(as_of) - F.expr(f"interval {inactive_days} days"), F.lit(False))).select("user_id")
    return {
        "users": users.join(stale, "user_id", "left_anti"),
        "sessions": sessions.where(~before("expires_at", 0)).join(stale, "user_id", "left_anti"),
        "tokens": tokens.where(~before("created_at", 2)),
        "user_data": user_data.join(stale, "user_id", "left_anti"),
        "feedback": feedback.where(~before("created_at", feedback_days)),
    }


def without_account(users: DataFrame, sessions: DataFrame, tokens: DataFrame, user_data: DataFrame, user_id: int) -> dict[str, DataFrame]:
    """The tables after one account has been deleted with everything attached to it; tokens go by the account's e-mail address."""
    mail = users.where(F.col("user_id") == user_id).select("email")
    other = F.coalesce(F.col("user_id") != user_id, F.lit(True))
    return {"users": users.where(other), "sessions": sessions.where(other), "user_data": user_data.where(other), "tokens": tokens.join(mail, "email", "left_anti")}


def account_export(users: DataFrame, user_data: DataFrame) -> DataFrame:
    """user_id, document: everything stored about an account, as JSON."""
    rows = users.join(user_data.select("user_id", "profile", "saved"), "user_id", "left")
    body = F.struct("email", F.col("created_at"), F.col("last_login_at"), F.coalesce("profile", F.lit("{}")).alias("profile"), F.coalesce("saved", F.array().cast("array<bigint>")).alias("saved_job_ids"), F.coalesce("alerts", F.lit("off")).alias("job_alerts"))
    return rows.select("user_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def source_kind(company: Column, slug: Column, kinds: list[tuple[str, str]]) -> Column:
    """'board', 'aggregator', 'agency', 'test' or 'employer': by whole names first, then as a demonstration board, then by parts of six letters and more."""
    name, key = F.lower(company), F.lower(slug)
    whole = {k: [n.lower() for kind, n in kinds if kind == k] for k in KINDS}
    exact = [F.when(key.isin(n) | name.isin(n), k) for k, n in whole.items() if n]
    trial = F.when(slug.rlike(folded(TEST_SLUG)) | F.replace(company, F.lit(" "), F.lit("")).rlike(folded(TEST_SLUG)), "test")
    parts = [F.when(key.rlike(rx) | name.rlike(rx), k) for k, n in whole.items() if (rx := "|".join(re.escape(x) for x in n if len(x) >= 6))]
    return F.coalesce(*exact, trial, *parts, F.lit("employer"))


def kept_kinds(table: DataFrame) -> list[tuple[str, str]]:
    """The hand-kept list (kind, needle), which may have MAX_KINDS rows."""
    rows = table.select("kind", "needle").limit(MAX_KINDS + 1).collect()
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of boards")
    return [tuple(r) for r in rows]


def classified(sources: DataFrame, kinds: DataFrame) -> DataFrame:
    """Boards with their ``kind`` anew; aggregators and test boards are off."""
    rows = sources.withColumn("kind", source_kind(F.col("company"), F.col("slug"), kept_kinds(kinds)))
    off = F.col("kind").isin("aggregator", "test") & F.col("active")
    return rows.withColumns({"last_status": F.when(off, F.col("kind")).otherwise(F.col("last_status")), "active": F.col("active") & ~off})


def upserted_sources(sources: DataFrame, found: DataFrame, kinds: DataFrame) -> DataFrame:
    """Boards with those of ``found`` (company, ats, slug, url) that are not known yet, classified; a known board without a URL takes the found one.

    Of repeats of (ats, slug) in ``found`` the first by company stays. ``is_new`` says which rows are new.
    """
    one = found.groupBy("ats", "slug").agg(F.min(F.struct("company", "url")).alias("f")).select("ats", "slug", F.col("f.company").alias("_company"), F.col("f.url").alias("_url"))
    both = sources.withColumn("_known", F.lit(True)).join(one, ["ats", "slug"], "full_outer")
    new = F.col("_known").isNull()
    kind = source_kind(F.col("_company"), F.col("slug"), kept_kinds(kinds))
    off = kind.isin("aggregator", "test")
    own = {
        "company": F.coalesce("company", "_company"),
        "url": F.coalesce("url", "_url"),
        "kind": F.when(new, kind).otherwise(F.col("kind")),
        "active": F.when(new, ~off).otherwise(F.col("active")),
        "last_status": F.when(new, F.when(off, kind)).otherwise(F.col("last_status")),
        "is_new": new,
    }
    return both.select(*(own[c].alias(c) if c in own else F.col(c) for c in [*sources.columns, "is_new"]))


def candidate_status(entries: DataFrame) -> DataFrame:
    """kind, key, status of employers looked at: with a board, a domain but no board, or neither."""
    board = (F.size(F.coalesce("ats", F.array().cast("array<string>"))) > 0) | F.coalesce("jsonld", F.lit(False)) | F.col("sitemap").isNotNull()
    status = F.when(board, "board").when(F.coalesce(F.length("domain"), F.lit(0)) > 0, "no_board").otherwise("no_domain")
    return entries.select(F.lit("sponsor").alias("kind"), F.col("key"), status.alias("status"), F.lit(0).cast("long").alias("nl"))


def imported_candidates(candidates: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Candidates with earlier results (kind, key, status, nl): known keys, failed checks and keys of over MAX_KEY characters stay out."""
    usable = results.where(~F.coalesce(F.col("status"), F.lit("")).isin(*FAILED) & (F.length("key") <= MAX_KEY)).join(candidates.select("kind", "key"), ["kind", "key"], "left_anti")
    rows = usable.groupBy("kind", "key").agg(F.min(F.struct(F.coalesce("status", F.lit("error")).alias("status"), F.coalesce("nl", F.lit(0)).cast("long").alias("nl"))).alias("r"))
    return candidates.unionByName(rows.select("kind", "key", "r.status", "r.nl", _now(as_of).alias("checked_at")))


def probe_results(fetched: DataFrame, postings: DataFrame) -> DataFrame:
    """slug, status, total, nl of boards that were fetched (slug, status), by their postings (slug, location, country)."""
    home = normalize.detect_country(F.col("location"), F.col("country")).eqNullSafe("NL")
    counted = postings.groupBy("slug").agg(F.count(F.lit(1)).alias("total"), F.count_if(home).alias("nl"))
    ok = F.col("status") == "ok"
    return fetched.join(counted, "slug", "left").select("slug", "status", F.when(ok, F.coalesce("total", F.lit(0))).alias("total"), F.when(ok, F.coalesce("nl", F.lit(0))).otherwise(0).alias("nl"))


def to_probe(slugs: DataFrame, state: DataFrame) -> DataFrame:
    """The slugs that no probe has answered for good."""
    return slugs.select("slug").distinct().join(state.where(~F.col("status").isin(*FAILED)).select("slug"), "slug", "left_anti")


def boards_to_register(probes: DataFrame, sources: DataFrame, ats: str, min_nl: int = 1) -> DataFrame:
    """ats, slug of live boards with postings at home that are no sources yet."""
    found = probes.where((F.col("status") == "ok") & (F.col("nl") >= min_nl)).select(F.lit(ats).alias("ats"), "slug").distinct()
    return found.join(sources.select("ats", "slug"), ["ats", "slug"], "left_anti")


def employers_to_register(entries: DataFrame, adapters: list[str]) -> DataFrame:
    """The boards that looked-at employers bring: company, ats, slug, url, discovered_by, active.

    ``entries``: company, candidates (array of ats, slug, works), careers_url, jsonld, sitemap (sitemap, sample), guessed.
    The first candidate that works wins, and those of platforms without an adapter before it are noted as inactive;
    without one the careers page's structured data counts, then a sitemap.
    """
    with_adapter = lambda c: c["ats"].isin(adapters)
    wins = lambda c: (with_adapter(c) & F.coalesce(c["works"], F.lit(False))) | (c["ats"] == "homerun")
    listed = F.coalesce("candidates", F.array().cast(entries.schema["candidates"].dataType))
    first = F.array_position(F.transform(listed, wins), True)
    board = lambda ats, slug, url, how, active: F.struct(F.col("company"), ats.alias("ats"), slug.alias("slug"), url.alias("url"), how.alias("discovered_by"), active.alias("active"))
    homerun = lambda c: F.concat(F.lit("https://"), c["slug"], F.lit(".homerun.co/sitemap.xml"))
    careers, how = F.col("careers_url"), F.when(F.coalesce("guessed", F.lit(False)), "discovery-guess").otherwise("discovery")
    tried = F.when(first > 0, F.slice(listed, F.lit(1), (first - 1).cast("int"))).otherwise(listed)
    unknown = F.transform(F.filter(tried, lambda c: ~with_adapter(c)), lambda c: board(c["ats"], c["slug"], careers, F.lit("discovery"), F.lit(False)))
    won = F.transform(F.slice(listed, F.greatest(first.cast("int"), F.lit(1)), F.when(first > 0, 1).otherwise(0)), lambda c: board(F.when(c["ats"] == "homerun", "jsonld").otherwise(c["ats"]), F.when(c["ats"] == "homerun", homerun(c)).otherwise(c["slug"]), careers, F.when(c["ats"] == "homerun", "discovery").otherwise(how), F.lit(True)))
    page = F.when((first == 0) & F.coalesce("jsonld", F.lit(False)) & careers.isNotNull(), board(F.lit("jsonld"), careers, careers, F.lit("discovery"), F.lit(True)))
    listing = F.when((first == 0) & page.isNull() & F.col("sitemap").isNotNull(), board(F.lit("jsonld"), F.col("sitemap.sitemap"), F.col("sitemap.sample"), F.lit("ind-register"), F.lit(True)))
    return entries.select(F.explode(F.concat(unknown, won, F.array_compact(F.array(page, listing)))).alias("b")).select("b.*")


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` runs, the newest first."""
    return runs.orderBy(F.desc("run_id")).limit(n)


def with_sizes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with ``employees`` by the employer's normalised name, from a list (company, employees); of spellings that fall together the last in order counts."""
    key = lambda c: F.lower(normalize.norm_company(F.coalesce(c, F.lit(""))))
    listed = sizes.groupBy(key(F.col("company")).alias("_key")).agg(F.max_by("employees", "company").alias("employees"))
    return rows.drop("employees").withColumn("_key", key(F.col("company"))).join(listed, "_key", "left").drop("_key")


def with_overrides(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """Labels (item_id, role_family, seniority, skills_required, skills_nice) with corrections: fields replaced, skills taken away and added.

    A skill that is required is not added as nice to have; what is there already is not added again.
    """
    empty = F.array().cast("array<string>")
    rows = labels.join(overrides.select("item_id", *(F.col(c).alias(f"_{c}") for c in ("role_family", "seniority", "remove", "add", "add_nice"))), "item_id", "left")
    less = lambda c: F.array_except(F.coalesce(c, empty), F.coalesce("_remove", empty))
    more = lambda have, new: F.concat(have, F.array_except(F.coalesce(new, empty), have))
    required = more(less("skills_required"), "_add")
    nice = more(less("skills_nice"), F.array_except(F.coalesce("_add_nice", empty), required))
    return rows.select("item_id", F.coalesce("_role_family", "role_family").alias("role_family"), F.coalesce("_seniority", "seniority").alias("seniority"), required.alias("skills_required"), nice.alias("skills_nice"))
