"""Merging a crawl's snapshot into the stored postings, and the lifecycle of postings and boards.

State and snapshot are DataFrames; nothing is updated in place. The merge is one outer join on
(source_id, external_id), with a second one on the URL for rows that no key matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Columns that a changed text brings along.
CONTENT = ["title", "company", "city", "country", "remote", "url", "description", "posted_at", "valid_through", "content_hash", "dedup_key"]
CADENCE_MINUTES = {"busy": 60, "some": 180, "none": 720, "never": 0, "pages": 360}


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def unique_ids(snapshot: DataFrame) -> DataFrame:
    """An id that several URLs share is replaced by the URL; of repeats the last by URL stays."""
    shared = snapshot.groupBy("source_id", "external_id").agg(F.min("url").alias("_low"), F.max("url").alias("_high")).where("_low <> _high").select("source_id", "external_id", F.lit(True).alias("_shared"))
    rows = snapshot.join(shared, ["source_id", "external_id"], "left").withColumn("external_id", F.when(F.col("_shared"), F.col("url")).otherwise(F.col("external_id"))).drop("_shared")
    last = F.max_by(F.struct(*snapshot.columns), F.struct("url", "content_hash"))
    return rows.groupBy("source_id", "external_id").agg(last.alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in snapshot.columns))


def trusted_expiry(snapshot: DataFrame, as_of: str, least: int = 5, most: float = 0.8) -> DataFrame:
    """source_id, trusted: a board of whose dated rows over 80 % lie in the past is not believed."""
    dated, past = F.count("valid_through"), F.count_if(F.col("valid_through") < _now(as_of))
    return snapshot.groupBy("source_id").agg((~((dated >= least) & (past / F.greatest(dated, F.lit(1)) > most))).alias("trusted"))


def split_snapshot(snapshot: DataFrame, as_of: str, allowed: tuple[str, ...] = ("NL",)) -> DataFrame:
    """The snapshot with ``fate``: 'foreign' and 'expired' rows are not stored, the rest is 'seen'. ALL allows every known country."""
    country = F.col("country")
    foreign = country.isNull() | (country == "XX") if "ALL" in allowed else ~F.coalesce(country.isin(list(allowed)), F.lit(False))
    rows = snapshot.join(trusted_expiry(snapshot, as_of), "source_id")
    expired = F.col("trusted") & F.coalesce(F.col("valid_through") < _now(as_of), F.lit(False))
    return rows.withColumn("fate", F.when(foreign, "foreign").when(expired, "expired").otherwise("seen")).drop("trusted")


def partial_sources(seen: DataFrame, sources: DataFrame) -> DataFrame:
    """source_id, partial: boards that listed less than half of what they did before (of ten or more)."""
    counted = seen.groupBy("source_id").agg(F.count(F.lit(1)).alias("seen"))
    return sources.join(counted, "source_id").select("source_id", ((F.coalesce("last_nl_count", F.lit(0)) >= 10) & (F.col("seen") < 0.5 * F.col("last_nl_count"))).alias("partial"))


def merge(state: DataFrame, snapshot: DataFrame, sources: DataFrame, as_of: str, allowed: tuple[str, ...] = ("NL",)) -> DataFrame:
    """The new state with ``change``: new, updated, reopened, touched, closed or kept.

    ``state``: source_id, external_id, first_seen, last_seen, closed_at and CONTENT. ``snapshot``: source_id,
    external_id and CONTENT, unique by id. Boards without a row in the snapshot are left alone.
    """
    seen = split_snapshot(snapshot, as_of, allowed).where("fate = 'seen'").drop("fate")
    new = seen.select("source_id", "external_id", *(F.col(c).alias(f"new_{c}") for c in CONTENT), F.lit(True).alias("found"))
    # rows that no id matches get a second chance by URL, and take over the id of the stored row
    known = state.select("source_id", "external_id", F.col("url").alias("old_url"))
    lost = known.join(new.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti").select("source_id", F.col("external_id").alias("old_id"), F.col("old_url").alias("new_url"))
    lost = lost.groupBy("source_id", "new_url").agg(F.min("old_id").alias("old_id"))
    fresh = new.join(known.select("source_id", "external_id"), ["source_id", "external_id"], "left_anti").join(lost, ["source_id", "new_url"])
    moved = fresh.select("source_id", F.col("external_id"), "old_id")
    new = new.join(moved, ["source_id", "external_id"], "left").withColumn("match_id", F.coalesce("old_id", "external_id"))
    crawled = snapshot.select("source_id").distinct().withColumn("crawled", F.lit(True))
    partial = partial_sources(seen, sources).select("source_id", "partial")
    old = state.withColumnRenamed("external_id", "match_id").withColumn("stored", F.lit(True))
    both = old.join(new, ["source_id", "match_id"], "full_outer").join(crawled, "source_id", "left").join(partial, "source_id", "left")
    stored, found = F.coalesce("stored", F.lit(False)), F.coalesce("found", F.lit(False))
    text_lost = (F.length(F.trim(F.coalesce("new_description", F.lit("")))) < 50) & (F.length(F.trim(F.coalesce("description", F.lit("")))) >= 50)
    changed = stored & found & ~F.col("content_hash").eqNullSafe(F.col("new_content_hash")) & ~text_lost
    taken = (found & ~stored) | changed
    closes = stored & ~found & F.coalesce("crawled", F.lit(False)) & ~F.coalesce("partial", F.lit(False)) & F.col("closed_at").isNull()
    change = F.when(found & ~stored, "new").when(changed, "updated").when(found & F.col("closed_at").isNotNull(), "reopened").when(found, "touched").when(closes, "closed").otherwise("kept")
    return both.select(
        "source_id",
        F.coalesce("external_id", "match_id").alias("external_id"),
        F.coalesce("first_seen", _now(as_of)).alias("first_seen"),
        F.when(found, _now(as_of)).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(found, F.lit(None).cast("timestamp_ntz")).when(closes, _now(as_of)).otherwise(F.col("closed_at")).alias("closed_at"),
        *(F.when(taken, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in CONTENT),
        change.alias("change"),
    )


def counters(merged: DataFrame, snapshot: DataFrame, sources: DataFrame, as_of: str, allowed: tuple[str, ...] = ("NL",)) -> DataFrame:
    """source_id, new, updated, closed, seen, foreign, expired, partial of one crawl."""
    changes = merged.groupBy("source_id").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("new", "updated", "closed")))
    fates = split_snapshot(snapshot, as_of, allowed)
    counted = fates.groupBy("source_id").agg(*(F.count_if(F.col("fate") == f).alias(f) for f in ("seen", "foreign", "expired")))
    partial = partial_sources(fates.where("fate = 'seen'"), sources).select("source_id", "partial")
    return counted.join(changes, "source_id").join(partial, "source_id", "left").withColumn("partial", F.coalesce("partial", F.lit(False)))


def touch_still_listed(state: DataFrame, stubs: DataFrame, as_of: str) -> DataFrame:
    """Rows that a board says are still listed get a new last_seen and are open again."""
    listed = stubs.select("source_id", "external_id").distinct().withColumn("listed", F.lit(True))
    rows = state.join(listed, ["source_id", "external_id"], "left")
    hit = F.coalesce("listed", F.lit(False))
    return rows.withColumns({"last_seen": F.when(hit, _now(as_of)).otherwise(F.col("last_seen")), "closed_at": F.when(hit, F.lit(None).cast("timestamp_ntz")).otherwise(F.col("closed_at"))}).drop("listed")


def skip_known(listing: DataFrame, known: DataFrame, salt: int, one_in: int = 20) -> DataFrame:
    """Listing rows with ``fetch``: unknown URLs, and one in twenty of the known ones, are fetched again."""
    seen = known.select("url").distinct().withColumn("known", F.lit(True))
    refresh = F.pmod(F.crc32(F.col("url").cast("binary")) + salt, F.lit(one_in)) == 0
    return listing.join(seen, "url", "left").withColumn("fetch", ~F.coalesce("known", F.lit(False)) | refresh).drop("known")


def attributed(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """A posting on a multi-employer board keeps its own company; all others get their board's."""
    rows = postings.join(sources.select("source_id", F.col("kind").alias("_kind"), F.col("source_company").alias("_company")), "source_id", "left")
    own = (F.col("_kind") == "board") & F.col("company").isNotNull()
    return rows.withColumn("company", F.when(own, F.col("company")).otherwise(F.coalesce("_company", "company"))).drop("_kind", "_company")


def source_after_run(sources: DataFrame, runs: DataFrame, as_of: str, give_up: int = 5) -> DataFrame:
    """Boards after their runs (source_id, result: ok, partial, error, not_found or exception, count, nl_count)."""
    rows = sources.join(runs, "source_id", "left")
    ran, ok = F.col("result").isNotNull(), F.coalesce(F.col("result").isin("ok", "partial"), F.lit(False))
    failures = F.when(~ran, F.col("consecutive_failures")).when(ok, 0).otherwise(F.coalesce("consecutive_failures", F.lit(0)) + 1)
    off = ran & (F.coalesce(F.col("result") == "not_found", F.lit(False)) | (failures >= give_up))
    return rows.withColumns(
        {
            "last_status": F.coalesce("result", "last_status"),
            "last_run_at": F.when(ran, _now(as_of)).otherwise(F.col("last_run_at")),
            "first_success_at": F.when(ok, F.coalesce("first_success_at", _now(as_of))).otherwise(F.col("first_success_at")),
            "last_nl_count": F.when(F.col("result") == "ok", F.col("nl_count")).otherwise(F.col("last_nl_count")),
            "consecutive_failures": failures,
            "active": F.col("active") & ~off,
        }
    ).drop("result", "count", "nl_count")


def cadence(sources: DataFrame) -> Column:
    n = F.col("last_nl_count")
    base = F.when(F.col("last_run_at").isNull() | n.isNull(), CADENCE_MINUTES["never"]).when(n >= 20, CADENCE_MINUTES["busy"]).when(n >= 1, CADENCE_MINUTES["some"]).otherwise(CADENCE_MINUTES["none"])
    return F.when((F.col("ats") == "jsonld") & (base > 0), F.greatest(base, F.lit(CADENCE_MINUTES["pages"]))).otherwise(base)


def due_sources(sources: DataFrame, as_of: str) -> DataFrame:
    """Active boards whose last run is at least their cadence ago."""
    waited = F.timestamp_diff("MINUTE", F.col("last_run_at"), _now(as_of))
    return sources.where(F.col("active") & (F.col("last_run_at").isNull() | (waited >= cadence(sources)))).select("source_id", cadence(sources).alias("cadence_minutes"))


def needs_extraction(postings: DataFrame, version: str) -> DataFrame:
    """Tech rows never extracted, or by another version, or before their text changed."""
    return postings.where(F.col("is_tech") & (F.col("extraction").isNull() | (F.col("extractor_version") != version) | (F.col("extracted_hash") != F.col("content_hash"))))


def finalize_run(sources: DataFrame, postings: DataFrame, started_at: str) -> DataFrame:
    """One row of run counters since ``started_at``."""
    since = _now(started_at)
    a = sources.agg(F.count_if((F.col("last_run_at") >= since) & (F.col("last_status") == "ok")).alias("sources_ok"), F.count_if((F.col("last_run_at") >= since) & (F.col("last_status") != "ok")).alias("sources_failed"))
    b = postings.agg(F.count_if(F.col("first_seen") >= since).alias("new"), F.count_if(F.col("closed_at") >= since).alias("closed"))
    return a.crossJoin(b)  # two single rows


def close_kinds(postings: DataFrame, sources: DataFrame, as_of: str, kinds: tuple[str, ...] = ("aggregator", "test")) -> DataFrame:
    """Open postings of boards that turned out not to be employers are closed."""
    bad = sources.where(F.col("kind").isin(list(kinds))).select("source_id", F.lit(True).alias("_bad"))
    hit = F.col("closed_at").isNull() & F.coalesce("_bad", F.lit(False))
    return postings.join(bad, "source_id", "left").withColumn("closed_at", F.when(hit, _now(as_of)).otherwise(F.col("closed_at"))).drop("_bad")


def new_candidates(candidates: DataFrame, seen: DataFrame, key_length: int = 300) -> DataFrame:
    """Boards to probe that were not probed before: key of usable length, not in ``seen`` whatever its result."""
    return candidates.where(F.length("key") <= key_length).join(seen.select("kind", "key"), ["kind", "key"], "left_anti").distinct()


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``changes`` over it: rows of equal keys are replaced, others added."""
    return table.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def probe_summary(probes: DataFrame) -> DataFrame:
    """One row: boards probed, alive, with postings at home, and those postings."""
    return probes.agg(F.count(F.lit(1)).alias("probed"), F.count_if(F.col("status") == "ok").alias("alive"), F.count_if(F.col("nl") > 0).alias("with_nl"), F.coalesce(F.sum("nl"), F.lit(0)).alias("nl"))


def rotation(boards: DataFrame, as_of: str, size: int = 3) -> DataFrame:
    """platform, turn: the platforms (``ats``) of boards whose turn it is: ``size`` of their names in order, from a start that moves with the ISO week.

    Null names are none; fewer platforms than ``size`` have their turn every week.
    """
    names = boards.where("ats is not null").groupBy("ats").agg(F.count(F.lit(1)).alias("boards"))
    place = F.row_number().over(Window.orderBy("ats")) - 1  # the platforms' names, some dozens at most
    n = F.count(F.lit(1)).over(Window.partitionBy())
    turn = F.pmod(F.col("place") - F.weekofyear(F.lit(as_of).cast("timestamp_ntz")) * size, F.col("n"))
    return names.withColumns({"place": place, "n": n}).withColumn("turn", turn.cast("int")).where(F.col("turn") < size).select(F.col("ats").alias("platform"), "turn", "boards")


def stalest(candidates: DataFrame, as_of: str, n: int) -> DataFrame:
    """Candidates worth another look, the longest unchecked first: empty for 90 days or failed for 7."""
    age = F.datediff(F.to_date(_now(as_of)), F.to_date("checked_at"))
    again = ((F.col("status") == "ok") & (F.col("nl") == 0) & (age > 90)) | ((F.col("status") != "ok") & (age > 7))
    return candidates.where(again).orderBy("checked_at", "key").limit(n)
