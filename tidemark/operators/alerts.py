"""Readers' alerts: which new postings each due reader is told of, for any number of readers.

A reader's profile is a set of conditions, each a set of tags of which a posting must have one ("role=data", "city=delft"). That makes
an index of profiles: every distinct profile waits under the tags of one of its conditions only, the one that the fewest new postings
fit. Postings, exploded to their tags, meet it by equality; whoever meets is then held against the whole profile. Neither profiles nor
postings are collected, and the plan has the same size for one reader or millions.

Profiles without any condition wait under a tag that every posting has. Readers with equal profiles and times share one, whatever
employers they exclude: those are taken off the profile's hits afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored

ANY = "any="
SLICES = 32  # over which the postings of one tag are dealt
# profile column -> what a posting is asked for
CONDITIONS = {"roles": "role", "levels": "seniority", "exp": "experience", "degrees": "degree", "emps": "employees", "sizes": "org_size", "remote": "remote", "cities": "city", "sectors": "sector", "positions": "position"}
PROFILE = (
    "user_id long, " + ", ".join(f"{c} array<string>" for c in CONDITIONS) + ", exclude array<string>, skills array<string>, language string, visa boolean, agencies boolean, noenrol boolean"
)


def due_alerts(users: DataFrame, as_of: str) -> DataFrame:
    """Users whose daily or weekly mail is due, and from when on postings are new to them."""
    now = F.lit(as_of).cast("timestamp_ntz")
    waited = F.timestamp_diff("HOUR", F.col("alerts_sent_at"), now)
    due = F.col("alerts").isin("daily", "weekly") & (F.col("alerts_sent_at").isNull() | (waited >= F.when(F.col("alerts") == "daily", 20).otherwise(6 * 24 + 20)))
    window = now - F.when(F.col("alerts") == "daily", F.expr("interval 1 day")).otherwise(F.expr("interval 7 days"))
    return users.where(due).withColumn("since", F.greatest(F.coalesce("alerts_sent_at", window), window))


def _values(column: str) -> Column:
    """A list as the filters read it: trimmed, lower-cased, without blanks."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & (v != ""))))


def _tagged(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{name}="), v))


def posting_tags(rows: DataFrame) -> DataFrame:
    """id, tags and the columns that ranking and exclusions read, of open rows."""
    c = F.col
    single = {"role": "role_family", "seniority": "seniority", "experience": "experience", "degree": "degree", "employees": "employee_band", "sector": "sector", "position": "position", "org_size": "org_size"}
    flag = lambda condition, tag: F.when(condition, F.lit(tag))
    cities = F.concat(F.array(F.lower("city")), F.transform(F.coalesce("also_in", F.array().cast("array<string>")), F.lower))
    tags = F.concat(
        F.array(F.lit(ANY)),
        F.array(*(F.concat(F.lit(f"{name}="), c(column)) for name, column in single.items())),
        _tagged("city", F.array_compact(cities)),
        F.array(
            flag(c("remote"), "city=remote"),
            F.concat(F.lit("remote="), c("remote_policy")),
            flag(c("remote") & (c("remote_policy").isNull() | c("remote_policy").isin("unknown", "remote")), "remote=remote"),
            flag(c("english_only").eqNullSafe(True), "language=en"),
            flag((c("dutch_required") | (c("posting_language") == "nl")) & c("english_required").eqNullSafe(False), "language=nl"),
            flag(c("visa_sponsorship").eqNullSafe(True), "visa=true"),
        ),
    )
    open_rows = rows.where("closed_at is null")
    return open_rows.select("id", F.array_distinct(F.array_compact(tags)).alias("tags"), "first_seen", "effective_at", F.lower("company").alias("employer"), "kind", c("enrollment_required").eqNullSafe(True).alias("enrolled"), "skills")


def profile_conditions(profiles: DataFrame) -> DataFrame:
    """user_id, conditions (arrays of tags), and what is excluded or ranks. All three kinds of remote work ask for none; other languages than English and Dutch neither."""
    remote = F.when(F.size(F.array_intersect(_values("remote"), F.array(*map(F.lit, ("remote", "hybrid", "onsite"))))) < 3, _values("remote")).otherwise(F.array().cast("array<string>"))
    every = [_tagged(name, remote if column == "remote" else _values(column)) for column, name in CONDITIONS.items()]
    language = F.when(F.col("language").isin("en", "nl"), F.array(F.concat(F.lit("language="), F.col("language"))))
    visa = F.when(F.col("visa"), F.array(F.lit("visa=true")))
    conditions = F.filter(F.array_compact(F.array(*every, language, visa)), lambda c: F.size(c) > 0)
    has = lambda column: F.coalesce(column, F.lit(False)).alias(column)
    skills = F.array_sort(F.array_distinct(F.array_compact(F.coalesce("skills", F.array().cast("array<string>")))))
    return profiles.select("user_id", conditions.alias("conditions"), _values("exclude").alias("exclude"), skills.alias("have"), has("agencies"), has("noenrol"))


def alert_rows(users: DataFrame, rows: DataFrame, profiles: DataFrame, as_of: str, top: int = 15) -> DataFrame:
    """user_id, rank, total, id of each due user's ``top`` best new postings, of ``total``.

    ``users``: user_id, alerts, alerts_sent_at; ``profiles``: the columns of PROFILE; ``rows``: the row view. Best is the score by the
    user's skills, then the newest, then the smallest id. A user without a profile is told of everything new; null and blank entries of
    a profile ask for nothing; rows without an employer or kind fail only where those are excluded. Each user_id has one row in each table.
    """
    due = due_alerts(users, as_of).select("user_id", "since")
    blank = {"conditions": "array<array<string>>", "exclude": "array<string>", "have": "array<string>"}
    known = due.join(profile_conditions(profiles), "user_id", "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in blank.items()})
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("agencies", "noenrol")})
    known = known.withColumn("strict", F.size("exclude") > 0)  # whether rows without an employer fail
    parts = ["since", "conditions", "have", "agencies", "noenrol", "strict"]
    asked = known.select("user_id", "exclude", *parts, F.sha2(F.to_json(F.struct(*parts)), 256).alias("pid"))
    distinct = asked.groupBy("pid").agg(*(F.first(c).alias(c) for c in parts))  # equal within a pid

    earliest = due.agg(F.min("since").alias("earliest"))  # one row
    fresh = posting_tags(rows).join(F.broadcast(earliest), F.col("first_seen") > F.col("earliest")).drop("earliest")
    often = fresh.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("often"))

    choices = F.when(F.size("conditions") > 0, F.col("conditions")).otherwise(F.array(F.array(F.lit(ANY))))
    each = distinct.select("pid", F.posexplode(choices).alias("nth", "any_of")).select("pid", "nth", F.explode("any_of").alias("tag"))
    counted = each.join(often, "tag", "left").groupBy("pid", "nth").agg(F.sum(F.coalesce("often", F.lit(0))).alias("often"), F.collect_list("tag").alias("tags"))  # one condition's tags
    rarest = counted.groupBy("pid").agg(F.min_by("tags", F.struct("often", "nth")).alias("any_of"))
    waiting = rarest.join(distinct, "pid").select("pid", "any_of", F.explode("any_of").alias("tag"), *parts)

    # a common tag's postings are dealt over slices, and who waits under it to each of them: no tag is one task
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = fresh.select("*", F.explode("tags").alias("tag"), F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int").alias("slice")).repartition(tasks, "tag", "slice")
    readers = waiting.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1)))).repartition(tasks, "tag", "slice")
    # whoever meets by several tags of a condition does so by the first
    met = facts.join(readers.hint("merge"), ["tag", "slice"]).where(F.get(F.array_intersect("any_of", "tags"), F.lit(0)) == F.col("tag"))
    fits = F.forall("conditions", lambda c: F.arrays_overlap(c, F.col("tags"))) & (~F.col("strict") | F.col("employer").isNotNull()) & (~F.col("agencies") | F.coalesce(F.col("kind") != "agency", F.lit(False))) & ~(F.col("noenrol") & F.col("enrolled"))
    shared = F.size(F.array_intersect("skills", "have"))
    score = F.when((F.size("skills") > 0) & (F.size("have") > 0), shared / F.greatest(F.size("skills"), F.lit(3))).otherwise(0.0)
    hits = met.where((F.col("first_seen") > F.col("since")) & fits).select("pid", "id", "employer", "effective_at", score.alias("score"))
    total = hits.groupBy("pid").agg(F.count(F.lit(1)).alias("total"))

    # what readers exclude is taken off the hits of their profile: only theirs are ranked anew
    excluded = asked.select("user_id", "pid", F.explode("exclude").alias("employer"))
    off = hits.join(excluded.select("pid", "employer").distinct(), ["pid", "employer"]).groupBy("pid", "employer").agg(F.count(F.lit(1)).alias("n"))
    removed = stored(excluded.join(off, ["pid", "employer"]))
    lost = removed.groupBy("user_id").agg(F.sum("n").alias("lost"))
    order = [F.desc("score"), F.desc("effective_at"), "id"]
    nth = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*order))
    best = hits.withColumn("rank", nth("pid")).where(F.col("rank") <= top).join(total, "pid").select("pid", "rank", "total", "id")
    plain = asked.select("user_id", "pid").join(lost, "user_id", "left_anti").join(best, "pid").select("user_id", "rank", "total", "id")

    # a profile's list is read as far as any of its readers can need it
    short = asked.select("user_id", "pid").join(lost, "user_id")
    depth = short.groupBy("pid").agg((F.max("lost") + top).alias("depth"))
    deep = hits.join(depth, "pid").withColumn("place", nth("pid")).where(F.col("place") <= F.col("depth")).drop("depth")
    own = short.join(deep, "pid").where(F.col("place") <= F.col("lost") + top).join(removed.select("user_id", "employer"), ["user_id", "employer"], "left_anti")
    again = own.withColumn("rank", nth("user_id")).where(F.col("rank") <= top).join(total, "pid").select("user_id", "rank", (F.col("total") - F.col("lost")).alias("total"), "id")
    return plain.unionByName(again)
