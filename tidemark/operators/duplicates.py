"""Entity resolution over open postings: ordered rules, each giving (duplicate, winner) pairs, and their roots.

Every rule blocks on equal keys, so no two unrelated rows meet. A group's winner is one aggregate (with
map-side combine) that is joined back, so a group of any size stays spread over tasks. Rules run one
after the other, because a later rule leaves rows alone that an earlier one has marked.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.normalize import dedup_key, dutch_name, norm_company, norm_title
from tidemark.functions.spans import let
from tidemark.session import stored

# Which copy wins.
KIND_RANK = {"employer": 0, "board": 0, "agency": 1, "aggregator": 2}
ATS_RANK = {"greenhouse": 0, "lever": 0, "ashby": 0, "recruitee": 0, "workable": 0, "jsonld": 5}
# Language and country codes that sites put into paths.
LANGUAGES = (
    "en", "nl", "de", "fr", "es", "it", "pt", "pl", "el", "sv", "da", "fi", "no", "nb", "cs", "hu", "ro", "tr", "ja", "zh", "ko", "ru", "uk", "bg",
    "hr", "sk", "sl", "lt", "lv", "et", "ar", "he", "th", "vi", "id", "br", "cn", "jp", "kr", "se", "dk", "cz", "gr", "ua", "gb", "us", "be", "at",
    "ch",
)
STUB_LENGTH = 300
# What all rules read, and the facts that the last one compares.
KEYS = ["source_id", "city", "url", "first_seen", "content_hash", "key", "stem", "twin_stem", "lang_stem", "lang_rank", "order_key"]
ASKED = ["posting_language", "skills_required", "seniority", "years_experience", "role_family"]
# What bilingual sites put before a title, and Dutch words of titles with their English cognates.
TITLE_PREFIX = r"(?iuU)^(?:stage|internship|afstudeerstage|graduation internship|vacature|vacancy)\s*[|:–-]\s*"
COGNATES = {
    "defensie": "defence", "onderzoeker": "researcher", "medewerker": "employee", "stage": "internship", "afdeling": "department", "coördinator": "coordinator", "ingenieur": "engineer",
    "netwerk": "network", "militaire": "military", "energie": "energy", "materialentransitie": "materials transition", "divisie": "division", "februari": "february",
}


def _rank(column: str, ranks: dict[str, int], other: int) -> Column:
    found = F.lit(other)
    for name, rank in ranks.items():
        found = F.when(F.col(column) == name, rank).otherwise(found)
    return found


def url_stem(url: Column, strip_counter: bool = False) -> Column:
    stem = F.lower(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""))
    return F.regexp_replace(stem, r"[-_ ]?\(?[0-9]{1,3}\)?$", "") if strip_counter else stem


def _segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def language_of(segment: Column) -> Column:
    code = F.regexp_extract(F.lower(segment), r"^([a-z]{2})(?:[-_][a-z]{2})?$", 1)
    return F.when(code.isin(*LANGUAGES), code)


def language_stem(url: Column) -> Column:
    """The address without language segments among its first two."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)), r"^www\.", "")
    kept = F.filter(_segments(url), lambda s, i: (i >= 2) | language_of(s).isNull())
    return F.concat(host, F.lit("/"), F.array_join(kept, "/"))


def language_rank(url: Column) -> Column:
    first = F.get(F.filter(F.transform(F.slice(_segments(url), 1, 2), language_of), lambda c: c.isNotNull()), F.lit(0))
    return F.when(first == "en", 0).when(first.isNull(), 1).when(first == "nl", 2).otherwise(3)


def prepared(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Open postings with the keys and ranks that the rules need."""
    rows = postings.where("closed_at is null").join(sources.select("source_id", "ats", "kind"), "source_id")
    return rows.withColumns(
        {
            "key": dedup_key(F.coalesce("company", F.lit("")), F.coalesce("title", F.lit("")), F.col("city")),
            "stem": url_stem(F.col("url")),
            "twin_stem": url_stem(F.col("url"), True),
            "lang_stem": language_stem(F.col("url")),
            "lang_rank": language_rank(F.col("url")),
            "order_key": F.struct(_rank("kind", KIND_RANK, 0).alias("k"), _rank("ats", ATS_RANK, 3).alias("a"), F.col("first_seen"), F.col("id")),
        }
    )


def winners(rows: DataFrame, keys: list[str], order: Column, extra: list[str] = []) -> DataFrame:
    """dup, canon of every row but the first of its group."""
    first = rows.groupBy(*keys).agg(F.min_by(F.struct("id", *extra), order).alias("w"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(first, [rows[k].eqNullSafe(first[k]) for k in keys])
    return joined.where(F.col("id") != F.col("w.id")).select(F.col("id").alias("dup"), F.col("w.id").alias("canon"), *(F.col(c).alias(f"dup_{c}") for c in extra), *(F.col(f"w.{c}").alias(f"canon_{c}") for c in extra))


def cross_source(rows: DataFrame) -> DataFrame:
    """Rule 1: the same job on another board."""
    return winners(rows, ["key"], F.col("order_key"), ["source_id"]).where("dup_source_id <> canon_source_id").select("dup", "canon")


def twins(rows: DataFrame) -> DataFrame:
    """Rule 2: one board's repeats of a text, but for a counter in the address."""
    return winners(rows, ["source_id", "key", "content_hash", "twin_stem"], F.col("order_key")).select("dup", "canon")


def same_address(rows: DataFrame) -> DataFrame:
    """Rule 3."""
    return winners(rows, ["stem"], F.col("order_key")).select("dup", "canon")


def title_without_city(title: Column, city: Column) -> Column:
    """The normal title without the city's names. A pattern is made only for a name that the title holds, as each row would need its own."""
    names = F.array_distinct(F.array_compact(F.array(norm_title(city), norm_title(dutch_name(city)))))

    def cut(t: Column, n: Column) -> Column:
        bare = F.regexp_replace(t, F.concat(F.lit(r"\b(?:in |te |- )?\Q"), n, F.lit(r"\E\b")), F.lit(" "))
        return F.when((n == "") | ~F.contains(t, n), t).otherwise(F.trim(F.regexp_replace(bare, F.lit(" +"), F.lit(" "))))

    return let(norm_title(F.coalesce(title, F.lit(""))), lambda whole: let(F.aggregate(names, whole, cut), lambda rest: F.when(rest == "", whole).otherwise(rest)))


def text_signature(text: Column, cities: Column) -> Column:
    """SHA-1 of the first 6000 characters without cities, digits and signs; null for less than 80."""
    t = F.aggregate(cities, F.lower(text), lambda s, c: F.replace(s, c, F.lit(" ")))
    t = F.trim(F.regexp_replace(t, r"(?U)(?![a-z])[\d\W_]+", " "))  # plain letters are left at once
    return F.when(F.length(t) >= 80, F.sha1(F.left(t, F.lit(6000))))


def per_city(rows: DataFrame) -> DataFrame:
    """Rule 5: one board, employer, title and text apart from cities. Gives the winner's and the copy's city too."""
    keyed = rows.withColumns({"_company": F.lower(norm_company(F.coalesce("company", F.lit("")))), "_title": title_without_city(F.col("title"), F.col("city"))})
    keys = ["source_id", "_company", "_title"]
    named = keyed.select(*keys, F.explode(F.array_compact(F.concat(F.array(F.lower("city")), F.transform(F.coalesce("also_in", F.array().cast("array<string>")), F.lower)))).alias("c")).distinct()
    cities = named.groupBy(*keys).agg(F.array_sort(F.collect_set("c"), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)).alias("cities"))  # names of places, a few thousand at most
    signed = keyed.join(cities, keys, "left").withColumn("signature", text_signature(F.coalesce("description", F.lit("")), F.coalesce("cities", F.array().cast("array<string>")))).where("signature is not null")
    order = F.struct(F.col("order_key.k"), F.col("order_key.a"), "lang_rank", "first_seen", "id")
    signed = stored(signed.select("id", "city", *keys, "signature", order.alias("order")))  # read twice, and texts are dear to sign
    return winners(signed, [*keys, "signature"], F.col("order"), ["city"])


def other_language(rows: DataFrame) -> DataFrame:
    """Rule 6: addresses that differ by a language segment, in groups where some member has one."""
    mixed = rows.groupBy("source_id", "lang_stem").agg(F.max((F.col("lang_rank") != 1).cast("int")).alias("mixed")).where("mixed = 1").drop("mixed")
    return winners(rows.join(mixed, ["source_id", "lang_stem"]), ["source_id", "lang_stem"], F.struct("lang_rank", "first_seen", "id")).select("dup", "canon")


def _ratio(a: list[str], b: list[str], floor: float) -> float:
    match = difflib.SequenceMatcher(None, a, b, autojunk=False)
    if match.real_quick_ratio() < floor or match.quick_ratio() < floor:
        return 0.0
    return match.ratio()


def _words(text: str, most: int) -> list[str]:
    return re.findall(r"\w+", text.lower())[:most]


def same_board(rows: DataFrame, words: int = 1500) -> DataFrame:
    """Rule 7: one board, title and city, tech rows only: a stub beside a full text, two languages, nearly the same words, or the same facts."""
    tech = rows.where("is_tech").withColumn("text", F.coalesce("description", F.lit("")))
    order = F.struct(F.length("text") < STUB_LENGTH, ~F.col("posting_language").eqNullSafe("en"), -F.unix_micros(F.coalesce("posted_at", "first_seen").cast("timestamp")), "id")
    facts = ["text", *ASKED]
    pairs = winners(stored(tech.select("id", "source_id", "key", order.alias("order"), *facts)), ["source_id", "key"], F.col("order"), facts)

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(_words(x, words), _words(y, words), 0.6) if x is not None else 0.0 for x, y in zip(a, b)], dtype="float64")

    stub = (F.length("dup_text") < STUB_LENGTH) != (F.length("canon_text") < STUB_LENGTH)
    languages = F.array_sort(F.array("dup_posting_language", "canon_posting_language")) == F.array(F.lit("en"), F.lit("nl"))
    of = lambda side: F.coalesce(f"{side}_skills_required", F.array().cast("array<string>"))
    shared, all_of = F.size(F.array_intersect(of("dup"), of("canon"))), F.size(F.array_union(of("dup"), of("canon")))
    alike = (all_of == 0) | (shared / F.greatest(all_of, F.lit(1)) >= 0.8)  # two postings without skills have the same ones
    facts_equal = alike & F.col("dup_seniority").eqNullSafe(F.col("canon_seniority")) & F.col("dup_years_experience").eqNullSafe(F.col("canon_years_experience")) & F.col("dup_role_family").eqNullSafe(F.col("canon_role_family"))
    settled = F.coalesce(stub, F.lit(False)) | F.coalesce(languages, F.lit(False)) | (F.col("canon_text") == F.col("dup_text"))
    unlike = lambda text: F.when(~settled, F.col(text))  # noqa: E731  # only these pairs' words are compared
    scored = pairs.withColumn("ratio", similarity(unlike("canon_text"), unlike("dup_text")))
    same = settled | (F.col("ratio") >= 0.9) | ((F.col("ratio") >= 0.6) & F.coalesce(facts_equal, F.lit(False)))
    return scored.where(same).select("dup", "canon")


def path_language(url: Column) -> Column:
    """'nl' or 'en' if the address's first segment is such a language, else null."""
    code = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://[^/]+/(en|nl|en-[a-z]{2}|nl-[a-z]{2})(?:/|$)", 1))
    return F.when(code != "", F.left(code, F.lit(2)))


def bilingual_title(title: Column) -> Column:
    """The title's words without a prefix such as "Stage |", with Dutch cognates in English."""
    bare = F.replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), TITLE_PREFIX, ""), F.lit("&amp;"), F.lit("&"))
    known = F.create_map(*(F.lit(w) for pair in COGNATES.items() for w in pair))
    return F.array_join(F.transform(F.regexp_extract_all(bare, F.lit("([a-z0-9àáäéèëïíóöüú]+)"), F.lit(1)), lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def _greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of each group, which come best first, those whose two sides are both still free. Only a group's used ids are kept."""
    group, used_dup, used_canon = None, set(), set()
    for batch in batches:
        dups, canons = [], []
        for g, dup, canon in zip(batch["g"].to_pylist(), batch["dup"].to_pylist(), batch["canon"].to_pylist()):
            if g != group:
                group, used_dup, used_canon = g, set(), set()
            if dup in used_dup or canon in used_canon:
                continue
            used_dup.add(dup)
            used_canon.add(canon)
            dups.append(dup)
            canons.append(canon)
        yield pa.RecordBatch.from_arrays([pa.array(dups, pa.int64()), pa.array(canons, pa.int64())], names=["dup", "canon"])


def bilingual(rows: DataFrame, threshold: float = 0.55, lone_threshold: float = 0.45) -> DataFrame:
    """Rule 4: a Dutch and an English copy on one board, same employer, city and day, by their titles and the numbers of their texts.

    Score: 0.6 of the titles' ratio and 0.4 of the shared numbers. ``threshold`` is enough, and for two copies that have no other
    plausible partner ``lone_threshold``. One-to-one, best score first. Where a board has /nl/ pages, none under /en/ and others without a
    language, these others are the English ones.
    """

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")

    lang = path_language(F.col("url"))
    sites = rows.groupBy("source_id").agg(F.bool_or(lang.eqNullSafe(F.lit("nl"))).alias("_nl"), F.bool_or(lang.eqNullSafe(F.lit("en"))).alias("_en")).where("_nl").select("source_id", "_en")
    day = F.to_date(F.coalesce("posted_at", "first_seen"))
    numbers = F.array_distinct(F.regexp_extract_all(F.coalesce("description", F.lit("")), F.lit(r"(?U)(\d[\d.,]*\d|\d{2,})"), F.lit(1)))
    side = F.coalesce(lang, F.when(~F.col("_en"), "en"))
    base = rows.join(sites, "source_id").select("source_id", "company", F.coalesce("city", F.lit("")).alias("city"), day.alias("day"), "id", side.alias("side"), bilingual_title(F.col("title")).alias("title"), numbers.alias("numbers")).where("day is not null")
    keys = ["source_id", "company", "city", "day"]
    nl = base.where("side = 'nl'").select(*keys, F.col("id").alias("dup"), F.col("title").alias("n_title"), F.col("numbers").alias("n_numbers"))
    en = base.where("side = 'en'").select(*(F.col(k).alias(f"e_{k}") for k in keys), F.col("id").alias("canon"), F.col("title").alias("e_title"), F.col("numbers").alias("e_numbers"))
    shared = F.size(F.array_intersect("n_numbers", "e_numbers")) / F.greatest(F.size(F.array_union("n_numbers", "e_numbers")), F.lit(1))
    met = nl.join(en, [nl[k].eqNullSafe(en[f"e_{k}"]) for k in keys]).select(F.xxhash64(*keys).alias("g"), "dup", "canon", shared.alias("shared"), ratio("n_title", "e_title").alias("ratio"))
    scored = met.where("ratio >= 0.45 or shared >= 0.9").select("g", "dup", "canon", (0.6 * F.col("ratio") + 0.4 * F.col("shared")).alias("score")).where(F.col("score") >= lone_threshold)
    others = lambda column: F.count(F.lit(1)).over(Window.partitionBy("g", column))
    plausible = scored.repartition("g").withColumns({"n_dup": others("dup"), "n_canon": others("canon")}).where((F.col("score") >= threshold) | ((F.col("n_dup") == 1) & (F.col("n_canon") == 1)))
    best_first = plausible.select("g", F.col("dup").cast("long"), F.col("canon").cast("long"), "score").sortWithinPartitions("g", F.desc("score"), F.desc("dup"), F.desc("canon"))
    return best_first.mapInArrow(_greedy, "dup long, canon long")


def without_cycles(links: DataFrame) -> DataFrame:
    """``links`` (dup, canon, one of each dup) as they stand if taken by ascending dup, each refused that would close a cycle.

    Every row has one link at most, so a cycle of any length is closed by the last of its links: that one is dropped. Walks are doubled,
    with the greatest dup on the way, until all have ended or are longer than there are rows that have not ended, so each of those has
    gone round its cycle. A link to itself is a cycle too. An empty table stays empty; rows without dup or canon are no links.
    """
    links = stored(links.where("dup is not null and canon is not null").select("dup", "canon"))
    walks, length = links.select("dup", F.col("canon").alias("to"), F.col("dup").alias("top")), 1
    while True:
        onward = walks.select(F.col("dup").alias("to"), F.col("to").alias("next"), F.col("top").alias("next_top"))
        met = stored(walks.join(onward, "to", "left").select("dup", "to", "top", "next", "next_top"))
        going = met.where("next is not null")
        number = going.count()
        if not number:
            return links
        if length >= number:
            break
        walks, length = met.select("dup", F.coalesce("next", "to").alias("to"), F.greatest("top", "next_top").alias("top")), 2 * length
    on_cycles = going.select(F.col("to").alias("dup")).distinct()
    last = going.join(on_cycles, "dup").select(F.col("top").alias("dup")).distinct()
    return links.join(last, "dup", "left_anti")


def resolve_roots(links: DataFrame) -> DataFrame:
    """dup, root of links (dup, canon) without cycles: chains are followed by doubling until nothing changes."""
    roots = stored(links.select("dup", F.col("canon").alias("root")))
    while True:
        step = roots.select(F.col("dup").alias("root"), F.col("root").alias("next"))
        after = stored(roots.join(step, "root", "left").select("dup", F.coalesce("next", "root").alias("after"), F.col("root").alias("before")))
        roots = after.select("dup", F.col("after").alias("root"))
        if after.where("after <> before").isEmpty():
            return roots


def mark_duplicates(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """id, duplicate_of, also_in of all open postings: the root of each duplicate, and a root's further cities.

    Rules in order; of one rule the links in order of the duplicate's id, none that would close a cycle. A row that an earlier rule has
    marked stays as it is. No open posting gives no row; rows without a source are not seen; further columns are not read. Rows are
    prepared once and stored, and again without what only some rules read.
    """
    whole = stored(prepared(postings, sources).select("id", "company", "title", "description", "also_in", "posted_at", "is_tech", *ASKED, *KEYS))
    rows = stored(whole.select("id", *KEYS))
    roots = None
    cities = None
    for rule in (cross_source, twins, same_address, bilingual, per_city, other_language, same_board):
        input_rows = whole if rule in (bilingual, per_city, same_board) else rows
        if roots is not None and rule in (per_city, same_board):  # these look at unmarked rows only
            input_rows = whole.join(roots.select(F.col("dup").alias("id")), "id", "left_anti")
        found = rule(input_rows)
        if rule is per_city:
            found = stored(found)
            cities = found.where("dup_city is not null and not dup_city <=> canon_city").select("canon", "dup_city")
        pairs = found.select("dup", "canon")
        if roots is not None:
            up = roots.select(F.col("dup").alias("canon"), F.col("root"))
            pairs = pairs.join(roots.select("dup"), "dup", "left_anti").join(up, "canon", "left").select("dup", F.coalesce("root", "canon").alias("canon")).where("dup <> canon")
        pairs = without_cycles(pairs.groupBy("dup").agg(F.min("canon").alias("canon")))
        links = pairs if roots is None else pairs.unionByName(roots.select("dup", F.col("root").alias("canon")))
        roots = resolve_roots(links)
        if rule is per_city:  # cities go to the root of the moment; should a later rule mark it, they are not handed on
            cities = stored(cities.join(roots.select(F.col("dup").alias("canon"), "root"), "canon", "left").select(F.coalesce("root", "canon").alias("id"), "dup_city"))
    folded_in = cities.groupBy("id").agg(F.array_sort(F.collect_set("dup_city")).alias("also_in"))  # names of places, a few thousand at most
    out = rows.select("id").join(roots.select(F.col("dup").alias("id"), F.col("root").alias("duplicate_of")), "id", "left").join(folded_in, "id", "left")
    return out.select("id", "duplicate_of", F.when(F.col("duplicate_of").isNull(), F.col("also_in")).alias("also_in"))
