"""Joins by name: sectors from employer lists, tracked employers, and an outside sample."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.normalize import folded, norm_company, norm_title
from tidemark.functions.spans import let
from tidemark.operators.sections import self_description
from tidemark.session import stored

MAX_LIST_ROWS = 20_000  # of hand-kept lists, which are broadcast up to this size


def _plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9. ]", "")


def small(table: DataFrame, most: int = MAX_LIST_ROWS) -> DataFrame:
    """``table`` marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def listed_sectors(companies: DataFrame, fragments: DataFrame) -> DataFrame:
    """company, sector: the longest fragment that is a whole word of the name, or with '=' all of it.

    Names and fragments meet by a fragment's rarest word among the names, so the join is on equality and a common word
    brings few together. Nulls and empty fragments match nothing; of equal lengths the last fragment in order counts.
    """
    words = lambda text: F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " "), lambda w: w != "")
    names = companies.select("company").distinct().withColumn("words", words(F.col("company")))
    exact = F.col("fragment").startswith("=")
    parts = fragments.select("fragment", "sector", exact.alias("exact"), words(F.regexp_replace("fragment", "^=", "")).alias("f")).where(F.size("f") > 0)
    named = names.select("company", "words", F.explode(F.array_distinct("words")).alias("w"))
    often = named.groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    rarest = parts.select("fragment", F.explode("f").alias("w")).join(often, "w").groupBy("fragment").agg(F.min_by("w", F.struct("often", "w")).alias("w"))
    met = named.join(parts.join(rarest, "fragment"), "w")
    text, fragment = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join("f", " "), F.lit(" "))
    hit = met.where(F.when(F.col("exact"), text == fragment).otherwise(F.contains(text, fragment)))
    return hit.groupBy("company").agg(F.max_by("sector", F.struct(F.length("fragment").alias("n"), "fragment")).alias("sector"))


def text_sector(text: Column, patterns: dict[str, str]) -> Column:
    """The sector with most distinct words in the text: two at least, and clearly more than the next."""
    hits = [F.struct(F.size(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(folded(f"({rx})")), F.lit(1)), F.lower))).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, (s, rx) in enumerate(patterns.items())]

    def clear(best: Column) -> Column:
        first, second = best[0], F.coalesce(F.get(best, F.lit(1))["n"], F.lit(0))
        return F.when((first["n"] >= 2) & (first["n"] >= second + 1) & (first["n"] >= 1.5 * second), first["s"])

    return let(F.sort_array(F.array(*hits), asc=False), clear)


# What tells a drug maker from a hospital among employers that the lists call "health".
PHARMA = r"pharma|biotech|life sciences?|biopharma|geneesmiddel|medicines?|drug (?:discovery|development)|vaccin|therapeutics|clinical[- ]stage|diagnostics"


def sectors(postings: DataFrame, sources: DataFrame, curated: DataFrame, fragments: DataFrame, patterns: dict[str, str], intros: int = 5, intro_chars: int = 2000, read_chars: int = 12_000) -> DataFrame:
    """company, sector, found_by of every employer with live tech postings: curated, listed, agency, own words, or other.

    Own words are what ``intros`` postings say about the employer within their first ``read_chars`` characters, ``intro_chars`` each at most.
    """
    rows = postings.where("closed_at is null and duplicate_of is null and is_tech").join(sources.select("source_id", "kind"), "source_id")
    nth = F.row_number().over(Window.partitionBy("company").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= intros)
    few = stored(few.select("company", "nth", "kind", F.left("description", F.lit(read_chars)).alias("text")))  # read twice, as is ``own``
    said = self_description(few.select("company", "nth", "text"), ["company", "nth"], F.col("company"), limit=intro_chars)
    few = few.select("company", "nth", "kind").join(said, ["company", "nth"], "left").withColumn("intro", F.coalesce("intro", F.lit("")))
    own = few.groupBy("company").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col("intro").alias("t")))), lambda x: x["t"]), "\n").alias("intro"), F.min_by("kind", "nth").alias("kind"))  # at most ``intros`` a company
    own = stored(own)
    found = own.join(small(curated.select("company", F.col("sector").alias("c"))), "company", "left").join(listed_sectors(own, fragments).withColumnRenamed("sector", "l"), "company", "left")
    agency = F.coalesce(F.col("kind") == "agency", F.lit(False))
    # texts are searched once, and only where nothing that comes first says the sector
    word = F.when(F.col("c").isNull() & F.col("l").isNull() & ~agency, text_sector(F.concat_ws("\n", "company", "intro"), patterns))
    pharma = F.when(F.col("c").isNull() & (F.col("l") == "health"), F.concat_ws(" ", "company", "intro").rlike(folded(PHARMA)))

    def named(read: Column) -> Column:
        sector = F.coalesce("c", F.when(read["pharma"], "pharma"), "l", F.when(agency, "staffing"), read["word"], F.lit("other"))
        found_by = F.when(F.col("c").isNotNull(), "curated").when(read["pharma"], "list+text").when(F.col("l").isNotNull(), "list").when(agency, "source").when(read["word"].isNotNull(), "text").otherwise("none")
        return F.struct(sector.alias("sector"), found_by.alias("found_by"))

    return found.select("company", let(F.struct(word.alias("word"), pharma.alias("pharma")), named).alias("s")).select("company", "s.sector", "s.found_by")


def tracker(entries: DataFrame, postings: DataFrame, sources: DataFrame) -> DataFrame:
    """name, status, live_postings, via: tracked employers (name, match: array of needles) among live postings, else among boards.

    The needles are a hand-kept list; employers and boards are reduced to distinct names before they meet it.
    """
    needles = small(entries.select("name", F.explode("match").alias("needle")).withColumn("needle", F.lower("needle")))
    bare = F.trim(F.regexp_replace("needle", "^=", ""))
    whole = (F.trim("needle") != F.col("needle")) | (F.length(F.trim("needle")) <= 4)

    def fits(text: Column) -> Column:
        word = F.regexp(text, F.concat(F.lit(r"\b\Q"), bare, F.lit(r"\E\b")))
        return F.when(F.col("needle").startswith("="), F.trim(text) == bare).when(whole, word).otherwise(F.contains(text, F.col("needle")) | F.contains(F.replace(text, F.lit(" "), F.lit("")), F.col("needle")))

    live = postings.where("closed_at is null and duplicate_of is null").groupBy("company").agg(F.count(F.lit(1)).alias("n")).withColumn("plain", _plain(F.col("company")))
    hits = live.join(needles, fits(F.col("plain"))).select("name", "company", "n").distinct()
    covered = hits.groupBy("name").agg(F.sum("n").alias("live"), F.max_by("company", F.struct("n", "company")).alias("best"))
    boards = sources.select("source_company", "slug", "ats", F.coalesce("last_nl_count", F.lit(0)).alias("n")).withColumns({"p": _plain(F.col("source_company")), "q": _plain(F.col("slug"))})
    known = boards.join(needles, fits(F.col("p")) | fits(F.col("q"))).groupBy("name").agg(F.max_by(F.struct("ats", "slug", "n"), F.struct("n", "slug")).alias("b"))
    out = entries.select("name").join(covered, "name", "left").join(known, "name", "left")
    status = F.when(F.col("live").isNotNull(), "covered").when(F.col("b").isNotNull(), "registered").otherwise("missing")
    via = F.when(F.col("live").isNotNull(), F.concat(F.lit("postings as '"), F.col("best"), F.lit("'"))).when(F.col("b").isNotNull(), F.concat(F.col("b.ats"), F.lit("/"), F.left("b.slug", F.lit(40))))
    return out.select("name", status.alias("status"), F.coalesce("live", "b.n", F.lit(0)).cast("long").alias("live_postings"), via.alias("via"))


def tracker_summary(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("status").agg(F.count(F.lit(1)).alias("entries"), F.sum("live_postings").alias("live_postings"))


# Words that say nothing about which employer is meant.
STOP_WORDS = ["the", "group", "nederland", "netherlands", "holland", "europe", "international", "bv", "b.v."]


def company_key(name: Column) -> Column:
    words = F.filter(F.split(F.replace(F.lower(norm_company(name)), F.lit("-"), F.lit(" ")), r"\s+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))
    return F.array_join(words, " ")


ALIKE = 0.8  # least ratio of titles that are taken as one
FEW_TITLES = 64  # of one employer on one side: up to so many meet all of the other side
SHORT = 10  # titles of fewer letters meet by letters instead of pairs of letters


@F.pandas_udf(T.DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)])


def _grams(text: Column, q: int) -> Column:
    """The runs of ``q`` letters, each with its number among equal ones before it, so that common ones are counted by equality."""
    runs = F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - (q - 1)), lambda i: F.substr(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.transform(runs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(runs, F.lit(1), i), lambda h: h == g)).cast("string")))


def _letters_shared(a: Column, b: Column) -> Column:
    """How many letters two texts have in common, repeats included."""
    return F.size(F.array_intersect(_grams(a, 1), _grams(b, 1)))


def title_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """k, t, pt: the pairs of distinct titles (k, t) and (k, pt) that may be alike: candidates for the exact ratio, and titles within titles.

    A ratio of 0.8 leaves room for a fifth of both lengths in letters put in or left out, and each of those spoils two pairs of letters.
    So of a title of n letters more than n / 5 - 1 of its pairs of letters are in a title alike: it is enough to meet by all but so many
    of its rarest ones. Short titles meet by two thirds of their letters in the same way. A title within another meets it by its rarest.
    Lengths and common letters are compared before a pair is given.
    """
    n = F.length("t")
    of_left = F.when(n >= SHORT, _grams(F.col("t"), 2)).otherwise(_grams(F.col("t"), 1))
    least = F.when(n >= SHORT, F.ceil(n * 0.2 - 1)).otherwise(F.ceil(n * 2 / 3))
    index = right.select("k", "pt", F.explode(F.concat(_grams(F.col("pt"), 2), F.when(F.length("pt") < 2 * SHORT, _grams(F.col("pt"), 1)).otherwise(F.array().cast("array<string>")))).alias("g"))
    often = index.groupBy("k", "g").agg(F.count(F.lit(1)).alias("often"))
    own = left.select("k", "t", least.alias("least"), F.explode(of_left).alias("g")).join(often, ["k", "g"], "left")
    ranked = own.groupBy("k", "t", "least").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("o"), "g"))).alias("gs"))  # one title's grams
    probes = ranked.select("k", "t", F.explode(F.slice("gs", F.lit(1), F.greatest(F.size("gs") - F.col("least").cast("int") + 1, F.lit(1)))).alias("x")).where("x.o > 0").select("k", "t", F.col("x.g").alias("g"))
    met = probes.join(index, ["k", "g"]).select("k", "t", "pt").distinct()
    # titles of the right within titles of the left
    back = left.select("k", "t", F.explode(_grams(F.col("t"), 2)).alias("g"))
    rare = index.where("length(g) > 3").join(back.groupBy("k", "g").agg(F.count(F.lit(1)).alias("often")), ["k", "g"], "left")
    rarest = rare.groupBy("k", "pt").agg(F.min_by("g", F.struct(F.coalesce("often", F.lit(0)), "g")).alias("g"))
    within = rarest.join(back, ["k", "g"]).where((F.length("pt") >= 12) & F.contains("t", F.col("pt"))).select("k", "t", "pt")
    m = F.length("pt")
    close = (3 * F.least(n, m) >= 2 * F.greatest(n, m)) & (_letters_shared(F.col("t"), F.col("pt")) >= 0.4 * (n + m) - 1e-9)
    contained = (n >= 12) & F.contains("pt", F.col("t"))
    return met.where(close | contained).unionByName(within).distinct()


def contained_names(small: DataFrame, big: DataFrame, n: int = 5) -> DataFrame:
    """small, big: the names of one column each, of which the first, of ``n`` letters at least, lies in the second.

    All runs of ``n`` letters of a contained name are in the other too; they meet by the one that is in fewest of the others.
    """
    runs = lambda c: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substr(F.col(c), i, F.lit(n)))))
    others = big.where(F.length("big") >= n).select("big", runs("big").alias("run"))
    often = others.groupBy("run").agg(F.count(F.lit(1)).alias("often"))
    own = small.where(F.length("small") >= n).select("small", runs("small").alias("run")).join(often, "run", "left")
    rarest = own.groupBy("small").agg(F.min_by("run", F.struct(F.coalesce("often", F.lit(0)), "run")).alias("run"))
    return rarest.join(others, "run").where(F.contains("big", F.col("small"))).select("small", "big")


def _may_be_alike(t: Column, pt: Column) -> Column:
    """Whether two titles can have the least ratio, by their lengths and common letters, or one may be taken for being within the other."""
    n, m = F.length(t), F.length(pt)
    close = (3 * F.least(n, m) >= 2 * F.greatest(n, m)) & (_letters_shared(t, pt) >= 0.4 * (n + m) - 1e-9)
    return _one_in_other(t, pt) | close


def _one_in_other(t: Column, pt: Column) -> Column:
    return (t == pt) | ((F.length(t) >= 12) & F.contains(pt, t)) | ((F.length(pt) >= 12) & F.contains(t, pt))


def employers_title_pairs(left: DataFrame, right: DataFrame, few: int = FEW_TITLES) -> DataFrame:
    """k, t, pt: of employers with at most ``few`` titles on one side all pairs, of the others those that may be alike.

    So many pairs cost less than the titles' runs of letters would; either way an employer's work grows with its titles.
    """
    sizes = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(right.groupBy("k").agg(F.count(F.lit(1)).alias("m")), "k")
    sized = sizes.select("k", (F.least("n", "m") <= few).alias("few"))
    small, large = sized.where("few").select("k"), sized.where("not few").select("k")
    every = left.join(small, "k").join(right, "k").select("k", "t", "pt")
    return every.unionByName(title_pairs(left.join(large, "k"), right.join(large, "k")))


def match_sample(sample: DataFrame, postings: DataFrame) -> DataFrame:
    """The sample (id, title, company) with employer_known and matched_id, the smallest posting that fits.

    The distinct keys of the sample and of the postings meet if they are equal, or if one of five letters
    and more lies in the other, at any place. Only titles of employers that the sample names are compared, each pair of texts once.
    """
    asked = stored(sample.select("id", company_key(F.col("company")).alias("key"), norm_title(F.col("title")).alias("t")))
    # titles once each: of an employer's many postings the smallest id stands for all of one title
    live = stored(postings.where("closed_at is null and duplicate_of is null").groupBy(company_key(F.col("company")).alias("k"), norm_title(F.col("title")).alias("pt")).agg(F.min("id").alias("pid")))
    left, right = (keys.where(F.col(c) != "").distinct() for keys, c in ((asked.select("key"), "key"), (live.select(F.col("k").alias("pkey")), "pkey")))
    within = contained_names(left.toDF("small"), right.toDF("big")).toDF("key", "pkey")
    around = contained_names(right.toDF("small"), left.toDF("big")).select(F.col("big").alias("key"), F.col("small").alias("pkey"))
    equal = left.join(right, F.col("key") == F.col("pkey"))
    keys = stored(equal.unionByName(within).unionByName(around).distinct())
    titled = live.where("pt <> ''").join(keys.select(F.col("pkey").alias("k")).distinct(), "k", "left_semi")
    wanted = asked.where("t <> ''").join(keys, "key").select("id", F.col("pkey").alias("k"), "t")
    pairs = employers_title_pairs(wanted.select("k", "t").distinct(), titled.select("k", "pt"))
    t, pt = F.col("t"), F.col("pt")
    texts = pairs.select("t", "pt").distinct().where(_may_be_alike(t, pt)).withColumn("ratio", F.when(_one_in_other(t, pt), 1.0).otherwise(title_ratio("t", "pt"))).where(F.col("ratio") >= ALIKE)
    hit = wanted.join(pairs.join(texts.select("t", "pt"), ["t", "pt"]), ["k", "t"]).join(titled, ["k", "pt"])
    matched = hit.groupBy("id").agg(F.min("pid").alias("matched_id"))
    known = asked.join(keys.select("key").distinct(), "key", "left_semi").select("id", F.lit(True).alias("employer_known"))
    return sample.join(known, "id", "left").join(matched, "id", "left").withColumn("employer_known", F.coalesce("employer_known", F.lit(False)))


def recall_report(matched: DataFrame) -> DataFrame:
    """One row from a matched sample with tech and agency flags."""
    tech, hit = F.col("tech"), F.col("matched_id").isNotNull()
    both = tech & ~F.col("agency")
    ratio = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a) / F.count_if(b)).otherwise(0.0)
    every = F.lit(True)
    return matched.agg(
        F.count(F.lit(1)).alias("sample"), F.count_if(tech).alias("sample_tech"), F.count_if(both).alias("sample_tech_employer"),
        F.count_if(hit).alias("matched"), F.count_if(hit & tech).alias("matched_tech"), F.count_if(hit & both).alias("matched_tech_employer"),
        ratio(hit, every).alias("recall"), ratio(hit & tech, tech).alias("recall_tech"), ratio(hit & both, both).alias("recall_tech_employer"),
        F.count_if(both & F.col("employer_known") & ~hit).alias("employer_known_unmatched"),
    )


def missing_employers(matched: DataFrame, top: int = 40) -> DataFrame:
    lost = matched.where("tech and not agency and matched_id is null and not employer_known")
    return lost.groupBy("company").agg(F.count(F.lit(1)).alias("postings")).orderBy(F.desc("postings"), "company").limit(top)
