"""Titles and employers of a sample against all pairs, and headcounts."""

import difflib
import json
import random

from pyspark.sql import functions as F

from tidemark.operators import headcounts, matching

WORDS = ["senior", "junior", "data", "engineer", "baker", "bread", "cook", "nurse", "night", "lead", "developer", "java", "python", "cloud", "ml", "qa", "it"]


def test_title_pairs_keep_all_that_are_alike_and_few_others(spark):
    rng = random.Random(11)

    def title():
        words = rng.choices(WORDS, k=rng.choice([1, 1, 2, 3, 4]))
        text = " ".join(words)
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "x", "s"]) + text[at + rng.choice([0, 1]) :]
        return text.strip() or "a"

    left, right = ({title() for _ in range(500)} | {"a", "ab", "abc"} for _ in range(2))
    frames = [spark.createDataFrame([("k", t) for t in sorted(side)], f"k string, {c} string") for side, c in ((left, "t"), (right, "pt"))]
    got = {(r.t, r.pt) for r in matching.title_pairs(*frames).collect()}

    def alike(a, b):
        return a == b or len(a) >= 12 and a in b or len(b) >= 12 and b in a or difflib.SequenceMatcher(None, a, b).ratio() >= 0.8

    want = {(a, b) for a in left for b in right if alike(a, b)}
    assert want <= got
    assert len(got) < 0.1 * len(left) * len(right)


def test_employers_of_few_titles_meet_directly_and_others_by_letters(spark):
    rng = random.Random(13)
    title = lambda: " ".join(rng.choices(WORDS, k=3))
    left, right = ({(k, title()) for k, n in sizes for _ in range(n)} for sizes in ((("one", 1), ("many", 40), ("alone", 3)), (("one", 60), ("many", 50))))
    frames = [spark.createDataFrame(sorted(side), f"k string, {c} string") for side, c in ((left, "t"), (right, "pt"))]
    alike = lambda a, b: a == b or len(a) >= 12 and a in b or len(b) >= 12 and b in a or difflib.SequenceMatcher(None, a, b).ratio() >= 0.8
    every = {(k, a, b) for k, a in left for j, b in right if j == k}
    for few in (0, 5, 64):
        got = [tuple(r) for r in matching.employers_title_pairs(*frames, few=few).collect()]
        assert len(got) == len(set(got)) and {p for p in every if alike(*p[1:])} <= set(got) <= every
        assert (len(got) == len(every)) == (few == 64)


def test_sample_equals_all_pairs(spark):
    rng = random.Random(12)
    names = ["Acme B.V.", "Acme", "Acme Widgets", "Bolt", "Big Bolt Holland", "", None]
    titles = [" ".join(rng.choices(WORDS, k=3)) for _ in range(25)] + ["", None]
    sample = [(k, rng.choice(titles), rng.choice(names)) for k in range(60)]
    posts = [(1000 + k, rng.choice(titles) if k % 2 else (rng.choice(titles) or "x") + "s", rng.choice(names), None, None) for k in range(120)]
    asked = spark.createDataFrame(sample, "id long, title string, company string")
    live = spark.createDataFrame(posts, "id long, title string, company string, closed_at timestamp_ntz, duplicate_of long")
    key = lambda df: {r.id: (r.k or "", r.t or "") for r in df.select("id", matching.company_key(F.col("company")).alias("k"), matching.norm_title(F.col("title")).alias("t")).collect()}
    mine, theirs = key(asked), key(live)
    meets = lambda a, b: a and b and (a == b or len(a) >= 5 and a in b or len(b) >= 5 and b in a)
    alike = lambda a, b: a and b and (a == b or len(a) >= 12 and a in b or len(b) >= 12 and b in a or difflib.SequenceMatcher(None, a, b).ratio() >= 0.8)
    want = {i: (any(meets(k, p) for p, _ in theirs.values()), min((j for j, (p, u) in theirs.items() if meets(k, p) and alike(t, u)), default=None)) for i, (k, t) in mine.items()}
    got = {r.id: (r.employer_known, r.matched_id) for r in matching.match_sample(asked, live).collect()}
    assert got == {i: (bool(known), best) for i, (known, best) in want.items()}
    flagged = matching.match_sample(asked.withColumns({"tech": F.col("id") % 2 == 0, "agency": F.col("id") % 3 == 0}), live)
    rows = [(got[i][0], got[i][1] is not None, i % 2 == 0, i % 2 == 0 and i % 3 != 0) for i, _, _ in sample]
    n = [len(rows), sum(r[2] for r in rows), sum(r[3] for r in rows), sum(r[1] for r in rows), sum(r[1] and r[2] for r in rows), sum(r[1] and r[3] for r in rows)]
    assert list(matching.recall_report(flagged).first()) == [*n, n[3] / n[0], n[4] / n[1], n[5] / n[2], sum(r[3] and r[0] and not r[1] for r in rows)]
    assert matching.match_sample(asked.limit(0), live).count() == 0 and matching.match_sample(asked, live.limit(0)).where("matched_id is not null").count() == 0


def test_counts_in_fields(spark):
    rows = [("3.600", 3600), ("43,520 (2024)", 43520), ("ca. 5000", 5000), ("{{formatnum:12000}}", 12000), ("± 1200 fte", 1200), ("1 250 people<ref>99</ref>", 1250), ("many", None), ("9999999", None), ("0", None), (None, None), ("9" * 40, None)]
    df = spark.createDataFrame(rows, "t string, want long").withColumn("got", headcounts.parse_count(F.col("t")))
    assert df.where("not got <=> want").collect() == []


def test_headcounts_at_their_edges(spark):
    claim = lambda amount, year=None: {"mainsnak": {"datavalue": {"value": {"amount": amount}}}} | ({"qualifiers": {"P585": [{"datavalue": {"value": {"time": f"+{year}-01-01"}}}]}} if year else {})
    entry = lambda *counts, site="https://www.acme.nl/about", label="Acme", country="Q55": json.dumps({"labels": {"en": {"value": label}}, "claims": {"P1128": list(counts), "P856": [{"mainsnak": {"datavalue": {"value": site}}}, {"mainsnak": {}}], "P17": [{"mainsnak": {"datavalue": {"value": {"id": country}}}}]}})
    companies = spark.createDataFrame([("Acme B.V.", ["acme.nl"]), ("Bolt", None), ("Cog", ["cog.eu"]), ("Done", ["acme.nl"]), ("Wrong", ["acme.nl"]), (None, ["acme.nl"]), ("Dot", ["dot.com"])], "company string, domains array<string>")
    entries = spark.createDataFrame(
        [
            ("Acme B.V.", 1, "Q1", entry(site="https://other.com", label="Else")), ("Acme B.V.", 2, "Q2", entry(claim("+10", 2019), claim("+30", 2021), claim("+20", 2021), claim("x", 2024), claim("+40"), site="acme.nl", label="Else", country="Q1")),
            ("Acme B.V.", 3, "Q3", entry(claim("+99", 2025))), ("Bolt", 1, "Q4", entry(claim("+7.9"), label="BOLT bv", site="x.y")), ("Bolt", 2, "Q5", "not json"), ("Cog", 1, "Q6", entry(claim("+5"), label="Cog", site="x.y", country="Q31")), ("Cog", 2, "Q7", None),
            ("Done", 1, "Q8", entry(claim("+5"))), ("Wrong", 1, "Q9", entry(claim("+5"))),
        ],
        "company string, nth int, entry_id string, payload string",
    )
    box = "{{Infobox\n| website = {{URL|https://jobs.cog.eu/x}}\n| employees = ca. 1.500 (2018)\n}}\n"
    articles = spark.createDataFrame([("Cog", "en", 1, "Cog", box), ("Cog", "nl", 1, "Cogwheel Group", box), ("Cog", "nl", 0, "Parent", box + "A holding."), ("Dot", "nl", 1, "Dot", None), ("Bolt", "nl", 1, "Bolt", box)], "company string, lang string, nth int, title string, wikitext string")
    done, wrong = (spark.createDataFrame([(n,)], "company string") for n in ("Done", "Wrong"))
    got = {tuple(r) for r in headcounts.headcounts(companies, entries, articles, done, wrong).collect()}
    assert got == {("Acme B.V.", 30, "2021", "wikidata:Q2"), ("Bolt", 7, "", "wikidata:Q4"), ("Cog", 1500, "2018", "nlwiki:Cogwheel Group")}
    boards = spark.createDataFrame([("Acme", "https://werkenbijacme.nl/jobs", "acme"), ("Acme", "https://boards.greenhouse.io/acme", "www.acme.nl"), ("Bolt", None, "bolt")], "source_company string, url string, slug string")
    assert [tuple(r) for r in headcounts.candidate_domains(boards).collect()] == [("Acme", ["acme.nl", "werkenbijacme.nl"])]
