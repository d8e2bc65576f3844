"""Ordered marking of duplicates against a version that walks rows one by one."""

import datetime as dt
import difflib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions
from test_operators import open_rows

from tidemark.operators import duplicates

BOARDS = {1: ("greenhouse", "employer"), 2: ("jsonld", "agency"), 3: ("jsonld", "employer")}
LONG = "We look for someone who likes long walks and short meetings and clear words every day of the week in {} all year round"


def sources(spark):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in BOARDS.items()], "source_id long, ats string, kind string")


def sequential(links):
    """Links (dup, canon) taken one by one: none of a marked row, none that closes a cycle."""
    canonical = {}

    def root(x):
        while x in canonical:
            x = canonical[x]
        return x

    for dup, canon in links:
        if dup != canon and dup not in canonical and root(canon) != dup:
            canonical[dup] = root(canon)
    return {d: root(d) for d in canonical}


def test_cycles_of_any_length_lose_their_last_link(spark):
    rng = random.Random(5)
    for size in (3, 40, 300):
        links = [(d, rng.randrange(1, size + 1)) for d in rng.sample(range(1, size + 1), max(1, size * 4 // 5))]
        df = spark.createDataFrame(links, "dup long, canon long")
        got = {r.dup: r.root for r in duplicates.resolve_roots(duplicates.without_cycles(df)).collect()}
        assert got == sequential(sorted(links))
    ring = [(k, k % 100 + 1) for k in range(1, 101)]
    got = duplicates.without_cycles(spark.createDataFrame(ring, "dup long, canon long")).collect()
    assert sorted(tuple(r) for r in got) == ring[:-1]
    empty = spark.createDataFrame([(None, 1), (2, None)], "dup long, canon long")
    assert duplicates.without_cycles(empty).count() == 0


def test_rules_that_close_a_cycle_through_three_rows(spark):
    """Rule 1 marks three rows across boards, rule 6 would then link their roots in a ring: the last link is refused."""
    day = lambda n: dt.datetime(2026, 9, n)
    rows = [(1, 1, "A", "https://a.ex/job/1", 1), (2, 3, "A", "https://c.ex/en/job/3", 5), (3, 2, "B", "https://b.ex/job/2", 1), (4, 1, "B", "https://a.ex/en/job/1", 5), (5, 3, "C", "https://c.ex/job/3", 1), (6, 2, "C", "https://b.ex/en/job/2", 5)]
    df = open_rows(spark, [{"id": i, "source_id": s, "title": t, "url": u, "first_seen": day(d), "city": None} for i, s, t, u, d in rows])
    boards = spark.createDataFrame([(k, "lever", "employer") for k in (1, 2, 3)], "source_id long, ats string, kind string")
    got = {r.id: r.duplicate_of for r in duplicates.mark_duplicates(df, boards).collect()}
    prepared = {i: (s, t, u, d) for i, s, t, u, d in rows}
    first = [(2, 1), (4, 3), (6, 5)]
    stems = lambda u: u.replace("/en/", "/")
    sixth = []
    for i, (s, _, u, d) in prepared.items():
        group = sorted(((0 if "/en/" in x[2] else 1), x[3], j) for j, x in prepared.items() if x[0] == s and stems(x[2]) == stems(u))
        sixth.append((i, group[0][2]))
    assert {k: v for k, v in got.items() if v} == sequential(first + sorted(sixth))


KIND, ATS = {"employer": 0, "agency": 1}, {"greenhouse": 0, "jsonld": 5}


def plain_marks(rows, bilingual):
    """All seven rules, row by row."""
    rank = lambda r: (KIND[BOARDS[r["source_id"]][1]], ATS[BOARDS[r["source_id"]][0]], r["first_seen"], r["id"])
    key = lambda r: (r["company"].lower(), r["title"].lower(), (r["city"] or "").lower())
    stem = lambda r: re.sub(r"[?#].*$", "", r["url"]).rstrip("/").lower()
    code = lambda r: (re.findall(r"^https://[^/]+/(en|nl|fr)/", r["url"]) or [None])[0]
    lang_rank = lambda r: {"en": 0, None: 1, "nl": 2, "fr": 3}[code(r)]
    lang_stem = lambda r: re.sub(r"^(https://[^/]+)/(?:en|nl|fr)/", r"\1/", re.sub(r"[?#].*$", "", r["url"]))
    canonical, cities = {}, defaultdict(set)

    def root(x):
        while x in canonical:
            x = canonical[x]
        return x

    def mark(links):
        for dup, canon in sorted(links):
            if dup != canon and dup not in canonical and root(canon) != dup:
                canonical[dup] = root(canon)

    def grouped(members, of, order, wanted=lambda dup, first: True):
        groups = defaultdict(list)
        for r in members:
            groups[of(r)].append(r)
        out = []
        for g in groups.values():
            first = min(g, key=order)
            out += [(r, first) for r in g if r is not first and wanted(r, first)]
        return out

    ids = lambda pairs: [(a["id"], b["id"]) for a, b in pairs]
    mark(ids(grouped(rows, key, rank, lambda a, b: a["source_id"] != b["source_id"])))
    mark(ids(grouped(rows, lambda r: (r["source_id"], key(r), r["content_hash"], re.sub(r"[-_ ]?\(?\d{1,3}\)?$", "", stem(r))), rank)))
    mark(ids(grouped(rows, stem, rank)))
    mark(bilingual)
    # five: one text but for its cities
    unmarked = [r for r in rows if r["id"] not in canonical]
    named = defaultdict(set)
    board = lambda r: (r["source_id"], r["company"].lower(), r["title"].lower())
    for r in unmarked:
        named[board(r)] |= {r["city"].lower()} if r["city"] else set()

    def signature(r):
        text = r["description"].lower()
        for c in sorted(named[board(r)], key=lambda c: (-len(c), c)):
            text = text.replace(c, " ")
        text = re.sub(r"[\d\W_]+", " ", text).strip()
        return text[:6000] if len(text) >= 80 else None

    pairs = grouped([r for r in unmarked if signature(r)], lambda r: (*board(r), signature(r)), lambda r: (*rank(r)[:2], lang_rank(r), r["first_seen"], r["id"]))
    mark(ids(pairs))
    for dup, first in pairs:
        if dup["city"] and dup["city"] != first["city"]:
            cities[root(first["id"])].add(dup["city"])
    # six: one address but for its language
    groups = defaultdict(list)
    for r in rows:
        groups[r["source_id"], lang_stem(r)].append(r)
    mixed = [r for g in groups.values() if any(lang_rank(r) != 1 for r in g) for r in g]
    mark(ids(grouped(mixed, lambda r: (r["source_id"], lang_stem(r)), lambda r: (lang_rank(r), r["first_seen"], r["id"]))))

    def same(a, b):
        x, y = a["description"], b["description"]
        if (len(x) < 300) != (len(y) < 300) or {a["posting_language"], b["posting_language"]} == {"en", "nl"}:
            return True
        ratio = difflib.SequenceMatcher(None, re.findall(r"\w+", y.lower())[:1500], re.findall(r"\w+", x.lower())[:1500], autojunk=False).ratio()
        p, q = set(a["skills_required"]), set(b["skills_required"])
        alike = not p | q or len(p & q) / len(p | q) >= 0.8
        return ratio >= 0.9 or ratio >= 0.6 and alike and a["seniority"] == b["seniority"]

    tech = [r for r in rows if r["is_tech"] and r["id"] not in canonical]
    order = lambda r: (len(r["description"]) < 300, r["posting_language"] != "en", -r["posted_at"].timestamp(), r["id"])
    mark(ids(grouped(tech, lambda r: (r["source_id"], key(r)), order, same)))
    return {r["id"]: (root(r["id"]) if r["id"] in canonical else None, (sorted(cities[r["id"]]) or None) if r["id"] not in canonical else None) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_rules_equal_the_walk_over_rows(spark, seed):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(90)]
    rows = []
    for k in range(1, 301):
        city = rng.choice(["Delft", "Breda", "Emmen", None])
        number = rng.randrange(60)
        text = rng.choice([LONG.format(city or "town"), "stub", " ".join(words), " ".join(words[:80] + [f"x{j}" for j in range(rng.choice([3, 30, 70]))])])
        rows.append(
            dict(
                id=k, source_id=rng.randrange(1, 4), company=rng.choice(["Acme", "acme", "Bolt"]), title=rng.choice(["Welder", "Baker", "Tailor", "Miner"]), city=city,
                url=f"https://{rng.choice('ab')}.ex/{rng.choice(['', '', 'en/', 'nl/', 'fr/'])}job/p{number}x{rng.choice(['', '', '-2'])}{rng.choice(['', '?utm=1'])}",
                description=text, content_hash=f"h{rng.randrange(4)}", first_seen=dt.datetime(2026, 9, 1 + rng.randrange(20)), posted_at=dt.datetime(2026, 8, 1 + rng.randrange(9)),
                is_tech=rng.random() < 0.6, posting_language=rng.choice(["en", "en", "nl", "other"]), skills_required=rng.choice([[], ["a"], ["a", "b"]]), seniority=rng.choice(["senior", "junior"]),
            )
        )
    df, boards = open_rows(spark, rows), sources(spark)
    pairs = [(r.dup, r.canon) for r in duplicates.bilingual(duplicates.prepared(df, boards)).collect()]
    got = {r.id: (r.duplicate_of, r.also_in) for r in duplicates.mark_duplicates(df, boards).collect()}
    want = plain_marks(rows, pairs)
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_no_postings(spark):
    assert duplicates.mark_duplicates(open_rows(spark, [{"id": 1, "url": "https://x/1", "closed_at": dt.datetime(2026, 9, 2)}]), sources(spark)).count() == 0


def test_titles_without_their_city_need_no_pattern_for_names_they_do_not_hold(spark):
    rows = [("Cook in The Hague", "The Hague", "cook"), ("Cook - Den Haag", "The Hague", "cook"), ("Delft", "Delft", "delft"), ("Delfter cook", "Delft", "delfter cook"), ("Cook", None, "cook"), (None, "Delft", ""), ("Cook", "", "cook")]
    df = spark.createDataFrame(rows, "title string, city string, want string")
    assert df.withColumn("got", duplicates.title_without_city(functions.col("title"), functions.col("city"))).where("not got <=> want").collect() == []


def test_rules_read_stored_rows(spark, monkeypatch):
    kept, plain = [], duplicates.stored
    monkeypatch.setattr(duplicates, "stored", lambda df: kept.append(df.columns) or plain(df))
    postings = spark.sql("select id, cast(id % 2 as int) source_id, 'A' company, concat('Cook ', id) title, 'Delft' city, concat('https://a.nl/', id) url, timestamp_ntz'2001-01-01' first_seen, timestamp_ntz'2001-01-01' posted_at, cast(null as timestamp_ntz) closed_at, true is_tech, 'en' posting_language, array('x') skills_required, array('x') also_in, 'junior' seniority, 1 years_experience, 'it' role_family, repeat('words and words ', 9) description, 'h' content_hash from range(6)")
    sources = spark.sql("select cast(id as int) source_id, 'lever' ats, 'employer' kind from range(2)")
    assert duplicates.mark_duplicates(postings, sources).count() == 6
    assert {"key", "description"} <= set(kept[0]) and "key" in kept[1] and "description" not in kept[1]
    assert any("signature" in columns for columns in kept)
