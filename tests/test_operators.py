"""Lifecycle, duplicates, adapters, reports and streams on small inputs."""

import datetime as dt
import difflib
import json
import random
import re

from pyspark.sql import functions as F

from tidemark.operators import clicks, duplicates, ingest, matching, quality, stats
from tidemark.sources import boards, standin
from tidemark.streaming import clicks as streaming

NOW = "2026-09-30 12:00:00"
SF = "/root/testdata/sf0.001"
POSTING = "source_id long, external_id string, title string, company string, city string, country string, remote boolean, url string, description string, posted_at timestamp_ntz, valid_through timestamp_ntz, content_hash string, dedup_key string"


def posting(number, source=1, text="A long enough text about the work that has to be done here.", country="NL", url=None, valid=None):
    return (source, str(number), f"Job {number}", "Acme", "Delft", country, False, url or f"https://x/{number}", text, None, valid, str(hash((number, text))), f"k{number}")


def crawl(spark, state, rows, sources, as_of=NOW):
    snapshot = spark.createDataFrame(rows, POSTING)
    merged = ingest.merge(state, snapshot, sources, as_of)
    counts = {r.source_id: r for r in ingest.counters(merged, snapshot, sources, as_of).collect()}
    return merged, counts[1]


def boards_of(spark, last_count=0):
    return spark.createDataFrame([(1, last_count)], "source_id long, last_nl_count int")


def empty_state(spark):
    return spark.createDataFrame([], POSTING + ", first_seen timestamp_ntz, last_seen timestamp_ntz, closed_at timestamp_ntz")


def test_lifecycle(spark):
    sources = boards_of(spark)
    one, c = crawl(spark, empty_state(spark), [posting(1), posting(2), posting(3, country="XX")], sources)
    assert (c.new, c.updated, c.closed, c.seen, c.foreign, c.partial, c.expired) == (2, 0, 0, 2, 1, False, 0)
    two, c = crawl(spark, one.drop("change"), [posting(1, text="Another text that is also long enough to count as one, yes.")], sources, "2026-10-01 12:00:00")
    assert (c.updated, c.closed) == (1, 1)
    three, c = crawl(spark, two.drop("change"), [posting(1, text="Another text that is also long enough to count as one, yes."), posting(2)], sources, "2026-10-02 12:00:00")
    assert (c.new, c.closed) == (0, 0)
    rows = {r.external_id: r for r in three.collect()}
    assert rows["2"].closed_at is None and rows["2"].change == "reopened" and rows["1"].first_seen == dt.datetime(2026, 9, 30, 12)


def test_changed_id_lost_text_and_guards(spark):
    sources = boards_of(spark)
    one, _ = crawl(spark, empty_state(spark), [posting("TNO", url="https://x/page")], sources)
    two, c = crawl(spark, one.drop("change"), [posting("https://x/page", url="https://x/page", text="gone")], sources)
    row = two.collect()
    assert len(row) == 1 and (c.new, c.closed) == (0, 0) and row[0].description.startswith("A long")
    many, _ = crawl(spark, empty_state(spark), [posting(k) for k in range(20)], boards_of(spark))
    _, c = crawl(spark, many.drop("change"), [posting(k) for k in range(2)], boards_of(spark, 20))
    assert c.partial and c.closed == 0
    _, c = crawl(spark, many.drop("change"), [posting(k) for k in range(12)], boards_of(spark, 20))
    assert not c.partial and c.closed == 8
    past = dt.datetime(2026, 9, 27)
    _, c = crawl(spark, empty_state(spark), [posting(1), posting(2, valid=past)], sources)
    assert (c.new, c.expired) == (1, 1)
    _, c = crawl(spark, empty_state(spark), [posting(k, valid=past) for k in range(6)], sources)
    assert (c.new, c.expired) == (6, 0)


def open_rows(spark, rows):
    schema = "id long, source_id long, company string, title string, city string, url string, description string, content_hash string, first_seen timestamp_ntz, posted_at timestamp_ntz, closed_at timestamp_ntz, also_in array<string>, is_tech boolean, posting_language string, skills_required array<string>, skills_nice array<string>, seniority string, years_experience int, role_family string"
    at = dt.datetime(2026, 9, 1)
    full = []
    for r in rows:
        base = dict(source_id=1, company="Acme", title="Engineer", city="Delft", description=f"text {r['id']}", content_hash=f"h{r['id']}", first_seen=at + dt.timedelta(hours=r["id"]), posted_at=at, closed_at=None, also_in=None, is_tech=False, posting_language="en", skills_required=[], skills_nice=[], seniority="senior", years_experience=None, role_family="data")
        base |= r
        full.append(tuple(base[f.split()[0]] for f in schema.split(", ")))
    return spark.createDataFrame(full, schema)


def marked(spark, rows, ats={1: "greenhouse", 2: "jsonld"}):
    sources = spark.createDataFrame([(k, a, "employer") for k, a in ats.items()], "source_id long, ats string, kind string")
    return {r.id: (r.duplicate_of, r.also_in) for r in duplicates.mark_duplicates(open_rows(spark, rows), sources).collect()}


def test_cross_source_prefers_the_ats_copy(spark):
    got = marked(spark, [{"id": 1, "source_id": 2, "title": "Data Engineer", "url": "https://a/1"}, {"id": 2, "source_id": 1, "title": "Data Engineer (m/f/d)", "url": "https://b/2"}])
    assert got[1][0] == 2 and got[2][0] is None


def test_addresses_and_languages(spark):
    rows = [{"id": 1, "url": "https://x/job/339", "title": "A"}, {"id": 2, "url": "https://x/fr/job/339", "title": "B"}, {"id": 3, "url": "https://x/en-gb/job/339", "title": "C"}, {"id": 4, "url": "https://x/job/400", "title": "D"}, {"id": 5, "url": "https://x/job/400?utm=1", "title": "E"}]
    got = marked(spark, rows)
    assert got[1][0] == got[2][0] == 3 and got[3][0] is None and got[5][0] == 4


def test_cities_fold_into_one(spark):
    base = "We are looking for an engineer who likes to work with people and machines in {} every day of the week, all year."
    rows = [{"id": k, "url": f"https://x/{c}", "city": c, "description": base.format(c)} for k, c in enumerate(["Zwolle", "Emmen", "Assen"], 1)]
    rows.append({"id": 9, "url": "https://x/other", "city": "Breda", "title": "Designer", "description": base.format("Breda")})
    got = marked(spark, rows)
    assert got[1] == (None, ["Assen", "Emmen"]) and got[2][0] == got[3][0] == 1 and got[9][0] is None


def test_same_board_rule(spark):
    long = " ".join(f"word{k}" for k in range(200))
    rows = [{"id": 1, "url": "https://x/a1b", "is_tech": True, "description": long}, {"id": 2, "url": "https://x/c2d", "is_tech": True, "description": long.replace("word7 ", "other ")}, {"id": 3, "url": "https://x/e3f", "is_tech": True, "description": " ".join(f"x{k}" for k in range(200))}]
    got = marked(spark, rows)
    assert sorted(k for k, v in got.items() if v[0]) == [2] or sorted(k for k, v in got.items() if v[0]) == [1]
    assert got[3][0] is None


def test_same_board_words_and_skills(spark):
    long = [f"word{k}" for k in range(200)]
    changed = " ".join([*long[:140], *(f"other{k}" for k in range(60))])
    text, loud = " ".join(long), "* " + ", ".join(w.upper() for w in long)
    pair = lambda k, city, one, two: [{"id": k, "url": f"https://x/{city}a", "city": city, "is_tech": True} | one, {"id": k + 1, "url": f"https://x/{city}b", "city": city, "is_tech": True} | two]
    rows = [
        *pair(1, "Delft", {"description": text}, {"description": loud, "seniority": "junior"}),
        *pair(3, "Breda", {"description": text}, {"description": changed}),
        *pair(5, "Emmen", {"description": text}, {"description": changed, "seniority": "junior"}),
        *pair(7, "Assen", {"description": text, "skills_required": ["a"], "skills_nice": ["b", "c"]}, {"description": changed, "skills_required": ["a"], "skills_nice": ["d"]}),
        *pair(9, "Venlo", {"description": text, "skills_required": ["a"]}, {"description": changed, "skills_nice": ["a"]}),
    ]
    found = {frozenset((r.dup, r.canon)) for r in duplicates.same_board(duplicates.prepared(open_rows(spark, rows), spark.createDataFrame([(1, "lever", "employer")], "source_id long, ats string, kind string"))).collect()}
    assert found == {frozenset(p) for p in ((1, 2), (3, 4), (7, 8))}


def test_roots_follow_chains(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], "dup long, canon long")
    assert {r.dup: r.root for r in duplicates.resolve_roots(links).collect()} == {5: 1, 4: 1, 3: 1, 2: 1, 9: 8}


def landing_row(spark, payload):
    return spark.createDataFrame([(7, "acme", payload)], "source_id long, slug string, payload string")


def test_board_payloads(spark):
    got = boards.greenhouse(landing_row(spark, json.dumps({"jobs": [{"id": 12, "title": "T", "absolute_url": "u", "offices": [{"location": "Delft"}, {"name": "Breda"}], "updated_at": "2024-05-01T10:00:00Z"}]}))).first()
    assert (got.external_id, got.location, str(got.posted_at)) == ("12", "Delft, Breda", "2024-05-01 10:00:00")
    got = boards.lever(landing_row(spark, json.dumps([{"id": "a", "text": "T", "applyUrl": "u", "categories": {"allLocations": ["X", "Y"]}, "workplaceType": "Remote", "descriptionPlain": "d", "lists": [{"text": "L", "content": "<li>one</li>"}], "createdAt": 1700000000000}]))).first()
    assert (got.location, got.remote, got.description_text, str(got.posted_at)) == ("X, Y", True, "d\nL\none", "2023-11-14 22:13:20")
    got = boards.ashby(landing_row(spark, json.dumps({"jobs": [{"id": "b", "location": "X", "secondaryLocations": [{"location": "Y"}], "isRemote": False}]}))).first()
    assert (got.location, got.remote) == ("X; Y", None)
    assert [r.external_id for r in boards.recruitee(landing_row(spark, json.dumps({"offers": [{"id": 1, "status": "draft"}, {"id": 2, "country_code": "nl"}]}))).collect()] == ["2"]
    got = boards.workable(landing_row(spark, json.dumps({"jobs": [{"shortcode": "s", "country": "Netherlands", "city": "Delft", "telecommuting": True}]}))).first()
    assert (got.country, got.city, got.remote) == ("NL", "Delft", True)
    got = boards.amazon(landing_row(spark, json.dumps({"jobs": [{"id_icims": "9", "country_code": "NLD", "posted_date": "May 1, 2024"}, {"id_icims": "9"}]}))).collect()
    assert len(got) == 1 and str(got[0].posted_at)[:10] in ("2024-05-01", "None")
    xml = "<jobs><position><id>1</id><name>N</name><office>Delft</office><jobDescriptions><jobDescription><value>a</value></jobDescription><jobDescription><value>b</value></jobDescription></jobDescriptions></position><position><id></id><name>x</name></position></jobs>"
    got = boards.personio(landing_row(spark, xml)).collect()
    assert [(r.external_id, r.url, r.description_html) for r in got] == [("1", "https://acme.jobs.personio.de/job/1", "a\nb")]
    got = boards.sitemap_urls(landing_row(spark, "<loc>https://x/jobs/1</loc><loc>https://x/about</loc><loc>https://x/jobs/1/apply</loc>")).collect()
    assert [r.url for r in got] == ["https://x/jobs/1"]
    lines = spark.createDataFrame([("https://jobs.lever.co/acme/1",), ("https://jobs.lever.co/acme",), ("https://jobs.lever.co/api",)], "line string")
    assert [r.slug for r in boards.slugs_from_text(lines, "lever").collect()] == ["acme"]


def test_salary_quartiles(spark):
    rows = spark.createDataFrame([(k, None) for k in (1, 2, 3, 4, 10)], "salary_min_eur long, salary_max_eur long")
    got = stats.salary(rows).first()
    assert (got.n, got.p25, got.median, got.p75, got.min, got.max) == (5, 2, 3, 7, 1, 10)
    few = stats.salary(rows.limit(2)).first()
    assert (few.n, few.p25, few.median, few.p75) == (2, 1, 2, 2) and stats.salary(rows.limit(0)).first().n == 0


def test_sessions_gap_is_strict(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, "v", at + dt.timedelta(minutes=m), "page", None, False) for k, m in enumerate((0, 30, 61, 200))]
    views = spark.createDataFrame(rows, "event_id long, visitor string, ts timestamp_ntz, kind string, event string, bot boolean")
    assert sorted(r.pages for r in clicks.sessions(views).collect()) == [1, 1, 2]


def test_tracker_and_sample(spark):
    postings = spark.createDataFrame([(1, "NS Groep", "Data Engineer", None, None), (2, "Dienstverlening", "Kok", None, None), (3, "Acme Robotics", "Software Developer", None, None)], "id long, company string, title string, closed_at timestamp_ntz, duplicate_of long")
    sources = spark.createDataFrame([("Globex", "globex", "lever", 4)], "source_company string, slug string, ats string, last_nl_count int")
    entries = spark.createDataFrame([("Railways", ["ns"]), ("Globex", ["globex"]), ("None", ["initech"])], "name string, match array<string>")
    assert {r.name: (r.status, r.live_postings) for r in matching.tracker(entries, postings, sources).collect()} == {"Railways": ("covered", 1), "Globex": ("registered", 4), "None": ("missing", 0)}
    sample = spark.createDataFrame([(1, "Software Developer (m/f)", "Acme Robotics B.V."), (2, "Baker", "Acme Robotics"), (3, "x", "Globex")], "id long, title string, company string")
    got = {r.id: (r.employer_known, r.matched_id) for r in matching.match_sample(sample, postings).collect()}
    assert got == {1: (True, 3), 2: (True, None), 3: (False, None)}


def test_link_guard(spark):
    rows = spark.createDataFrame([(1, "gone")] * 4 + [(2, "gone"), (2, "ok")], "source_id long, link_status string")
    assert {r.source_id: (r.flagged, r.closed) for r in quality.link_guard(rows).collect()} == {1: (True, 0), 2: (False, 1)}


def test_streams_agree_with_batch(spark, tmp_path):
    views = standin.page_views(spark, SF)
    source = str(tmp_path / "in")
    views.write.parquet(source)
    stream = streaming.read_views(spark, source, views.schema)
    streaming.write_rollup(stream, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    days = views.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    want = clicks.rollup(views, str(days[0]), str(days[1]))
    got = spark.read.parquet(str(tmp_path / "out/daily")).select(*want.columns)
    key = lambda df: sorted((str(r.day), r.dim, r.key, r.hits, r.humans, r.uniques) for r in df.collect())
    assert key(got) == key(want)
    timed = streaming.with_event_time(stream, "1 hour")
    streaming.write_once(streaming.hourly(timed), str(tmp_path / "hours"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "hours")).count() > 0
    streaming.write_once(streaming.live_sessions(timed), str(tmp_path / "sessions"), str(tmp_path / "c3")).awaitTermination()
    final = spark.read.parquet(str(tmp_path / "sessions")).count()
    assert 0 < final <= clicks.sessions(views).count()


def bilingual_by_hand(rows, threshold=0.55, lone=0.45):
    """Rule 4 row by row, over plain dictionaries."""
    words = {"defensie": "defence", "onderzoeker": "researcher", "stage": "internship", "ingenieur": "engineer", "netwerk": "network"}

    def language(r):
        found = re.match(r"https?://[^/]+/(en|nl)(?:-[a-z]{2})?(?:/|$)", r["url"], re.I)
        return found and found[1].lower()

    def title(r):
        bare = re.sub(r"^(stage|internship|afstudeerstage|graduation internship|vacature|vacancy)\s*[|:–-]\s*", "", r["title"].lower()).replace("&amp;", "&")
        return " ".join(words.get(w, w) for w in re.findall(r"[a-z0-9àáäéèëïíóöüú]+", bare))

    out = set()
    for source in {r["source_id"] for r in rows}:
        own = [r for r in rows if r["source_id"] == source]
        seen = {language(r) for r in own}
        english = {"en"} if "en" in seen else {None}
        pairs = []
        for n in own:
            for e in own:
                if language(n) == "nl" and language(e) in english and all((n[c] or "") == (e[c] or "") for c in ("company", "city")) and n["posted_at"].date() == e["posted_at"].date():
                    a, b = (set(re.findall(r"\d[\d.,]*\d|\d{2,}", x["description"])) for x in (n, e))
                    t, k = difflib.SequenceMatcher(None, title(n), title(e)).ratio(), len(a & b) / max(len(a | b), 1)
                    score = 0.6 * t + 0.4 * k
                    if (t >= 0.45 or k >= 0.9) and score >= lone:
                        pairs.append((score, n["id"], e["id"]))
        alone = lambda p: sum(q[1] == p[1] for q in pairs) == 1 and sum(q[2] == p[2] for q in pairs) == 1
        used = set()
        for p in sorted((p for p in pairs if p[0] >= threshold or alone(p)), reverse=True):
            if not used & {p[1], -p[2]}:
                used |= {p[1], -p[2]}
                out.add(p[1:])
    return out


def bilingual_pairs(spark, rows):
    sources = spark.createDataFrame([(k, "lever", "employer") for k in range(5)], "source_id long, ats string, kind string")
    return {(r.dup, r.canon) for r in duplicates.bilingual(duplicates.prepared(open_rows(spark, rows), sources)).collect()}


def test_bilingual_titles_without_numbers(spark):
    rows = [
        {"id": 1, "url": "https://x/nl/a", "title": "Stage | Onderzoeker defensie", "description": "geen getal"}, {"id": 2, "url": "https://x/en/b", "title": "Internship - Researcher defence", "description": "no number"},
        {"id": 3, "source_id": 2, "url": "https://y/nl/a", "title": "Netwerk ingenieur", "description": "36 uur"}, {"id": 4, "source_id": 2, "url": "https://y/jobs/b", "title": "Network engineer", "description": "40 hours, 2.500"},
        {"id": 5, "source_id": 3, "url": "https://z/nl/a", "title": "Kok", "description": "geen"}, {"id": 6, "source_id": 3, "url": "https://z/en/a", "title": "Director of finance", "description": "none"},
    ]
    assert bilingual_pairs(spark, rows) == {(1, 2), (3, 4)}


def test_bilingual_equals_brute_force(spark):
    draw = random.Random(4)
    titles = ["Stage | Onderzoeker radar", "Internship: researcher radar", "Netwerk ingenieur", "Network engineer", "Scheepskwetsbaarheid", "Ship Vulnerability", "Vacature - Data ingenieur R&amp;D", "Data engineer R&D", "Kok", "Cook"]
    languages = {0: ["/nl", "/en", "/en-gb", ""], 1: ["/nl", "", "/NL-be"], 2: ["/en", ""], 3: ["/nl", "/en"]}
    rows = []
    for k in range(1, 241):
        source = draw.randrange(4)
        at = dt.datetime(2026, 9, 1 + draw.randrange(2), draw.randrange(24))
        text = " ".join(draw.choice(["36", "40", "2.500", "3.100,50", "7", "2026", "uur"]) for _ in range(draw.randrange(5)))
        rows.append({"id": k, "source_id": source, "url": f"https://x{source}{draw.choice(languages[source])}/job/{k}", "title": draw.choice(titles), "city": draw.choice(["Delft", "", None]), "company": draw.choice(["Acme", "Globex"]), "posted_at": at, "description": text})
    got = bilingual_pairs(spark, rows)
    assert got == bilingual_by_hand([{"company": "Acme"} | r for r in rows]) and len(got) > 20


def test_names_inside_names(spark):
    rows = [(1, "Philips Lighting"), (2, "Philipslighting"), (3, "Bookingcom"), (4, "IJsbooking"), (5, "ING Bank"), (6, "Stingray"), (7, ""), (8, "Ahold")]
    postings = spark.createDataFrame([(k, c, "Data Engineer", None, None) for k, c in rows], "id long, company string, title string, closed_at timestamp_ntz, duplicate_of long")
    names = ["Philips", "Booking", "Stingrays of Delft", "ING", "Koninklijke Aholdconcern", "", "Globex"]
    sample = spark.createDataFrame([(k, "Data Engineer", c) for k, c in enumerate(names)], "id long, title string, company string")
    got = {names[r.id]: (r.employer_known, r.matched_id) for r in matching.match_sample(sample, postings).collect()}
    plain = [(k, c.lower()) for k, c in rows]
    inside = lambda a, b: bool(a and b) and (a == b or len(a) >= 5 and a in b or len(b) >= 5 and b in a)
    want = {n: min((k for k, c in plain if inside(n.lower(), c)), default=None) for n in names}
    assert got == {n: (k is not None, k) for n, k in want.items()} and want["Philips"] == 1 and want["Booking"] == 3


def test_sectors_from_own_words(spark):
    job = "Requirements\n" + "- lending, bank and pension code, day after day\n" * 60
    about = "About us\nAcme runs a hospital and cares for patients."
    rows = [
        (1, "Acme", job + about, True, None), (2, "Bolt", "You will build software for a bank with insurance.\n" + about, True, None), (3, "Cure", "Cure develops vaccines.", True, None), (4, "Care", "Care helps people.", True, None),
        *((k, "Dyn", "Dyn is a bank that sells insurance.", False, None) for k in range(5, 10)), (10, "Dyn", "Dyn is a bank that sells insurance.", True, 5), (11, "Dyn", "Dyn is a hospital for patients.", True, None), (12, "Gone", "x", False, None),
    ]
    postings = spark.createDataFrame([(k, 1, *r, None) for k, *r in rows], "id long, source_id long, company string, description string, is_tech boolean, duplicate_of long, closed_at timestamp_ntz")
    sources = spark.createDataFrame([(1, "employer")], "source_id long, kind string")
    fragments = spark.createDataFrame([("cure", "health"), ("care", "health")], "fragment string, sector string")
    found = matching.sectors(postings, sources, spark.createDataFrame([], "company string, sector string"), fragments, {"finance": "bank|insurance|lending|pension", "health": "hospital|patients"}).collect()
    assert {r.company: (r.sector, r.found_by) for r in found} == {"Acme": ("health", "text"), "Bolt": ("health", "text"), "Cure": ("pharma", "list+text"), "Care": ("health", "list"), "Dyn": ("health", "text")}
