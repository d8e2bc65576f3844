"""Sections, years asked for and visa statements: typed answers, and a plain walk over lines."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import requirements, spans
from tidemark.operators import sections

PIECES = [
    "What you will do", "Requirements:", "## About us", "Benefits", "Who you are", "Over ons", "* De functie", "Our mission", "", "   ", "We are a leading maker of pumps.", "Acme is a bakery", "- Python", "1. SQL",
    "You have experience with pipes.", "Lorem ipsum dolor sit amet.", "A line without an end", "You'll build things with us.", "Kennis van lassen is een pre.", "Our company, an old one, is the best in town.", "x" * 120,
    "Requirements for people who have never read a requirement before today, honestly", "Interested?", "Your profile;", "Some prose of the firm. Wij zijn groot.",
]


def walk(text, visit):
    section = "intro"
    for line in re.split(sections.LINE_END, text)[: -1 if text.endswith("\n") or not text else None]:
        section = visit(line, section) or section


def header(line):
    bare = line.strip().strip(sections.BULLETS).strip()
    if not bare or len(bare) > 70 or len(bare.split()) > 9 or bare[-1] in ".,;":
        return None
    bare = bare.rstrip(":?! ")
    return "company" if re.search(sections.COMPANY, bare, re.I) else "job" if re.search(sections.JOB, bare, re.I) else None


def plain_job_text(text):
    kept, heads = [], []

    def visit(line, section):
        kind, bare = header(line), line.strip()
        heads.append(kind)
        short = bool(bare) and (re.match(sections.ENTRY, line) or len(bare) < 100 and bare[-1] not in ".!?")
        if kind == "job" or kind is None and (section == "job" or re.search(sections.ASKS, line, re.I) or section == "intro" and (re.search(sections.ROLE_CUE, line, re.I) or short)):
            kept.append(line)
        return kind

    walk(text, visit)
    return "\n".join(kept) if "job" in heads and any(k.strip() for k in kept) else None


def plain_intro(company, text, limit):
    kept, name = [], ([*(company or "").split(), ""])[0].lower()

    def visit(line, section):
        t = line.strip()
        if not t or sum(map(len, kept)) > limit:
            return None
        if re.search(sections.ABOUT, t.strip("#*•-–: ").rstrip(":?! "), re.I):
            return "about"
        if header(t):
            return "other"
        own = section == "about" or section == "intro" and not re.search(sections.ROLE_CUE, t, re.I)
        if own or re.search(sections.SELF, t, re.I) and (name in t.lower() or re.search(r"\b(?:wij|we|ons|our)\b", t, re.I)):
            kept.append(t)
        return None

    walk(text, visit)
    return "\n".join(kept)[:limit] or None


def test_sections_equal_a_walk_over_lines(spark):
    rng = random.Random(2)
    texts = [(k, rng.choice(["Acme Ltd", "", None, "Our"]), rng.choice(["\n", "\r\n"]).join(rng.choices(PIECES, k=rng.randrange(0, 25)))) for k in range(200)] + [(900, "Acme", None), (901, "Acme", "")]
    df = spark.createDataFrame(texts, "id long, company string, text string").withColumn("line", F.lit(1)).drop("line")
    got = {r.id: r.job_text for r in sections.job_text(df, ["id"]).collect()}
    want = {k: plain_job_text(t or "") for k, _, t in texts}
    assert got == {k: v for k, v in want.items() if v is not None}
    got = {r.id: r.intro for r in sections.self_description(df, ["id"], F.col("company"), limit=150).collect()}
    want = {k: plain_intro(c, t or "", 150) for k, c, t in texts}
    assert got == {k: v for k, v in want.items() if v is not None}
    assert sections.job_text(df.limit(0), ["id"]).count() == 0


def test_spans_have_places_and_surroundings(spark):
    rows = [("ab12cd345e6",), ("none",), ("",), (None,), ("é9ü",)]
    got = [r[0] and [tuple(s) for s in r[0]] for r in spark.createDataFrame(rows, "t string").select(spans.spans(F.col("t"), "[0-9]+", 2, 3)).collect()]
    want = [[(m.start(), m.end(), m[0], t[max(0, m.start() - 2) : m.start()], t[m.end() : m.end() + 3]) for m in re.finditer("[0-9]+", t)] for (t,) in rows if t is not None]
    assert [g for g in got if g is not None] == [w for w in want if w] or [g or [] for g in got if g is not None] == want
    assert got[3] is None


YEARS = [
    ("Minimaal 5 jaar ervaring met beheer", 5, "5+"), ("about 3–6 years of relevant experience", 3, "3-6"), ("1 to 3 years of professional experience", 1, "1-3"), ("drie tot vijf jaar ervaring als bakker", 3, "3-5"),
    ("2,5 jaar werkervaring", 3, "2.5"), ("minimaal een half jaar ervaring", 1, "0.5+"), ("three (3) years of experience", 3, "3"), ("6 months to 3 years of experience", 1, None), ("anderhalf jaar ervaring", 2, "1.5"),
    ("7+ years of backend experience", 7, "7+"), ("a 3-year experience in sewing", 3, "3"), ("obtain it within the first two years; some experience", None, None), ("0 tot 2 jaar ervaring", None, None),
    ("a 4-year bachelor's degree and relevant experience", None, None), ("Contract: 2 years, experience with Python", None, None), ("You are 18 years or older and have experience", None, None),
    ("with 90 years of experience in the trade", None, None), ("€3k after 2 years and a bonus", None, None), ("we have 12 years of experience; you bring 4 years of experience", 4, "4"), ("", None, None), (None, None, None),
]


def test_years_asked_for(spark):
    df = spark.createDataFrame(YEARS, "t string, years int, worded string")
    got = df.select("t", "years", "worded", requirements.find_years(F.col("t")).alias("y"), requirements.years_text(F.col("t")).alias("w")).where("not (y <=> years and w <=> worded)").collect()
    assert got == []


VISA = [
    ("We offer visa sponsorship and a laptop.", True), ("You must already have the right to work in the Netherlands.", False), ("Relocation support is not offered for this role.", False), ("Wij bieden geen visa sponsorship aan.", False),
    ("Our relocation team assists you when moving here.", True), ("Visa sponsorship may be available. We do not provide relocation support.", True), ("VISA Sponsorship:\n\nTravel:\n", None), ("VISA Sponsorship:\nNo\nTravel:\n", False),
    ("VISA sponsorship: yes", True), ("we sponsor the local chess club", None), ("we don’t offer any visa sponsorship", False), ("We cannot sponsor visas.", False), ("If you don't have an EU passport, we can sponsor your visa.", True),
    ("Not only do we offer visa sponsorship, we also pay your flight.", True), ("Candidates with a valid work permit are preferred.", None), ("EU citizenship required.", False), ("The 30% ruling may apply.", True), ("Relocation package!", True),
    ("", None), (None, None),
]


def test_visa_statements(spark):
    df = spark.createDataFrame(VISA, "t string, want boolean")
    assert df.withColumn("got", requirements.detect_visa(F.col("t"))).where("not got <=> want").collect() == []


DEGREES = [
    ("Cook", "You have a completed hbo or wo education.", "hbo"), ("Cook", "You have a Bachelor's or Master's degree.", "bsc"), ("Cook", "You hold a Master's degree; a PhD is a plus.", "msc"), ("Cook", "You have a PhD in physics.", "phd"),
    ("Cook", "A degree is not required, skills matter.", "none"), ("Cook", "Nice to have: fluency. A bachelor's degree in CS.", "bsc"), ("PhD position", "This PhD project is about robots. You have an MSc in mechanics.", "msc"), ("Postdoc in X", "Work with four other PhD's.", "phd"),
    ("Cook", "HBO level, or an MBO 4 background combined with long experience", "hbo"), ("Cook", "BS degree in engineering is a plus", "unknown"), ("Scrum Master", "As Scrum Master you coach teams.", "unknown"), ("Cook", "4 years of relevant experience (or PhD)", "unknown"),
    ("Cook", "Supervising bachelor students and transcripts of your MSc", "unknown"), ("Cook", "MBO-4, hbo is een pre", "mbo"), ("Cook", "A degree in Computer Science", "unknown"), ("Cook", "", "unknown"), (None, None, "unknown"),
]


def test_degrees_asked_for(spark):
    df = spark.createDataFrame(DEGREES, "title string, t string, want string").withColumn("core", F.lit(None).cast("string"))
    assert df.withColumn("got", requirements.detect_degree(F.col("title"), F.col("core"), F.col("t"))).where("not got <=> want").select("t", "want", "got").collect() == []
    part = df.limit(1).select(requirements.detect_degree(F.col("title"), F.lit("An MSc degree."), F.lit("Our people have an MBO diploma. An MSc degree.")).alias("d"))
    assert part.first().d == "msc"


@pytest.mark.parametrize("text", ["3 years of experience. " * 300, "visa " * 2000, "no " * 3000 + "visa sponsorship"])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(requirements.find_years(F.col("t")), requirements.detect_visa(F.col("t"))).first()
    assert row[0] == (3 if "years" in text else None) and row[1] == (False if "sponsorship" in text else None)


def test_lines_are_cut_after_texts_have_been_dealt_over_tasks(spark):
    texts = spark.range(50).selectExpr("id", "concat('Requirements', char(10), '- Python ', id) as text").coalesce(1)
    for found in (sections.job_text(texts, ["id"]), sections.self_description(texts, ["id"], F.lit("Acme"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        last = plan[plan.rindex("Generate") :]
        assert "Exchange hashpartitioning(id" in last and plan.count("Exchange hashpartitioning(id") == 1  # below the cut, and nowhere above it


def test_patterns_are_led_by_all_letters_that_fold_and_white_space_is_unicodes(spark):
    points = spark.range(1, 0x10000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    letters = "abcdefghijklmnopqrstuvwxyzé"
    led = [F.rlike("c", F.lit(f"(?iuU){x}")) != F.rlike("c", F.lit("(?iuU)" + spans.led(x, x))) for x in letters]
    assert points.select(*(F.max(e.cast("int")).alias(f"e{k}") for k, e in enumerate(led))).first() == (0,) * len(led)
    assert points.where((F.concat(F.lit("a"), sections._strip(F.concat("c", F.lit("b"), "c"))) == "ab") != F.rlike("c", F.lit(r"(?U)\s"))).count() == 0


@pytest.mark.parametrize("name", ["YEARS", "VISA", "MOVING", "NO_VISA", "ANCHOR", "NO_DEGREE", "DEGREE_WORD", *requirements.DEGREES, "ROLE_CUE", "SELF", "ASKS"])
def test_led_patterns_find_what_the_plain_ones_find(spark, name):
    """Against the same pattern without what leads it, over pieces of the pattern and statements run together."""
    led = requirements.DEGREES.get(name) or getattr(requirements, name, None) or getattr(sections, name)
    plain = "(?iuU)" + led[led.index("(?:", led.index("))(?:") + 2) :]
    rng, pieces = random.Random(3), [t for t, *_ in YEARS + VISA if t] + [t for _, t, _ in DEGREES if t] + PIECES + re.findall(r"[\w' ]+", plain)
    texts = [(rng.choice(["", " ", ", ", "\n"]).join(rng.choices(pieces, k=4)),) for _ in range(1500)]
    texts += [(t.upper(),) for (t,) in texts[:300]] + [(t.replace("s", "ſ").replace("i", "ı").replace("k", "K"),) for (t,) in texts[:300]]
    found = lambda p: F.regexp_extract_all("t", F.lit(p), F.lit(0))
    rows = spark.createDataFrame(texts, "t string").select(found(plain).alias("want"), found("(?iuU)" + led.removeprefix("(?iuU)")).alias("got"))
    assert rows.where("want <> got").count() == 0 and rows.where("size(want) > 0").count() > 0
