"""Column functions on single values."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import agents, normalize, positions, skills, text
from tidemark.operators import duplicates, landing
from tidemark.operators.rows import by_distinct


def values(spark, function, inputs):
    rows = [(k, *(i if isinstance(i, tuple) else (i,))) for k, i in enumerate(inputs)]
    width = len(rows[0])
    df = spark.createDataFrame(rows, ", ".join(["k int", *(f"c{n} string" for n in range(1, width))]))
    return [r.v for r in df.select("k", function(*(F.col(f"c{n}") for n in range(1, width))).alias("v")).orderBy("k").collect()]


def test_places(spark):
    assert values(spark, normalize.detect_city, ["Amsterdam, Netherlands", "Veldhoven", "Den Haag", "'s-Hertogenbosch, NL", "Berlin, Germany"]) == ["Amsterdam", "Eindhoven", "The Hague", "'s-Hertogenbosch", None]
    assert values(spark, normalize.detect_country, [("Utrecht, the Netherlands", None), ("Remote - Netherlands", None), ("Berlin", None), ("Somewhere", None), ("Berlin", "nl")]) == ["NL", "NL", "XX", None, "NL"]
    assert values(spark, lambda c: normalize.is_remote(c, F.lit(None).cast("boolean")), ["Remote (NL)", "Amsterdam"]) == [True, False]
    assert values(spark, normalize.plausible_place, ["Alphen aan den Rijn, Zuid-Holland, Nederland", "2 Locations", "harderwijk"]) == ["Alphen aan den Rijn", None, "Harderwijk"]
    assert values(spark, normalize.city_from_text, [(None, "Standplaats: Eindhoven. Wij zoeken"), ("Data Engineer Utrecht", ""), ("x", "y")]) == ["Eindhoven", "Utrecht", None]


def test_titles_and_keys(spark):
    assert values(spark, normalize.norm_title, ["Senior Backend Engineer (m/f/d) - Python"]) == ["senior backend engineer python"]
    keys = values(spark, normalize.dedup_key, [("Adyen B.V.", "Backend Engineer", "Amsterdam"), ("Adyen", "backend engineer", "amsterdam"), ("Other", "x", None)])
    assert keys[0] == keys[1] != keys[2]
    assert values(spark, landing.slugify, ["Foo & Bar B.V.", "!!!"]) == ["foo-bar-b-v", "company"]
    found = values(spark, positions.position, ["Test Automation Engineer", "Data-analist", "SAP ABAP Developer", "AI Translator", "Creative Director (CGI/AI)", "Senior Frontend Developer", "Kok", "PhD candidate", "Automation Engineer", None])
    assert found == ["qa_test", "bi_analyst", "software_engineer", "ml_engineer", "other", "frontend", "other", "phd_research", "plc_automation", "other"]


def test_contact_and_times(spark):
    out = values(spark, normalize.scrub_contact, ["Mail jan.p@x.nl or call +31 6 12 34 56 78, 020 1234567. Salary 3.000 - 4.000, 2024, 01-02-2024, 1012 AB"])[0]
    assert out.count("[e-mail]") == 1 and out.count("[telefoon]") == 2 and "3.000 - 4.000, 2024, 01-02-2024, 1012 AB" in out
    times = values(spark, normalize.parse_time, ["1700000000000", "1700000000", "not a date", "2024-05-01T10:00:00Z"])
    assert [str(t) if t else None for t in times] == ["2023-11-14 22:13:20", "2023-11-14 22:13:20", None, "2024-05-01 10:00:00"]


def test_skills(spark):
    found = values(spark, skills.find_skills, ["We use Python, Go and Java (not JavaScript). Kubernetes (k8s), AWS, and Postgres.", "Let's go build things", "R&D team", "in alle rust", "We write Rust and Scala"])
    assert {"Python", "Java", "JavaScript", "Kubernetes", "AWS", "PostgreSQL", "SQL"} <= set(found[0])
    assert found[1] == [] and "R" not in found[2] and found[3] == [] and set(found[4]) == {"Rust", "Scala"}


def test_text_facts(spark):
    assert values(spark, text.detect_language, ["Wij zoeken een collega voor het team met ervaring", "We are looking for an engineer with experience", "Wir sind ein Team und suchen dich", "xyz"]) == ["nl", "en", "other", "other"]
    found = values(spark, text.parse_salary, ["€60.000 - €80.000 per year", "EUR 5,000 per month", "€70k-€90k", "€500 for a laptop"])
    assert [tuple(f) if f else None for f in found] == [(60000, 80000), (60000, None), (70000, 90000), None]
    assert values(spark, lambda t: text.detect_seniority(t, F.lit(4)), ["Senior Engineer", "Junior dev", "Engineer", "Backend stage", "Product Manager", "Head of Data"]) == ["senior", "junior", "medior", "intern", "medior", "manager"]
    assert values(spark, text.html_to_text, ["<p>One &amp; two</p><ul><li>a</li><li>b</li></ul>", "&lt;p&gt;x&lt;/p&gt;", None]) == ["One & two\na\nb", "x", ""]


def test_agents(spark):
    rows = values(spark, agents.parse_agent, ["Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Safari/604.1", "Mozilla/5.0 (compatible; bingbot/2.0)", "", "Mozilla/5.0 (X11; Linux) Firefox/120.0"])
    assert [tuple(r) for r in rows] == [("Safari", "iOS", "mobile", False), ("bingbot", "Other", "bot", True), ("Unknown", "Unknown", "unknown", True), ("Firefox", "Linux", "desktop", False)]
    assert values(spark, agents.classify_path, ["/", "/static/x.css", "/api/skills", "/robots.txt", "/jobs/x", "/wp-login.php"]) == ["page", None, "api", "crawl", "page", "other"]
    assert values(spark, lambda c: agents.referrer_host(c, "own.example"), ["https://www.Google.com/x", "https://own.example/", "http://localhost/", None, "::junk"]) == ["google.com", None, None, None, None]
    assert values(spark, agents.search_detail, ["q=data&city=Delft", "q=data&page=2", "remote=false", "ids=1&q=x"]) == ["q=data&city=Delft", None, None, None]


@pytest.mark.parametrize("url, stem, rank", [("https://www.x.nl/fr/job/339", "x.nl/job/339", 3), ("https://x.nl/en-gb/job/339", "x.nl/job/339", 0), ("https://x.nl/job/339?a=1", "x.nl/job/339", 1), ("https://x.nl/nl/job/339/", "x.nl/job/339", 2)])
def test_language_addresses(spark, url, stem, rank):
    assert values(spark, duplicates.language_stem, [url]) == [stem] and values(spark, duplicates.language_rank, [url]) == [rank]


def test_patterns_against_plain_python(spark):
    """Skills, levels and positions by Python's own regular expressions, over words of every pattern's kind."""
    import re

    words = ["python", "C++ developer", "go lang", "R and SAS", ".NET core", "Node.js", "react native", "SQL", "machine learning", "cloud azure", "kubernetes k8s", "embedded linux", "ux design", "SAP", "scrum master", "excel", "docker", "CI/CD", "data science", "networking cisco", "firewall", "spark", "simulation engineer", "devops", "salesforce apex"]
    titles = [f"{level} {word} {tail}".strip() for level in ("", "Senior", "Junior", "Lead", "Stage", "Medior", "Head of", "Principal", "Product Manager", "Trainee") for word in words for tail in ("", "engineer", "- (m/v/x) Amsterdam", "consultant bij Acme", "architect")]

    def first(rules, text):
        return next((name for name, rx in rules if re.search(rx, text, re.I)), None)

    def position_of(title):
        full = re.sub(positions.TITLE_TAGS, " ", title.lower())
        for rx, to in positions.SPELLING:
            full = re.sub(rx, to, full)
        full = re.sub(r"\s+", " ", full).strip()
        main = re.split(r"\s+[-–|]\s+|,\s|\s+(?:bij|at|met|with)\s+", re.sub(r"\([^)]*\)?|\[[^\]]*\]?", " ", full))[0]
        return first(positions.SPECIFIC, main) or first(positions.SPECIFIC, full) or first(positions.MAIN_PART_ONLY + positions.CATCH_ALL, main) or first(positions.CATCH_ALL, full) or "other"

    assert values(spark, positions.position, titles) == [position_of(t) for t in titles]
    assert values(spark, text.title_level, titles) == [first(text.LEVELS, t) for t in titles]
    assert values(spark, skills.find_skills, titles) == [[name for name, rx in skills.TAXONOMY.items() if re.search(rx, t, re.I)] for t in titles]


def test_facts_of_distinct_texts_reach_every_row_and_are_computed_once(spark):
    rows = spark.createDataFrame([(k, [None, "Chrome/1", "x Googlebot/2", ""][k % 4]) for k in range(400)], "id long, agent string")
    seen = spark.sparkContext.accumulator(0)

    def counted(text):
        @F.udf("string")
        def upper(t):
            seen.add(1)
            return None if t is None else t.upper()

        return upper(text)

    out = by_distinct(rows, F.col("agent"), up=counted).where("up is not null")
    assert sorted(out.columns) == ["agent", "id", "up"]
    assert {(r.id, r.up) for r in out.collect()} == {(k, ["", "CHROME/1", "X GOOGLEBOT/2", ""][k % 4]) for k in range(400) if k % 4}
    assert seen.value == 4  # the filter is not pushed down to the rows
