"""Costly expressions are computed once a row: what the optimiser makes of a query names them no more often."""

from pyspark.sql import functions as F

from tidemark.operators import matching
from tidemark.sources import boards


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_position_is_read_once(spark):
    xml = "<position><id> 1 </id><name>A &amp; B</name></position><position><id></id><name>x</name></position><position><id>3</id><name> </name></position><position><id>4"
    rows = boards.personio(spark.createDataFrame([(1, "acme", xml), (2, "bolt", None), (3, "cure", "")], "source_id long, slug string, payload string"))
    assert optimised(rows).count("from_xml(") == 1
    assert [(r.source_id, r.external_id, r.title, r.url) for r in rows.collect()] == [(1, "1", "A & B", "https://acme.jobs.personio.de/job/1")]


def test_an_employers_words_are_searched_once(spark):
    patterns = {"finance": "bank|lending", "health": "hospital|patients"}
    texts = spark.createDataFrame([("bank lending hospital",), ("bank hospital",), ("Bank bank",), ("patients HOSPITAL bank lending",), (None,)], "text string").coalesce(1)
    found = texts.select(matching.text_sector(F.col("text"), patterns).alias("s"))
    assert optimised(found).count("regexp_extract_all(") == len(patterns)
    assert [r.s for r in found.collect()] == ["finance", None, None, None, None]


def test_sectors_search_texts_once(spark):
    rows = [(1, "Bank of Acme", "We are lending.", 1), (2, "Cure", "We are a pharma hospital for patients.", 1), (3, "Hire", "We are a bank, lending.", 2), (4, "Odd", "We are a bank, lending.", 3), (5, "None", None, 1)]
    postings = spark.createDataFrame([(*r, True, None, None) for r in rows], "id long, company string, description string, source_id long, is_tech boolean, duplicate_of long, closed_at timestamp_ntz")
    sources = spark.createDataFrame([(1, "employer"), (2, "agency"), (3, None)], "source_id long, kind string")
    curated, fragments = spark.createDataFrame([], "company string, sector string"), spark.createDataFrame([("cure", "health")], "fragment string, sector string")
    found = matching.sectors(postings, sources, curated, fragments, {"finance": "bank|lending", "health": "hospital|patients"})
    plan = optimised(found)
    assert plan.count("regexp_extract_all(") == 2 and plan.count("geneesmiddel") == 1
    assert {r.company: (r.sector, r.found_by) for r in found.collect()} == {
        "Bank of Acme": ("finance", "text"), "Cure": ("pharma", "list+text"), "Hire": ("staffing", "source"), "Odd": ("finance", "text"), "None": ("other", "none"),
    }
