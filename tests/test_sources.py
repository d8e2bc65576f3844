"""Adapters, structured data, lists and maintenance verbs at their edges: nulls, broken payloads, empty tables, repeats, clashing names."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import links
from tidemark.operators import discovery, upkeep
from tidemark.sources import boards, structured

ODD = [None, "", "{", "[]", "{}", "null", '{"jobs": null}', '{"jobs": [null, {}]}', '{"jobs": [{"id": 7}]}', '{"items": [{"id": 7, "_jobposting": {}}]}', "<position><id>1</id></position>"]


@pytest.mark.parametrize("read", [*boards.ADAPTERS.values(), structured.teamtailor, boards.sitemap_urls])
def test_adapters_take_any_payload(spark, read):
    rows = [(k, "s", p) for k, p in enumerate(ODD * 2)]
    landing = spark.createDataFrame(rows, "source_id long, slug string, payload string").withColumn("j", F.lit("clash")).withColumn("p", F.lit(1))
    assert read(landing).count() >= 0
    assert read(landing.limit(0)).count() == 0


def test_paged_listings_take_any_payload(spark):
    landing = spark.createDataFrame([(k, "a.wd1/b", 0, k % 2 == 0, p) for k, p in enumerate([*ODD, '{"jobPostings": [{"title": null}, null]}', '{"content": [{"id": "1"}]}'])], "source_id long, slug string, offset int, by_search boolean, payload string")
    none = spark.createDataFrame([(None, None, None)], "source_id long, path string, payload string")
    assert structured.workday(landing, none).where("title = ''").count() >= 1
    raw, still = structured.smartrecruiters(landing, none.withColumnRenamed("path", "external_id"), none.withColumnRenamed("path", "external_id"), 3)
    assert [r.external_id for r in raw.collect()] == ["1"] and still.count() == 0
    assert structured.home_facet(landing).count() == 0
    assert structured.recall_sample(landing.withColumn("page", F.lit(1))).count() == 0


def test_structured_data_of_odd_pages(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    posting = {"@type": "JobPosting", "title": "T", "url": "/jobs/1"}
    pages = [
        (1, ld(json.dumps(posting) + ' ; {"@type": "Thing"} , ' + json.dumps({"@graph": [{"x": [posting]}]}) + " } broken {")),
        (2, ld('{"@type": "JobPosting", "title": "line\nbreak", "jobLocation": ["Amsterdam", {"address": "Delft"}, {"address": [{"addressLocality": {"name": "Ede"}, "addressCountry": {"name": "nl"}}]}]}')),
        (3, "<script type='application/ld+json'>not json</script>"),
        (4, None),
        (5, ""),
        (6, ld(json.dumps({"@type": ["JobPosting"], "title": "", "name": "N", "hiringOrganization": "Acme", "identifier": 12, "jobLocationType": "TELECOMMUTE", "url": {"a": 1}}))),
        (7, '<div itemscope itemtype="https://schema.org/JobPosting"><p itemprop="title">M<br>N</p><span itemprop="hiringOrganization">Acme <b>BV</b></span><img itemprop="logo" content="x">'),
        (8, ld(json.dumps({"@type": "JobPosting"}))),
    ]
    rows = spark.createDataFrame([(k, "https://x.example/werk-in-Zwolle", html) for k, html in pages * 2], "source_id long, url string, html string").withColumn("_url", F.lit("clash"))
    got = {}
    for r in structured.pages(rows).collect():
        got.setdefault(r.source_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {1: 4, 2: 2, 6: 2, 7: 2}
    assert got[1][0].url == "https://x.example/jobs/1" and got[1][0].location == "Zwolle, Netherlands"
    two = got[2][0]
    assert (two.title, two.location, two.city, two.country) == ("line\nbreak", "Amsterdam; Delft; Ede, nl", "Ede", "NL")
    six = got[6][0]
    assert (six.title, six.company, six.external_id, six.remote, six.url) == ("N", "Acme", "12", True, "https://x.example/werk-in-Zwolle")
    assert (got[7][0].title, got[7][0].company) == ("M N", "Acme BV")
    assert structured.pages(rows.limit(0)).count() == 0


def test_hand_kept_lists(spark, tmp_path):
    path = tmp_path / "sizes.tsv"
    path.write_text("# company\temployees\n\nASML\t43520\t2024\tsource\nAcme\t30\nBad\tmany\nShort\n  \nacme b.v.\t31\n", encoding="utf-8")
    sizes = structured.size_list(spark, str(path))
    assert sorted(map(tuple, sizes.collect())) == [("ASML", 43520), ("Acme", 30), ("acme b.v.", 31)]
    rows = spark.createDataFrame([(1, "Acme B.V."), (2, "asml"), (3, None), (4, "Other")], "id long, company string").withColumn("employees", F.lit(9))
    assert {r.id: r.employees for r in upkeep.with_sizes(rows, sizes).collect()} == {1: 31, 2: 43520, 3: None, 4: None}
    lines = tmp_path / "golden.jsonl"
    lines.write_text('{"id": 1, "title": "a"}\n\n{"id": 2}\n', encoding="utf-8")
    assert structured.json_lines(spark, str(lines), "id long, title string").count() == 2


def test_maintenance_of_nulls_and_repeats(spark):
    rows = [(1, None, None, None, None, None), (2, "T", "mail a@b.example", "h", "h", None), (2, "T", "mail a@b.example", "h", "h", None)]
    posts = spark.createDataFrame(rows, "id long, title string, description string, content_hash string, extracted_hash string, x string").withColumn("scrubbed", F.lit(3))
    got = upkeep.scrubbed(posts).collect()
    assert len(got) == 3 and [r.description for r in got if r.id == 2] == ["mail [e-mail]"] * 2
    assert all(r.extracted_hash == r.content_hash != "h" for r in got if r.id == 2)
    empty = spark.createDataFrame([], "ats string, slug string, company string, url string, kind string, active boolean, last_status string")
    kinds = spark.createDataFrame([], "kind string, needle string")
    found = spark.createDataFrame([("A", "lever", "a", None), ("A", "lever", "a", "u"), (None, "ashby", "demo", None)], "company string, ats string, slug string, url string")
    new = {r.slug: r for r in upkeep.upserted_sources(empty, found, kinds).collect()}
    assert len(new) == 2 and new["a"].kind == "employer" and new["a"].active and new["demo"].kind == "test" and not new["demo"].active
    assert upkeep.classified(empty, kinds).count() == 0


def test_link_checks_and_robots_of_nulls(spark):
    rows = spark.createDataFrame([(None, None, None, None, None, None), (200, None, "https://a.example/x", None, None, None), (200, "text/html", "https://a.example/x", "https://a.example/x", None, None)], "status int, content_type string, url string, final_url string, html string, title string")
    assert [r[0] for r in rows.select(links.link_verdict(*(F.col(c) for c in rows.columns))).collect()] == ["error", "ok", "ok"]
    files = spark.createDataFrame([("a", None), ("b", "Disallow: /early\nUser-agent: *\nDisallow: /x\nCrawl-delay: 3"), ("c", "no rules")], "host string, text string")
    rules = discovery.robots_rules(files, "bot")
    urls = spark.createDataFrame([("a", "/x"), ("b", "/x/1"), ("b", "/early"), ("c", "/x"), (None, None), ("b", None)], "host string, path string").withColumn("_rules", F.lit("clash")).drop("_rules")
    assert sorted((str(r.host), str(r.path)) for r in discovery.with_robots_verdict(urls, rules).where("not allowed").collect()) == [("b", "/x/1")]
    assert discovery.boards_on_pages(spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")).count() == 0
    assert discovery.careers_links(spark.createDataFrame([(1, None, None), (2, None, "<a href=x>jobs</a>")], "page_id long, url string, html string")).count() >= 0
