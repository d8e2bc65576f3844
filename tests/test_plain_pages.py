"""Microdata of plain pages is read without the parser, and as the parser reads it."""

from tidemark.sources import structured

POSTING = '<DIV itemscope itemtype="http://schema.org/JobPosting"><h1 itemprop="title"> A &amp; b<br/>c</h1>'
PLAIN = [
    "<!DOCTYPE html><p>before" + POSTING + '<meta itemprop="datePosted" content="1996-01-02"/><a itemprop="url" href=\'/x\'>go</a></DIV>after\n',
    POSTING + '<div itemprop="jobLocation"><span itemprop="address"><b itemprop="addressLocality">Town</b></span></div></div>' + POSTING + '<p itemprop="description">x<br>y &lt;z<!-- c --></p></p></div>',
    POSTING + '<div itemprop="hiringOrganization"><i itemprop="name">N  x</i></div><b itemprop="baseSalary">9</b><input disabled><q itemprop="name"/>',
    "no tags & none",
    "",
]
OTHER = [
    POSTING + "<script>if (a<b) {}</script></div>",
    POSTING + '<a itemprop="url" href="/x?a=1&amp;b=2">go</a></div>',
    POSTING + "<a itemprop=url href=/x>go</a> 1 < 2",
    POSTING + "<title itemprop='name'>t<b>x</title>",
    POSTING + '<p class="a',
]


def test_plain_pages_are_not_parsed(monkeypatch):
    fed = []
    feed = structured._Microdata.feed
    monkeypatch.setattr(structured._Microdata, "feed", lambda self, html: (fed.append(html), feed(self, html)))
    for html in PLAIN + OTHER:
        parser = structured._Microdata()
        feed(parser, html)
        parser.close()
        assert structured._Microdata().read(html) == parser.found
    assert fed == OTHER
    structured.page_objects(PLAIN[0])
    assert fed == OTHER


def test_what_is_read_of_a_plain_page():
    first, second, third = (structured._Microdata().read(html) for html in PLAIN[:3])
    assert first == [{"@type": "JobPosting", "title": "A & b c", "datePosted": "1996-01-02", "url": "/x"}]
    assert [p.get("description") for p in second] == [None, "x<br>y <z"] and second[0]["jobLocation"] == {"address": {"addressLocality": "Town"}}
    assert third == [{"@type": "JobPosting", "title": "A & b c", "name": "N x", "hiringOrganization": {"name": "N x"}}]
