"""Postings inside pages and feeds: schema.org objects as JSON-LD or microdata, mapped to raw postings.

One small helper for each page finds the objects, which are JSON text from then on; the mapping is made of columns.

A page without such objects gives no row; null pages and addresses are empty; a script that stops being JSON gives the
objects before that place; repeated objects are repeated rows; other columns of the landing table are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.links import path_of
from tidemark.functions.normalize import detect_city, parse_time
from tidemark.sources.boards import _filled, _iso2, _jobs, _joined, _nested, _raw

_SCRIPT = re.compile(r"<script[^>]*type\s*=\s*[\"']?[^\"'>]*ld\+json[^>]*>(.*?)</script\s*>", re.I | re.S)
_TYPE = re.compile(r"schema\.org/JobPosting", re.I)
_NONE: dict[str, str] = {}
_WRITTEN = json.JSONEncoder(ensure_ascii=False).encode
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ADDRESS = ("addressLocality", "addressRegion", "addressCountry", "streetAddress")
_BLOCKS = {"p", "div", "li", "ul", "ol", "br", "tr", "td", "h1", "h2", "h3", "h4"}


def objects_in(text: str) -> Iterator[object]:
    """JSON values behind each other, with line breaks inside strings and stray commas between values."""
    decoder, at = json.JSONDecoder(strict=False), 0
    while found := re.compile(r"[^\s,;]").search(text, at):
        try:
            value, at = decoder.raw_decode(text, found.start())
        except ValueError:
            return
        yield value


def postings_in(values: list) -> Iterator[dict]:
    """The JobPosting objects in JSON values, at any depth."""
    waiting = values[::-1]
    while waiting:
        value = waiting.pop()
        if isinstance(value, dict):
            kind = value.get("@type")
            if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
                yield value
            waiting += [v for v in reversed(value.values()) if isinstance(v, (dict, list))]
        elif isinstance(value, list):
            waiting += reversed(value)


class _Microdata(HTMLParser):
    """Collects the properties of each element whose itemtype is a JobPosting."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple] = []  # elements from the posting's own on: tag, property, value, where its text and markup begin
        self.text: list[str] = []  # of the posting that is open, each piece once
        self.markup: list[str] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag: str, attributes: list) -> None:
        self.start(tag, attributes, self.get_starttag_text() or "")

    def start(self, tag: str, attributes: list, raw: str) -> None:
        given = {k: v or "" for k, v in attributes} if attributes else _NONE
        if self.open:
            self.markup.append(raw)
            if tag in _BLOCKS:
                self.text.append(" ")
        elif _TYPE.search(given.get("itemtype", "")):
            self.found.append({"@type": "JobPosting"})
            self.text, self.markup = [], []
        else:
            return
        value = given.get("content") or given.get("datetime") or (given.get("href") if tag == "a" else None)
        self.open.append((tag, given.get("itemprop"), value, len(self.text), len(self.markup)))
        if tag in _VOID:
            self._close()

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open:
            self.text.append(data)
            self.markup.append(data)

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.open[-1][0] == tag:
            self._close()
        elif any(e[0] == tag for e in self.open):
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, name, value, text_at, markup_at = self.open.pop()
        posting = self.found[-1]
        if name and self.open and name not in ("address", "baseSalary"):
            inside = lambda outer: any(e[1] == outer for e in self.open)
            text = value or " ".join("".join(self.text[text_at:]).split())
            if name == "jobLocation":
                posting.setdefault("jobLocation", {"address": {}})
            elif name == "hiringOrganization":
                posting.setdefault("hiringOrganization", {}).setdefault("name", text)
            else:
                if name in _ADDRESS and inside("jobLocation"):
                    posting.setdefault("jobLocation", {"address": {}})["address"].setdefault(name, text)
                elif name == "name" and inside("hiringOrganization"):
                    posting.setdefault("hiringOrganization", {}).setdefault("name", text)
                posting.setdefault(name, value or ("".join(self.markup[markup_at:]) if name == "description" else text))
        if self.open and tag not in _VOID:
            self.markup.append(f"</{tag}>")
        return tag

    def read(self, html: str) -> list[dict]:
        """The postings of a page. Pages of plain tags are cut by one pattern, which sees in them what the parser would; all others are parsed."""
        at, start, data, end = 0, self.start, self.handle_data, self.handle_endtag
        for part in _PLAIN.finditer(html):
            if part.start() != at:
                break
            at = part.end()
            text, tag, attributes, slash, closed = part.groups()
            if text is not None:
                data(unescape(text) if "&" in text else text)
            elif tag is not None:
                tag = tag.lower()
                if tag in _NOT_PLAIN:
                    at = -1
                    break
                start(tag, [(k.lower(), v[1:-1] if v else None) for k, v in _ATTRIBUTE.findall(attributes)] if attributes else [], part.group())
                if slash and tag not in _VOID:
                    end(tag)
            elif closed is not None:
                end(closed.lower())
        if at != len(html):
            self.__init__()
            self.feed(html)
            self.close()
        return self.found


# Text; tags with quoted attributes without references, or none; comments and document types that hold nothing special. Whatever the
# parser has other rules for is not plain.
_PLAIN = re.compile(
    r"""([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9:_-]*(?:=(?:"[^"&]*"|'[^'&]*'))?)*)[ \t\n\r\f]*(/?)>"""
    r"""|</([a-zA-Z][a-zA-Z0-9]*)>|<!--[^<>-]*-->|<![dD][oO][cC][tT][yY][pP][eE] [a-zA-Z]+>"""
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9:_-]*)(?:=("[^"]*"|'[^']*'))?""")
# what such elements hold is no markup, or not in every release of the parser
_NOT_PLAIN = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext"}


def page_objects(html: str | None) -> list[str]:
    """A page's JobPosting objects as JSON: those of its JSON-LD scripts, or without any its microdata."""
    found = [p for script in _SCRIPT.findall(html or "") for p in postings_in(list(objects_in(script)))]
    if not found and "schema.org/jobposting" in (html or "").lower():
        found = [p for p in _Microdata().read(html) if p.get("title") or p.get("name")]
    return [_WRITTEN(p) for p in found]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _page_objects(html: pd.Series) -> pd.Series:
    return html.map(page_objects)


def _is(value: Column, sign: str) -> Column:
    return F.coalesce(F.ltrim(value).startswith(sign), F.lit(False))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _listed(value: Column) -> Column:
    """A value as a list: its own items, or it alone; empty without one."""
    none = F.array().cast("array<string>")
    return _let(value, lambda v: F.when(_is(v, "["), F.coalesce(F.from_json(v, "array<string>"), none)).when(v != "", F.array(v)).otherwise(none))


def _one(value: Column) -> Column:
    """A value as one text: the first filled item of a list, the name of an object."""
    first = F.get(F.filter(_listed(value), lambda x: x.isNotNull() & (x != "")), F.lit(0))
    named = lambda v: F.when(_is(v, "{"), F.coalesce(_filled(F.get_json_object(v, "$.name")), F.get_json_object(v, "$['@value']"))).otherwise(v)
    return _let(_let(first, named), lambda v: _filled(F.trim(v)))


def posting_url(value: Column, page_url: Column) -> Column:
    """The posting's own address; the page's where that is missing, no address, or only a home page."""

    def full(u: Column) -> Column:
        rooted = F.concat(F.regexp_extract(page_url, r"^([^:/?#]+://[^/?#]*)", 1), u)
        return F.when((u == "") | _is(u, "{") | _is(u, "["), None).when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("http"), u).when(u.startswith("/"), rooted)

    own = _let(_let(F.trim(value), full), lambda u: F.when(F.regexp_replace(path_of(u), "^/+|/+$", "") != "", u))
    return F.coalesce(own, page_url, F.lit(""))


def _place(loc: Column) -> Column:
    """struct(city, country, text) of one item of a posting's places."""
    get = lambda path, of: F.get_json_object(of, f"$.{path}")

    def read(address: Column) -> Column:
        fields = F.when(_is(address, "{"), address)
        country = _let(get("addressCountry", fields), lambda c: F.when(_is(c, "{"), get("name", c)).otherwise(c))
        known = F.struct(_one(get("addressLocality", fields)).alias("city"), _one(country).alias("country"), _one(get("addressRegion", fields)).alias("region"), _one(get("streetAddress", fields)).alias("street"))
        text = lambda k: F.when(fields.isNotNull(), F.coalesce(_joined(F.array(k["city"], k["region"], k["country"], k["street"]), ", "), F.lit(""))).otherwise(F.coalesce(address, F.lit("")))
        return _let(known, lambda k: F.struct(k["city"].alias("city"), k["country"].alias("country"), text(k).alias("text")))

    return _let(F.when(_is(loc, "{"), F.get(_listed(get("address", loc)), F.lit(0))).otherwise(loc), read)


def mapped(rows: DataFrame, p: Column, page_url: Column) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with what is read of their JobPosting object ``p``, and the columns of a raw posting in terms of it; title is null if it has none."""
    get = lambda path, of=p: F.get_json_object(of, f"$.{path}")
    read = {
        "_url": posting_url(get("url"), page_url),
        "_ident": _let(get("identifier"), lambda v: F.when(_is(v, "{"), F.coalesce(_filled(get("value", v)), get("name", v))).otherwise(v)),
        "_employer": _let(get("hiringOrganization"), lambda v: F.when(_is(v, "{"), get("name", v)).otherwise(v)),
        "_places": F.transform(_listed(get("jobLocation")), _place),
        "_words": F.regexp_replace(F.try_url_decode(path_of(page_url)), r"[-_/.%]+", " "),
        "_title": F.coalesce(_filled(get("title")), _filled(get("name"))),
        "_location_type": get("jobLocationType"), "_description": get("description"), "_posted": get("datePosted"), "_until": get("validThrough"),
    }
    rows = rows.withColumns(read)
    first = lambda field: F.get(F.filter(F.transform("_places", lambda x: x[field]), lambda x: x.isNotNull()), F.lit(0))
    rows = rows.withColumns({"_city": first("city"), "_country": first("country"), "_stated": _joined(F.transform("_places", lambda x: x["text"]), "; ")})
    named = F.when(F.col("_stated").isNull() & F.col("_city").isNull(), F.concat(detect_city(F.col("_words")), F.lit(", Netherlands")))
    return rows, {
        "external_id": F.coalesce(_filled(F.col("_ident")), "_url"),
        "title": F.col("_title"),
        "url": F.col("_url"),
        "company": _filled(F.left(F.trim("_employer"), F.lit(200))),
        "location": F.coalesce("_stated", named),
        "city": F.col("_city"),
        "country": _iso2(F.col("_country")),
        "remote": F.when(F.contains(F.upper("_location_type"), F.lit("TELECOMMUTE")), True),
        "description_html": _filled(F.col("_description")),
        "posted_at": parse_time(F.col("_posted")),
        "valid_through": parse_time(F.col("_until")),
    }


def pages(landing: DataFrame) -> DataFrame:
    """Raw postings, with the employer each names, of fetched pages (source_id, url, html)."""
    rows = landing.select("source_id", F.col("url").alias("page_url"), F.explode(_page_objects(F.col("html"))).alias("p"))
    rows, columns = mapped(rows, F.col("p"), F.coalesce("page_url", F.lit("")))
    return _raw(rows, **columns).where("title is not null")


def teamtailor(landing: DataFrame) -> DataFrame:
    """A JSON feed whose items carry a JobPosting; the item's own id, title and address come first."""
    item = "id string, title string, url string, content_html string, date_published string, _jobposting string"
    rows = _jobs(landing, f"items array<struct<{_nested(item)}>>", "items")
    there = F.col("j._jobposting").isNotNull() & ~F.col("j._jobposting").isin("", "null", "{}")
    rows, p = mapped(rows, F.when(there, F.col("j._jobposting")), F.coalesce("j.url", F.lit("")))
    usable = p["title"].isNotNull()
    own = {
        "external_id": F.coalesce(_filled(F.col("j.id")), F.when(usable, p["external_id"])),
        "title": F.coalesce(_filled(F.col("j.title")), p["title"], F.lit("")),
        "url": F.coalesce(_filled(F.col("j.url")), F.when(usable, p["url"]), F.lit("")),
        "description_html": F.coalesce(_filled(F.col("j.content_html")), p["description_html"]),
        "posted_at": F.coalesce(p["posted_at"], parse_time(F.col("j.date_published"))),
    }
    return _raw(rows, **{k: own.get(k, F.when(usable, c)) for k, c in p.items()})


def smartrecruiters(landing: DataFrame, details: DataFrame, known: DataFrame, day_of_year: int, one_in: int = 20) -> tuple[DataFrame, DataFrame]:
    """Raw postings of listings (source_id, slug, payload) with their details (source_id, external_id, payload); and the ids that are still listed.

    Known postings at home (source_id, external_id) are only touched, but for one in ``one_in`` of them by day.
    """
    place = "struct<city:string,region:string,country:string,remote:boolean>"
    rows = _jobs(landing, f"content array<struct<id:string,name:string,location:{place},releasedDate:string>>", "content").where("j.id is not null")
    stored = known.select("source_id", F.col("external_id").alias("_id"), F.lit(True).alias("_known")).distinct()
    home = F.upper("j.location.country").eqNullSafe("NL")
    due = F.pmod(F.crc32(F.col("j.id").cast("binary")) + day_of_year, F.lit(one_in)) == 0
    rows = rows.withColumn("_id", F.col("j.id")).join(stored, ["source_id", "_id"], "left").withColumn("_skip", home & F.coalesce("_known", F.lit(False)) & ~due)
    section = "map<string,struct<title:string,text:string>>"
    ads = details.select("source_id", F.col("external_id").alias("_id"), F.from_json("payload", f"postingUrl string, jobAd struct<sections:{section}>").alias("d"))
    texts = F.transform(F.filter(F.map_values("d.jobAd.sections"), lambda s: F.length(s["text"]) > 0), lambda s: F.concat(F.lit("<h2>"), F.coalesce(s["title"], F.lit("")), F.lit("</h2>"), s["text"]))
    full = rows.where(~F.col("_skip")).join(ads, ["source_id", "_id"], "left")
    page = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("slug"), F.lit("/"), F.col("_id"))
    raw = _raw(full, external_id=F.col("_id"), title=F.coalesce("j.name", F.lit("")), url=F.coalesce(F.when(home, _filled(F.col("d.postingUrl"))), page), location=_joined(F.array("j.location.city", "j.location.region", "j.location.country"), ", "), city=F.col("j.location.city"),
               country=_iso2(F.col("j.location.country")), remote=F.when(F.col("j.location.remote"), True), description_html=F.when(home, _filled(F.array_join(texts, "\n"))), posted_at=parse_time(F.col("j.releasedDate")))
    return raw, rows.where("_skip").select("source_id", F.col("_id").alias("external_id"))


_VALUE = "struct<descriptor:string,id:string,count:bigint,facetParameter:string{inner}>"
_FACETS = f"array<struct<facetParameter:string,values:array<{_VALUE.format(inner=',values:array<' + _VALUE.format(inner='') + '>')}>>>"


def home_facet(landing: DataFrame) -> DataFrame:
    """source_id, param, value_id, count: of a board's facet values for the home country, in facets for countries, the one of most postings; values may lie one level down."""
    facet = landing.select("source_id", F.explode(F.from_json("payload", f"facets {_FACETS}").getField("facets")).alias("f"))
    value = facet.select("source_id", F.col("f.facetParameter").alias("outer"), F.explode("f.values").alias("v"))
    deep = value.where("v.values is not null").select("source_id", F.coalesce("v.facetParameter", "outer").alias("param"), F.col("v.descriptor").alias("label"), F.explode("v.values").alias("w"))
    flat = value.where("v.values is null and v.facetParameter is null").select("source_id", F.col("outer").alias("param"), F.lit("").alias("label"), F.col("v.descriptor").alias("name"), F.col("v.id").alias("value_id"), F.col("v.count").alias("count"))
    every = flat.unionByName(deep.select("source_id", "param", "label", F.col("w.descriptor").alias("name"), F.col("w.id").alias("value_id"), F.col("w.count").alias("count")))
    country = F.lower(F.trim("name")).isin("netherlands", "the netherlands", "nederland") & F.concat_ws(" ", "param", "label").rlike("(?i)country")
    best = F.max_by(F.struct("param", "value_id", F.coalesce("count", F.lit(0)).alias("count")), F.struct(F.coalesce("count", F.lit(0)), "param", "value_id"))
    return every.where(country).groupBy("source_id").agg(best.alias("b")).select("source_id", "b.*")


def is_dutch_place(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)netherlands|nederland") | detect_city(text).isNotNull(), F.lit(False))


def workday(landing: DataFrame, details: DataFrame, most: int = 400) -> DataFrame:
    """Raw postings of listing pages (source_id, slug, offset, by_search, payload) with their details (source_id, path, payload).

    Pages from offset 2,000 on are not read, and a board gives its first ``most`` postings: the platform's own limits.
    Listings found by searching keep those whose place is at home.
    """
    job = "struct<title:string,externalPath:string,locationsText:string,bulletFields:array<string>>"
    rows = landing.where("offset < 2000").select("source_id", "slug", "offset", "by_search", F.posexplode(F.from_json("payload", f"jobPostings array<{job}>").getField("jobPostings")).alias("at", "j"))
    rows = rows.where(~F.coalesce("by_search", F.lit(False)) | is_dutch_place(F.coalesce("j.locationsText", F.lit("")))).withColumn("path", F.coalesce("j.externalPath", F.lit("")))
    nth = F.expr("row_number() over (partition by source_id order by offset, at)")  # a board has at most 2,000 rows here
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    info = details.select("source_id", "path", F.from_json("payload", "jobPostingInfo struct<jobDescription:string,startDate:string,country:struct<descriptor:string>>").getField("jobPostingInfo").alias("d"))
    full = rows.join(info, ["source_id", "path"], "left")
    abroad = F.coalesce((F.col("d.country.descriptor") != "") & ~is_dutch_place(F.col("d.country.descriptor")), F.lit(False))
    host = F.concat(F.lit("https://"), F.regexp_extract("slug", r"^([^./]+)\.(wd\d+)/", 1), F.lit("."), F.regexp_extract("slug", r"^([^./]+)\.(wd\d+)/", 2), F.lit(".myworkdayjobs.com/"), F.regexp_extract("slug", "/(.*)$", 1))
    return _raw(full, external_id=F.coalesce(_filled(F.get("j.bulletFields", F.lit(0))), F.col("path")), title=F.coalesce("j.title", F.lit("")), url=F.concat(host, F.col("path")), location=F.col("j.locationsText"), country=F.when(~abroad, "NL"), description_html=F.col("d.jobDescription"), posted_at=parse_time(F.col("d.startDate")))


def recall_sample(landing: DataFrame) -> DataFrame:
    """The postings of an index's result pages (page, payload), each id once, from its first page."""
    result = "struct<id:string,title:string,company:struct<display_name:string>,location:struct<display_name:string>,redirect_url:string,created:string,description:string>"
    rows = landing.select("page", F.posexplode(F.from_json("payload", f"results array<{result}>").getField("results")).alias("at", "r")).where("r.id <> ''")
    first = rows.groupBy("r.id").agg(F.min_by("r", F.struct("page", "at")).alias("r"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return first.select("id", text("r.title").alias("title"), text("r.company.display_name").alias("company"), text("r.location.display_name").alias("location"), text("r.redirect_url").alias("url"), text("r.created").alias("created"), text("r.description").alias("description"))


def name_list(spark, path: str, *columns: str) -> DataFrame:
    """A hand-kept list: tab-separated lines of a name and a value each, further fields ignored; empty lines and those that start with # are skipped."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> '' and value not like '#%'").where(F.size(fields) >= 2)
    return rows.select(*(F.trim(fields[k]).alias(c) for k, c in enumerate(columns))).where(F.col(columns[1]) != "")


def size_list(spark, path: str) -> DataFrame:
    """company, employees: lines of a hand-kept list whose number is one."""
    return name_list(spark, path, "company", "employees").where(F.col("employees").rlike("^[0-9]+$")).withColumn("employees", F.col("employees").cast("long"))


def json_lines(spark, path: str, schema: str) -> DataFrame:
    """Records of a file with a JSON object a line; empty lines are skipped."""
    return spark.read.schema(schema).json(path).dropna("all")
