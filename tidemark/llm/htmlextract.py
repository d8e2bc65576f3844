"""Main text of web pages by consensus container paths.

Each page's containers are scored by the text they hold outside links and page furniture; the page
votes for the generalised tag-class path of its best one. Spark counts the votes per host, and every
page is extracted again with its host's winning paths, in order of votes; a page in which none of
them holds text falls back on its own best container.

Votes are summed before they are shuffled, so a host with most of the pages is no hot spot; the
winners join the pages without a forced broadcast, Spark decides by their stored size.

Result: the container's blocks in page order joined by two line feeds; character references decoded,
white space inside a block made one space, line breaks too; nothing cut off. Left out: menus, page
headers and footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader comments. A
class or id counts as furniture by all its parts; an element that is only so named, or a form, stays
where it holds most of the page's text and no article outside it.

Edge cases: null or empty html gives an empty text; a null url belongs to the host ``''``; unclosed
and misnested tags close as in browsers' simple cases: what cannot stand in a head ends it, an article
ends an open menu, an unclosed title, frame or script ends where the next block begins; a page that is
all furniture keeps what holds most of it; a tag that never ends is text; ties between
paths go to the first in alphabetical order; repeated rows vote each; an empty table gives an empty
result; other columns than html stay, those named like a result column are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import small_batches, written
from tidemark.llm.urlfilter import host_of

WINNERS = 3
_MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:(?:"[^"]*"|'[^']*'|[^'">])*+>)|[^>]*>)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object", "video", "audio", "canvas"}
# What may stand in a head; anything else that starts ends it.
_IN_HEAD = {"title", "meta", "link", "style", "script", "base", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_FURNITURE = {"nav", "footer", "aside", "button", "select", "dialog", "menu", "head"}
_FORM = {"form", "fieldset"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CONTAINER = {"html", "body", "main", "article", "section", "div", "td", "center"}
_BLOCK = _CONTAINER | _HEADINGS | _FURNITURE | _FORM | {"p", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "th", "caption", "blockquote", "pre", "figure", "figcaption", "header", "address", "details", "summary", "hr", "hgroup", "search"}
_NEXT_BLOCK = re.compile(rf"<(?:{'|'.join(sorted(_BLOCK))})(?=[\s/>])", re.I)
# Start tags that end an open element of these names.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# A class or id names furniture if all its parts do, or are such as say where or what kind of box it is: "main-nav", but not "side-effects".
_NOISE = re.compile(
    r"(?:ads?|adverts?|advertis\w*|sponsor\w*|promos?|promotions?|banner|cookies?|cookiebar|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|share|sharing|social|related|recommend\w*|"
    r"sidebar|side|rail|widgets?|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|header|masthead|topbar|toolbar|skip|login|search|tags|copyright|legal|disclaimer)",
    re.I,
)
_COMMENTS = re.compile(r"(?:comments?|disqus|respond|responses?|replies|commentlist)", re.I)
_NEUTRAL = re.compile(r"(?:list|box|area|wrap|wrapper|wrapping|container|block|items?|inner|outer|top|bottom|left|right|main|primary|secondary|site|global|page|posts?|articles?|links?|section|bar|panel|row|col|column|buttons?|icons?|media|form|slot|unit|text|to|content|js|thread|[0-9x]+)", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}


_TELLING = {"class", "id", "role", "hidden", "aria-hidden", "style"}


class Page:
    """Open elements as nodes (parent, label, furniture) and the text blocks under them."""

    __slots__ = ("parent", "label", "tag", "own", "noise", "blocks")

    def __init__(self) -> None:
        self.parent, self.label, self.tag, self.own = [-1], [""], [""], [_KEPT]
        self.noise: list[bool] = []
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links

    def path(self, node: int) -> str:
        names = []
        while node > 0:
            names.append(self.label[node])
            node = self.parent[node]
        return "/".join(reversed(names))


_KEPT, _BY_NAME, _ALWAYS = 0, 1, 2  # whether an element is furniture: no, unless most of the page is in it, yes


def _named(token: str) -> int:
    """Whether a class or id speaks of furniture."""
    parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", token) if x]
    if not parts:
        return _KEPT
    if _COMMENTS.fullmatch(parts[0]) and all(_NEUTRAL.fullmatch(x) or _COMMENTS.fullmatch(x) for x in parts[1:]):
        return _ALWAYS
    noisy = [bool(_NOISE.fullmatch(x)) for x in parts]
    if parts[-1].lower() == "footer" or any(noisy) and all(n or _NEUTRAL.fullmatch(x) for n, x in zip(noisy, parts)):
        return _ALWAYS if any(_COMMENTS.fullmatch(x) for x in parts) else _BY_NAME
    return _ALWAYS if all(_COMMENTS.fullmatch(x) or _NEUTRAL.fullmatch(x) for x in parts) and any(_COMMENTS.fullmatch(x) for x in parts) else _KEPT


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """The generalised name of an element (tag and classes, digits as N) and whether it is furniture."""
    noise, name = _ALWAYS if tag in _FURNITURE else _BY_NAME if tag in _FORM else _KEPT, tag
    if len(attributes) > 4:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key not in _TELLING:
                continue
            value = a or b or c
            if key == "class":
                name += "".join("." + re.sub(r"\d+", "N", x) for x in sorted(value.split())[:3])
            if key in ("class", "id") and tag not in ("html", "body", "article", "main"):
                noise = max(noise, *map(_named, value.split()), _KEPT)
            elif key == "role" and value.lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                noise = _ALWAYS
            elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                noise = _ALWAYS
    return name, noise


def _settle(page: Page) -> None:
    """Decide which nodes are furniture: what is only named so stays if it holds most of the page's text, and no article or main stands outside it.

    Where that leaves no text at all, the same holds for every kind of furniture: an element that was never closed may hold the page.
    """
    _judge(page)
    if page.blocks and all(page.noise[node] for node, _, _ in page.blocks):
        page.own, page.noise = [min(own, _BY_NAME) for own in page.own], []
        _judge(page)


def _judge(page: Page) -> None:
    n = len(page.parent)
    always = [False] * n
    for node in range(n):
        always[node] = page.own[node] == _ALWAYS or node > 0 and always[page.parent[node]]
    released = set()
    if _BY_NAME in page.own:
        held, articles = [0] * n, [int(t in ("article", "main") and not a) for t, a in zip(page.tag, always)]
        for node, text, links in page.blocks:
            if not always[node]:
                held[node] += len(text) - links
        for node in range(n - 1, 0, -1):  # children come after their parents
            held[page.parent[node]] += held[node]
            articles[page.parent[node]] += articles[node]
        released = {k for k in range(n) if page.own[k] == _BY_NAME and held[0] and held[k] > 0.6 * held[0] and articles[k] == articles[0]}
    for node in range(n):
        own = page.own[node] == _ALWAYS or page.own[node] == _BY_NAME and node not in released
        page.noise.append(own or node > 0 and page.noise[page.parent[node]])


def parse(html: str) -> Page:
    page = Page()
    stack = [(0, "", None)]  # node of the nearest block element, tag, and for furniture inside a line the text and links around it
    texts: list[str] = []
    links = in_link = 0
    at, size = 0, len(html)

    def close_block() -> None:
        nonlocal links
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                page.blocks.append((stack[-1][0], text, min(links, len(text))))
            texts.clear()
        links = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link, texts, links
        while len(stack) > depth:
            _, tag, around = stack[-1]
            if tag == "a":
                in_link -= 1
            if tag in _BLOCK or around is not None:
                close_block()
            stack.pop()
            if around is not None:
                texts, links = around

    while at < size:
        found = _MARKUP.search(html, at)
        text = html[at : found.start() if found else size]
        if text:
            text = unescape(text) if "&" in text else text
            texts.append(text)
            if in_link:
                links += len(text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][1] == tag:
                    pop_to(depth)
                    break
            else:
                if tag in _BLOCK:
                    close_block()
            continue
        if tag in _RAW:
            if not found[3].endswith("/>"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                else:  # never closed: it ends where the next block begins
                    following = _NEXT_BLOCK.search(html, at)
                    at = following.start() if following else size
            continue
        if tag == "xmp":  # its markup is text
            end = re.compile(r"</xmp\s*>", re.I).search(html, at)
            close_block()
            texts.append(html[at : end.start() if end else size])
            close_block()
            at = end.end() if end else size
            continue
        if tag == "br":
            texts.append(" ")
            continue
        block = tag in _BLOCK
        if len(stack) > 1 and tag not in _IN_HEAD and any(name == "head" for _, name, _ in stack):
            pop_to(next(depth for depth, x in enumerate(stack) if x[1] == "head"))
        if tag in ("article", "main"):  # an open menu was never closed
            for depth in range(1, len(stack)):
                if stack[depth][1] in ("nav", "menu"):
                    pop_to(depth)
                    break
        if block:
            close_block()
            for depth in range(len(stack) - 1, 0, -1):
                name = stack[depth][1]
                if name == "p" or name in _ENDS.get(tag, ()):
                    pop_to(depth)
                    break
                if name in _CONTAINER or name in ("table", "ul", "ol", "dl") and tag not in ("tr", "td", "th"):
                    break
        if tag in _VOID:
            continue
        label, noise = _label(tag, found[3])
        node = stack[-1][0]
        if block or noise:
            page.parent.append(node)
            page.label.append(label)
            page.tag.append(tag)
            page.own.append(noise)
            node = len(page.label) - 1
        if tag == "a":
            in_link += 1
        around = None
        if noise and not block:
            around, texts, links = (texts, links), [], 0
        stack.append((node, tag, around))
    pop_to(1)
    close_block()
    _settle(page)
    return page


def _counts(page: Page, node: int) -> bool:
    """Whether a block belongs to the text by its header: an article's own header does, of a page's header only headings."""
    heading = header = False
    while node > 0:
        tag = page.tag[node]
        if tag in ("article", "main"):
            return True
        heading |= tag in _HEADINGS
        header |= tag == "header" and not heading
        node = page.parent[node]
    return not header


def scored(page: Page) -> tuple[dict[int, float], float]:
    """The score of each container, and of the page. A block scores its characters outside links."""
    score: dict[int, float] = {}
    total = 0.0
    for node, text, links in page.blocks:
        if page.noise[node]:
            continue
        own = (len(text) - links) * (1 - links / len(text))
        total += own
        while node > 0:
            if page.tag[node] in _CONTAINER:
                score[node] = score.get(node, 0.0) + own
            node = page.parent[node]
    return score, total


def best_container(page: Page, share: float = 0.8) -> tuple[int, float]:
    """The container of the article, and its score.

    From the deepest container with ``share`` of the page's scored text it goes up to the outermost article or main around
    it, or without one to the first container that holds all scored text, so that no part beside that deepest one is lost.
    """
    score, total = scored(page)
    best = 0
    for node in sorted(score):  # children come after their parents
        if score[node] >= share * total and total > 0:
            best = node
    around, node = 0, best
    while node > 0:
        if page.tag[node] in ("article", "main"):
            around = node
        node = page.parent[node]
    if around:
        best = around
    else:
        while best > 0 and score.get(best, 0.0) < total * (1 - 1e-9):
            best = page.parent[best]
    return best, score.get(best, total)


def text_of(page: Page, paths: list[str] | None) -> tuple[str, str]:
    """The text under the first of ``paths`` that holds as much scored text as the page's own best container, else under that; and the path used."""

    def under(roots: set[int]) -> str:
        kept = []
        for node, text, _ in page.blocks:
            up = node
            while up not in roots and up > 0:
                up = page.parent[up]
            if up in roots and not page.noise[node] and _counts(page, node):
                kept.append(text)
        return "\n\n".join(kept)

    best, most = best_container(page)
    if paths:
        score, _ = scored(page)
        by_path: dict[str, set[int]] = {}
        for node in range(1, len(page.label)):
            if page.tag[node] in _CONTAINER and not page.noise[node]:
                by_path.setdefault(page.path(node), set()).add(node)
        for path in paths:
            if path in by_path and sum(score.get(n, 0.0) for n in by_path[path]) >= most * (1 - 1e-9) and (text := under(by_path[path])):
                return text, path
    return under({best}), page.path(best)


def votes(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host, path, votes, score: the containers that pages chose, counted per host."""

    def ballot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen: dict[tuple[str, str], list[float]] = {}
            for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                page = parse(html)
                node, score = best_container(page)
                if node and score:
                    tally = chosen.setdefault((host, page.path(node)), [0, 0.0])
                    tally[0] += 1
                    tally[1] += score
            yield pa.RecordBatch.from_pydict(
                {
                    "host": pa.array([k[0] for k in chosen], pa.string()),
                    "path": pa.array([k[1] for k in chosen], pa.string()),
                    "votes": pa.array([v[0] for v in chosen.values()], pa.int64()),
                    "score": pa.array([v[1] for v in chosen.values()], pa.float64()),
                }
            )

    ballots = pages.where(F.col(html_col).isNotNull()).select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(ballot, "host string, path string, votes long, score double")
    return ballots.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))


def winners(counted: DataFrame, n: int = WINNERS) -> DataFrame:
    """host, paths: each host's ``n`` paths with most votes."""
    nth = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    top = counted.withColumn("nth", nth).where(F.col("nth") <= n)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``pages`` without html, with text, n_chars and the container path used."""
    small_batches(pages.sparkSession)
    won = written(winners(votes(pages, html_col, url_col)), "host-paths")
    kept = pages.drop("text", "n_chars", "container")
    host, paths = "_host", "_paths"
    while {host.lower(), paths.lower()} & {c.lower() for c in kept.columns}:  # the caller's columns stay
        host, paths = "_" + host, "_" + paths
    kept = kept.withColumn(host, host_of(F.col(url_col)))
    rows = kept.join(won.select(F.col("host").alias(host), F.col("paths").alias(paths)), host, "left").drop(host)
    own = [c for c in rows.columns if c not in (html_col, paths)]
    schema = T.StructType([*rows.select(*own).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("container", T.StringType())])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_of(parse(h or ""), p) for h, p in zip(batch[html_col].to_pylist(), batch[paths].to_pylist())]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in own), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array([p for _, p in found], pa.string())],
                names=[*own, "text", "n_chars", "container"],
            )

    return rows.mapInArrow(again, schema)
