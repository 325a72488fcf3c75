"""Main text of web pages by consensus paths of their hosts.

Each page's containers are scored by the text of their paragraphs (a parent gets all, its parent half, links count
against), under generalised paths: tags with their classes, digits as 0. Shares of the scores are voted per host and
path in Spark; the paths with at least a twentieth of a host's votes win it, in order of votes. Every page is extracted again from the
containers on the first winning path that holds at least 3 % of its best container's score, or from its own best
container if there is none. What a page has beside the voted container in the same article belongs to it: the container
is widened to the outermost article around it (and to a main element with a heading or paragraph of its own), or, where
there is none, to the outermost container below body that has headings or paragraphs of its own; headings that stand in
body itself are kept too.

Menus, headers (but for the headings and paragraphs of an article's own), footers, sidebars, notices, adverts, forms, reader
comments, scripts and styles are left out by element, by role and by class or id. A name counts as a whole: each of its
words must say what it is, where it stands or what it is made of (``share-buttons`` goes, ``share-price`` and ``no-sidebar``
stay, and ``entry-header`` is no page header). Headings' and sections' ids say what they are about, not what they are, but
for readers' comments. If nothing is left then, the page is read again without these names and with the text in forms.

Votes are sums with a partial aggregation, so a hot host arrives as one row per map task and path. Hosts' winners are
broadcast only up to a checked count. Time and memory are linear in a page's size, whatever its nesting and however its
tags are left open.

Defined results: null and empty html give an empty text; null urls form one host; pages without a container are taken
whole, less the boilerplate; a tag that the page's end cuts off is dropped; nesting has no limit (beyond 30 steps a path begins with a hash); repeated rows are
extracted each and vote each; a null page_id is carried along; further columns are ignored; an empty table gives an empty
result; ties go to the deeper path, then the first in order.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick

#: Winning paths (at most 20 short strings a host) are broadcast up to this many hosts, and joined by shuffle beyond it.
MAX_BROADCAST = 20_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>", re.S)
_PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_START = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_RAW = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCK = _HEADINGS | frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIP = frozenset("nav header footer aside form script style noscript iframe template textarea title head select button dialog menu svg object canvas".split())
_CONTAINER = frozenset("article main section div td body".split())
_CLOSES_P = _BLOCK - {"body", "html", "tbody", "thead", "tfoot", "tr", "td", "th"}
_PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LIMITS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: A class or id names what is left out if it consists of these words,
_BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications pager pagination "
    "popup promo promoted promotion related respond responses rightbar share sharing sidebar sidenav signup social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
#: and of words that say where it stands, what it is made of or what it holds.
_AFFIXES = frozenset(
    "main site page global top bottom left right primary secondary upper lower inner outer first last wrapper wrap container box area bar section list links link block content group row col column panel button buttons icon icons item items post posts article articles entry story text body title "
    "slot unit zone thread form head holder region sticky fixed mobile desktop small large dark light desk message overlay dialog js open active aside count reply author meta children even odd depth threads image img".split()
)
#: Beside one of these words, those of _PART name a part of the article.
_ARTICLE = frozenset("article body content entry post story text title".split())
_PART = frozenset("banner header masthead notice notices notification notifications toolbar widget widgets".split())
#: Names of what readers add, which count for articles and for ids of sections too.
_READERS = frozenset("comment comments commentlist disqus respond responses".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_SPLIT = re.compile(r"[_\-:]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_STEPS = 30


def _boilerplate(name: str) -> frozenset[str]:
    """The words by which a class or id, taken as a whole, names what is no part of the main text."""
    words = [w for w in (w.lower().rstrip("0123456789") for w in _SPLIT.split(name)) if w]
    found = _BOILERPLATE.intersection(words)
    if not found or any(w not in _BOILERPLATE and w not in _AFFIXES for w in words):
        return frozenset()
    return found - _PART if _ARTICLE.intersection(words) else found


def _left_out(tag: str, named: dict[str, str]) -> bool:
    if tag in ("html", "body", "main") or tag in _HEADINGS:
        return False
    classes, ids = named.get("class", "").split(), named.get("id", "").split()
    if tag == "article":
        return any(_READERS & _boilerplate(c) for c in classes + ids)
    if tag == "section":  # its id says what it is about
        ids = [i for i in ids if _READERS & _boilerplate(i)]
    return named.get("role", "").strip().lower() in _ROLES or any(map(_boilerplate, classes + ids))


class _Open:
    """An open element. block: place of the nearest block in the stack; container: of the nearest container."""

    __slots__ = ("tag", "skip", "container", "link", "block", "heading", "titles", "prose")

    def __init__(self, tag, skip, container, link, block, heading, titles, prose):
        self.tag, self.skip, self.container, self.link, self.block, self.heading, self.titles, self.prose = tag, skip, container, link, block, heading, titles, prose


class Page:
    """Kept blocks in page order as (text, container, characters in links, whether a heading); containers as tag, path, depth and the container around it."""

    def __init__(self, html: str, names: bool = True) -> None:
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.tags, self.paths, self.depths, self.parents = [""], [""], [0], [-1]
        self._names = names
        self._read(html)

    def _enter(self, tag: str, label: str, parent: int) -> int:
        depth, path = self.depths[parent] + 1, self.paths[parent]
        if depth % _STEPS == 0:  # a path's length is bounded
            path = hashlib.md5(path.encode("utf-8", "replace")).hexdigest()
        self.tags.append(tag)
        self.paths.append(f"{path}/{label}")
        self.depths.append(depth)
        self.parents.append(parent)
        return len(self.tags) - 1

    def _read(self, html: str) -> None:
        stack = [_Open("", False, 0, False, 0, False, False, False)]
        at_tag: dict[str, list[int]] = {}
        text: list[str] = []
        linked, at, end, last = 0, 0, len(html), html.rfind(">")
        token = _TOKEN

        def close():
            nonlocal text, linked
            if text:
                joined = " ".join(unescape("".join(text)).split())
                if joined:
                    self.blocks.append((joined, stack[-1].container, linked, stack[-1].heading))
                text, linked = [], 0

        def pop(k):
            while len(stack) > k:
                if stack[-1].tag in _BLOCK or stack[-1].skip != stack[-2].skip:
                    close()
                at_tag[stack[-1].tag].pop()
                stack.pop()

        def add(raw):
            nonlocal linked
            top = stack[-1]
            if raw and (not top.skip or top.titles and top.prose):
                text.append(raw)
                if top.link:
                    linked += len(raw)

        while at < end:
            begin = _START.search(html, at)
            add(html[at : begin.start() if begin else end])
            if begin is None or begin.start() > last and not html.startswith("<!--", begin.start()):
                break
            m = token.match(html, begin.start())
            if m is None:  # a quote is left open: from here on tags end at the next >
                token = _PLAIN_TOKEN
                m = token.match(html, begin.start())
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = m[2].lower()
            if m[1]:
                places = at_tag.get(tag)
                # a stray end of an inline element ends no block
                if places and (tag in _BLOCK or places[-1] > stack[-1].block):
                    pop(places[-1])
                continue
            if tag == "br":
                add(" ")
                continue
            top = stack[-1]
            if tag in _CLOSES_P and stack[top.block].tag == "p":
                pop(top.block)
            if tag in _PEERS:
                limit = max((at_tag[t][-1] for t in _LIMITS[tag] if at_tag.get(t)), default=0)
                open_ = [at_tag[t][-1] for t in _PEERS[tag] if at_tag.get(t) and at_tag[t][-1] > limit]
                if open_:
                    pop(min(open_))
            if tag in _BLOCK:
                close()
            if tag in _VOID:
                continue
            top = stack[-1]
            named = {k.lower(): a or b or c for k, a, b, c in reversed(_ATTRIBUTE.findall(m[3]))} if m[3] else {}
            out = tag in _SKIP and (self._names or tag != "form") or self._names and bool(named) and _left_out(tag, named)
            skip = top.skip or out
            # an article's header has its headings and its standfirst
            titles = top.titles and not out if top.skip else tag == "header" and out and self.tags[top.container] in ("article", "main")
            container = top.container
            if tag in _CONTAINER and not skip:
                classes = sorted({_DIGITS.sub("0", c) for c in named.get("class", "").split()})
                container = self._enter(tag, ".".join([tag, *classes]), container)
            if skip and not top.skip:
                close()
            at_tag.setdefault(tag, []).append(len(stack))
            stack.append(_Open(tag, skip, container, top.link or tag == "a", len(stack) if tag in _BLOCK else top.block, tag in _HEADINGS or top.heading and tag not in _BLOCK, titles, tag == "p" or tag in _HEADINGS or top.prose and tag not in _BLOCK))
            if m[3].endswith("/") and tag in ("svg", "path", "use"):
                pop(len(stack) - 1)
            if tag in _RAW:
                stop = _RAW[tag].search(html, at)
                at = stop.start() if stop else end
        pop(1)
        close()

    def scores(self) -> list[float]:
        """Of each container: the text of its own blocks less twice that in links, and half the score of each container in it."""
        out = [0.0] * len(self.tags)
        for text, container, linked, _ in self.blocks:
            out[container] += max(0, len(text) - 2 * linked)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i] / 2
        return out

    def by_path(self) -> dict[str, float]:
        """Scores of the paths; the page itself has none unless its text stands outside all containers."""
        out: dict[str, float] = {}
        for path, score in zip(self.paths, self.scores(), strict=True):
            if score > 0:
                out[path] = out.get(path, 0.0) + score
        return out

    def text(self, winners: list[str]) -> str:
        """The main text, given the host's winning paths, best first."""
        scores, depths = self.by_path(), dict(zip(self.paths, self.depths, strict=True))
        best = min(scores, key=lambda p: (-round(scores[p], 9), -depths[p], p), default=None)
        if best is None:
            return "\n\n".join(t for t, *_ in self.blocks)
        path = next((p for p in winners if scores.get(p, 0.0) >= 0.03 * scores[best]), best)
        own = {c for t, c, linked, heading in self.blocks if heading or len(t) > 2 * linked}  # containers with prose of their own
        # from outside in: the outermost article, main element with prose, and other container with prose around each one
        n = len(self.tags)
        article, main, other = [-1] * n, [-1] * n, [-1] * n
        for i in range(1, n):
            up, tag = self.parents[i], self.tags[i]
            article[i] = article[up] if article[up] >= 0 else i if tag == "article" else -1
            main[i] = main[up] if main[up] >= 0 else i if tag == "main" and i in own else -1
            other[i] = other[up] if other[up] >= 0 else i if tag == "main" or i in own and tag != "body" else -1
        wanted = set()
        for i in (i for i, p in enumerate(self.paths) if p == path):
            wide = main[article[i]] if article[i] >= 0 and main[article[i]] >= 0 else article[i] if article[i] >= 0 else other[i]
            wanted.add(wide if wide >= 0 and self.tags[i] != "body" else i)
        inside = [False] * n
        for i in range(n):
            inside[i] = i in wanted or i > 0 and inside[self.parents[i]]
        return "\n\n".join(t for t, c, _, heading in self.blocks if inside[c] or heading and (c == 0 or self.tags[c] == "body"))


def main_text(html: str | None, winners: list[str] | None) -> str:
    html = html or ""
    page = Page(html)
    if not page.blocks and html:
        page = Page(html, names=False)
    return page.text(winners or [])


def _votes(batches):
    for batch in batches:
        hosts, pages = (c.to_pylist() for c in batch.columns)
        out: dict[tuple[str, str, int], float] = {}
        for host, html in zip(hosts, pages, strict=True):
            page = Page(html or "")
            scores = page.by_path()
            total, depths = sum(scores.values()), dict(zip(page.paths, page.depths, strict=True))
            for path, score in scores.items():
                key = (host, path, depths[path])
                out[key] = out.get(key, 0.0) + score / total
        cols = list(zip(*out, strict=True)) if out else [[]] * 3
        kinds = (pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([*[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], pa.array(list(out.values()), pa.float64())], names=["host", "path", "depth", "share"])


def _extract(batches):
    for batch in batches:
        ids, urls, pages, paths = (c.to_pylist() for c in batch.columns)
        texts = [main_text(h, p) for h, p in zip(pages, paths, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """host, paths: the container paths with at least a twentieth of the host's votes (20 at most), the one with most first. pages: host, html."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, depth int, share double").groupBy("host", "path", "depth").agg(F.round(F.sum("share"), 6).alias("votes"))
    totals = votes.groupBy(F.col("host").alias("h")).agg(F.sum("votes").alias("total"))
    won = votes.join(totals, F.col("host") == F.col("h")).where(F.col("votes") >= F.col("total") / 20)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("depth")).alias("d"), "path")))
    return won.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][\w+.\-]*://([^/?#]*)", 1), F.lit("")))
    plain = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    winners = host_paths(plain).withColumnRenamed("host", "winner")
    few = plain.select("host").distinct().limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    joined = plain.join(F.broadcast(winners) if few else winners, plain["host"] == F.col("winner"), "left")
    return joined.select("page_id", "url", "html", "paths").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_consensus_html(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
