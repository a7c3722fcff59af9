"""HTML extraction: the article of a page, without what its site repeats.

Two passes over the pages. The first hashes every element subtree that has a text, whatever its tag, role or
class; Spark counts, per host, the different pages that have it. The second deletes the subtrees that many pages of
the host share. Only from what is left it then takes what is never main text by its tag, role, class or id,
and reads the blocks of the rest. Between the passes go the templates of each host, broadcast if they are
counted few, else one narrow row for each page with a subtree to delete.

Two kinds of subtrees are not counted: those that hold the article itself, and the prose of an article (its
paragraphs, headings, lists and tables), as articles of a site may quote the same passage.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kategora.plans.storage import SMALL_ROWS, staged

# A subtree is a template from so many different pages of a host on, whatever the size of the host;
# on a host of few pages fewer are enough, if they are that share of its pages.
MANY_PAGES = 10
MIN_PAGES = 5
MIN_SHARE = 0.1
# Templates of one host that are handed to each of its pages; beyond, a page gets only those it has.
HOST_TEMPLATES = 1_000

# Element names of HTML by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math".split())
NEVER = RAW | set("head nav footer aside form button select option dialog menu object canvas audio video".split())
MAIN = {"article", "main"}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead table ul ol dl figure figcaption caption".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
CLOSES_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol "
    "p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = set("ul ol dl table select div section article main body aside nav".split())
# Words of classes, ids and roles that mark what is not main text.
MARKS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login "
    "search share sharing social related recommended comment comments disqus reply replies widget toolbar pagination pager skip "
    "complementary contentinfo header".split()
)
# Words that layouts also use for the frame around an article ("with-sidebar").
FRAME = set("sidebar side aside header footer masthead nav navbar navigation menu banner".split())
# Words that mark an article itself as not main text.
SECOND = set("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
NAME_PARTS = re.compile(r"[a-z]+")
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


@dataclass
class Element:
    """``parts`` are texts and elements in page order; ``marks`` the words of ``MARKS`` it carries."""

    tag: str
    marks: frozenset = frozenset()
    parts: list = field(default_factory=list)


def parse(page: str) -> Element:
    """Tree of a page. Missing end tags are added as browsers do for the common elements; a tag or comment cut off at the end is dropped."""
    root = Element("html")
    stack, at = [root], 0
    # How many of each element are open: an end tag without one is passed over at once.
    opened: Counter[str] = Counter()
    size = len(page)
    while at < size:
        m = TAG.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                _close(stack, name, opened)
            continue
        attributes = m[3]
        if not m[4]:
            # Cut off, or a quote that is never closed: then the tag ends with the next bracket.
            end = page.find(">", m.end(2))
            if end < 0:
                break
            at, attributes = end + 1, page[m.end(2) : end]
        if name in ("html", "body"):
            continue
        if name in CLOSES_P:
            _close_p(stack, opened)
        if name in SAME:
            _close_same(stack, SAME[name], opened)
        element = Element(name, _marks(attributes) if attributes else frozenset())
        if name in MAIN and not element.marks & SECOND:
            element.marks = frozenset()
            for outer in stack:
                outer.marks -= FRAME
        stack[-1].parts.append(element)
        if name in VOID or attributes.endswith("/") and name not in RAW and name not in INLINE | CLOSES_P:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(element)
        opened[name] += 1
    return root


def _cut(stack: list[Element], i: int, opened: Counter) -> None:
    for element in stack[i:]:
        opened[element.tag] -= 1
    del stack[i:]


def _close(stack: list[Element], name: str, opened: Counter) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            _cut(stack, i, opened)
            return
        # An end tag does not reach out of a block that is still open, unless it ends a block itself.
        if name in INLINE and stack[i].tag not in INLINE:
            return


def _close_p(stack: list[Element], opened: Counter) -> None:
    for i in range(len(stack) - 1, 0, -1) if opened["p"] else ():
        if stack[i].tag == "p":
            _cut(stack, i, opened)
            return
        if stack[i].tag not in INLINE:
            return


def _close_same(stack: list[Element], names: set[str], opened: Counter) -> None:
    for i in range(len(stack) - 1, 0, -1) if any(opened[n] for n in names) else ():
        if stack[i].tag in names:
            _cut(stack, i, opened)
            return
        if stack[i].tag in STOPS:
            return


def _marks(attributes: str) -> frozenset[str]:
    found: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            found.add("hidden")
        elif name in ("class", "id", "role"):
            found |= MARKS.intersection(NAME_PARTS.findall(value))
    return frozenset(found)


def dropped(element: Element, in_main: bool) -> bool:
    """Never main text. A ``header`` inside the article may hold its headline and stays."""
    return element.tag in NEVER or bool(element.marks) or element.tag == "header" and not in_main


def is_main(element: Element) -> bool:
    return element.tag in MAIN and not element.marks


def mains(element: Element, delete: set[int]) -> list[Element]:
    """Outermost articles below an element, or what stands for them, in page order."""
    found, stack = [], list(reversed(element.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, Element) and id(part) not in delete and not dropped(part, False):
            if part.tag in MAIN:
                found.append(part)
            else:
                stack.extend(reversed(part.parts))
    return found


def content(root: Element, delete: set[int]) -> list[Element]:
    """Elements that hold the main text: articles, inside ``main`` if it has some; else the whole page."""
    found = []
    for main in mains(root, delete):
        inner = mains(main, delete) if main.tag == "main" else []
        found += inner or [main]
    return found or [root]


class Frame:
    """An element whose subtree is being hashed."""

    def __init__(self, element: Element, in_main: bool):
        self.element, self.in_main = element, in_main or is_main(element)
        self.parts = iter(element.parts)
        self.digest = xxhash.xxh64(element.tag.encode())
        self.words, self.holds_main = False, is_main(element)


def candidates(root: Element) -> dict[int, int]:
    """Hashes of the subtrees that may be deleted, by element: of tags, texts and children, bottom up."""
    found: dict[int, int] = {}
    frames = [Frame(root, False)]
    while frames:
        top = frames[-1]
        part = next(top.parts, None)
        if isinstance(part, str):
            text = " ".join(part.split())
            if text:
                top.words = True
                top.digest.update(b"\0" + text.encode("utf-8", "surrogatepass"))
        elif part is not None:
            frames.append(Frame(part, top.in_main))
        else:
            frames.pop()
            value, tag = top.digest.intdigest() - (1 << 63), top.element.tag
            if frames and top.words and not top.holds_main and tag not in INLINE and not (top.in_main and tag in PROSE):
                found[id(top.element)] = value
            if frames:
                frames[-1].digest.update(b"\1" + value.to_bytes(8, "little", signed=True))
                frames[-1].words |= top.words
                frames[-1].holds_main |= top.holds_main
    return found


def main_text(page: str | None, templates: set[int] = frozenset()) -> str:
    """Main text of a page: its blocks in order, white space as one space, joined by one space."""
    if not page:
        return ""
    root = parse(page)
    delete = {k for k, h in candidates(root).items() if h in templates} if templates else set()
    out: list[str] = []
    for top in content(root, delete):
        _read(top, top.tag in MAIN, delete, out)
        out.append(" ")
    return " ".join("".join(out).split())


def _read(element: Element, in_main: bool, delete: set[int], out: list[str]) -> None:
    stack: list[str | Element] = list(reversed(element.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(html.unescape(part))
        elif id(part) not in delete and not dropped(part, in_main):
            block = part.tag not in INLINE
            if block:
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(part.parts))


def page_subtrees(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, at, subtree``: the subtrees of each page (``at``: hash of its html), written once."""
    rows = pages.select(host_of(url).alias("host"), F.xxhash64(page).alias("at"), F.col(page).alias("html"))
    return staged(rows.mapInArrow(_explode, "host string, at long, subtree long").distinct(), "subtrees")


def page_templates(pages: DataFrame, found: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``host, subtree, n_pages``: of ``page_subtrees`` those that many different pages of their host have; a page and its copies are one."""
    rows = pages.select(host_of(url).alias("host"), F.xxhash64(page).alias("at"))
    hosts = rows.distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    counts = found.groupBy("host", "subtree").agg(F.count("*").alias("n_pages"))
    many = counts.filter(F.col("n_pages") >= MIN_PAGES)
    enough = F.least(F.lit(float(MANY_PAGES)), MIN_SHARE * F.col("n_host"))
    return many.join(hosts, "host").filter(F.col("n_pages") >= enough).drop("n_host")


def host_of(url: str) -> F.Column:
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every page.

    NULL html counts as empty and gives an empty text. A NULL or odd url belongs to the host "".
    NULL keys and repeated rows pass through (a page's templates are found by its host and html, so
    copies share them); other columns are ignored; an empty table gives an empty result. Pages are
    read whole.
    """
    found = page_subtrees(pages, url, page)
    templates = staged(page_templates(pages, found, url, page), "templates")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("html"), host_of(url).alias("host"))
    kind = rows.schema["key"].dataType.simpleString()
    sizes = templates.groupBy("host").agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if (sizes["all"] or 0) <= SMALL_ROWS and (sizes["most"] or 0) <= HOST_TEMPLATES:
        # Few: every page gets those of its host, and no page has to be shuffled.
        hits = templates.groupBy("host").agg(F.collect_set("subtree").alias("delete"))
        marked = rows.join(F.broadcast(hits), "host", "left")
    else:
        hits = found.join(templates.select("host", "subtree"), ["host", "subtree"]).groupBy("host", "at").agg(F.collect_set("subtree").alias("delete"))
        marked = rows.withColumn("at", F.xxhash64("html")).join(staged(hits, "hits"), ["host", "at"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(p, frozenset(d or ()))
                for p, d in zip(batch.column("html").to_pylist(), batch.column("delete").to_pylist(), strict=True)
            ]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), sizes], ["key", "url", "text", "n_chars"])

    done = marked.select("key", "url", "html", "delete").mapInArrow(read, f"key {kind}, url string, text string, n_chars long")
    return done.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, ats, trees = [], [], []
        for host, at, text in zip(*(batch.column(c).to_pylist() for c in ("host", "at", "html")), strict=True):
            for value in set(candidates(parse(text)).values()) if text else ():
                hosts.append(host)
                ats.append(at)
                trees.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(ats, pa.int64()), pa.array(trees, pa.int64())], ["host", "at", "subtree"])
