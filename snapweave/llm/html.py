"""Main text of web pages, with site templates removed.

A page becomes a tree of elements. Every element subtree outside the running text is hashed
(names, classes, own text, children); Spark counts on how many pages of a host each hash
occurs, and subtrees that recur on a large share of a host's pages are deleted there, along with
elements that say what they are (menus, footers, adverts, forms, scripts, comments). What is left
of the ``article`` (or ``main``, or the body) is the text.

Paragraphs and headings of the article are text and are never counted as templates, however
often a site repeats them: removal inside an article is for containers only.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from snapweave.llm.urls import host_of
from snapweave.runtime import materialize

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
DROPPED = set(
    "script style noscript template iframe head title nav header footer aside form button select option textarea "
    "input dialog svg canvas object embed audio video map menu".split()
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = set("div section ul ol dl table aside nav header footer form figure menu details".split())
CLOSES = {
    "p": set(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
        "hr main menu nav ol p pre section table ul".split()
    ),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"},
    "head": {"body"},
}
# Words in class, id or role that name what is not the article.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies "
    "consent disqus footer gdpr header menu nav navbar navigation newsletter notice notices pagination popup promo "
    "related share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</\s*([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
NAME = re.compile(r"[A-Za-z]+|[^A-Za-z\s]+")


class Element:
    """``words`` are the words of class, id and role, ``whole`` their names as they stand."""

    __slots__ = ("name", "words", "whole", "children", "digest")

    def __init__(self, name: str, words: tuple[str, ...] = (), whole: tuple[str, ...] = ()):
        self.name, self.words, self.whole, self.children = name, words, whole, []
        self.digest = ""


def _words(attributes: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words of class, id and role, and the names that they are parts of."""
    out, whole = [], []
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            value = entities.unescape(value.strip("\"'")).lower()
            out += NAME.findall(value)
            whole += value.split()
    return tuple(out), tuple(whole)


def parse(text: str) -> Element:
    """A tree of elements and text; tolerant of missing and stray end tags."""
    root = Element("")
    open_: list[Element] = [root]
    at, end = 0, len(text)
    # Behind the last ``>`` no tag can end: what is left is text, up to a comment that never ends.
    last = text.rfind(">") + 1
    while at < end:
        m = TOKEN.search(text, at, last) if at < last else None
        if m is None:
            rest = text[at:]
            open_[-1].children.append(rest[: rest.find("<!--")] if "<!--" in rest else rest)
            break
        if m.start() > at:
            open_[-1].children.append(text[at : m.start()])
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        if m[1]:
            name = m[1].lower()
            # The end of a block ends what is open in it; a stray end tag ends nothing.
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == name:
                    del open_[k:]
                    break
                if name in INLINE and open_[k].name not in INLINE:
                    break
        elif m[2]:
            name = m[2].lower()
            for k in range(len(open_) - 1, 0, -1):
                over = open_[k].name
                if name in CLOSES.get(over, ()):
                    del open_[k:]
                    break
                if over not in INLINE and over not in CLOSES:
                    break
            node = Element(name, *_words(m[3])) if m[3] else Element(name)
            open_[-1].children.append(node)
            if name in VOID:
                continue
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(text, at)
                node.children.append(text[at : close.start() if close else end])
                at = close.end() if close else end
                continue
            open_.append(node)
    return root


def says_boilerplate(node: Element) -> bool:
    """Whether an element names itself no article: a part of a name is enough for a container, a paragraph or a word
    inside one has to bear the whole name (``share-price`` is no ``share``)."""
    if node.name in DROPPED:
        return True
    names = node.words if node.name in CONTAINERS else node.whole
    return node.name not in ("article", "main", "body", "html") and not BOILERPLATE.isdisjoint(names)


def text_sizes(root: Element) -> dict[int, int]:
    """Characters of text in every subtree, by the element's identity."""
    sizes: dict[int, int] = {}
    stack = [(root, False)]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Element)]
        elif node.name in RAW:
            sizes[id(node)] = 0
        else:
            sizes[id(node)] = sum(sizes[id(c)] if isinstance(c, Element) else len(c.strip()) for c in node.children)
    return sizes


def _hash(node: Element) -> str:
    """Digest of a subtree; white space and link targets do not count. Trees are walked without recursion."""
    stack = [(node, False)]
    while stack:
        one, ready = stack.pop()
        if not ready:
            stack.append((one, True))
            stack += [(c, False) for c in one.children if isinstance(c, Element)]
            continue
        parts = [one.name, *one.words]
        parts += [c.digest if isinstance(c, Element) else " ".join(c.split()) for c in one.children]
        one.digest = hashlib.md5("\x00".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return node.digest


def template_candidates(root: Element) -> list[str]:
    """Digests of the subtrees that may be site templates: elements outside an article, containers inside it.
    Empty elements are none."""
    _hash(root)
    found, stack = set(), [(root, False)]
    while stack:
        node, inside = stack.pop()
        for child in node.children:
            if isinstance(child, Element):
                kept = child.name in CONTAINERS if inside else child.name not in ("html", "body", "article", "main", "head")
                if kept and child.name not in VOID and child.children:
                    found.add(child.digest)
                stack.append((child, inside or child.name in ("article", "main")))
    return sorted(found)


def _has(root: Element, name: str, sizes: dict[int, int] | None = None) -> list[Element]:
    """Elements of a name outside what names itself boilerplate. With ``sizes``, a wrapper that only bears such a
    name (``page has-sidebar``) is looked into if most of the page's text is inside."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        for child in reversed(node.children):
            if not isinstance(child, Element):
                continue
            wraps = sizes is not None and child.name not in DROPPED and 2 * sizes[id(child)] > sizes[id(root)]
            if wraps or not says_boilerplate(child):
                if child.name == name:
                    found.append(child)
                else:
                    stack.append(child)
    return found


def _tops(root: Element) -> list[Element]:
    found = _has(root, "article") or _has(root, "main")
    if not found:
        sizes = text_sizes(root)
        found = _has(root, "article", sizes) or _has(root, "main", sizes)
    return found or [root]


def main_text(root: Element, templates: frozenset[str]) -> str:
    """Text of the article(s) without boilerplate and templates: blocks in page order, white space as single spaces."""
    tops = _tops(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    for top in tops:
        in_article = top.name in ("article", "main")
        stack: list = [(top, in_article)]
        while stack:
            item, inside = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                line.append(item)
            elif item is not top and says_boilerplate(item):
                flush() if item.name not in INLINE else None
            elif item is not top and item.digest in templates and (item.name in CONTAINERS if inside else True):
                flush() if item.name not in INLINE else None
            else:
                block = item.name not in INLINE
                if block:
                    flush()
                    stack.append((None, inside))
                stack += [(c, inside or item.name in ("article", "main")) for c in reversed(item.children)]
        flush()
    return " ".join(blocks)


SHARE, LEAST_PAGES = 0.3, 3


def site_templates(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """``host, templates``: digests that occur on at least ``share`` of a host's pages and on at least ``least`` pages.

    Counts are combined before the shuffle. At most 1 / ``share`` times a page's subtrees can recur that
    often on a host, so a host's list is bounded by the size of its pages, not by their number.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [parse(x or "") for x in batch.column("html").to_pylist()]
            found = [template_candidates(tree) for tree in trees]
            kept = [batch.column("host"), pa.array([t.digest for t in trees], pa.string()), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(kept, names=["host", "page", "found"])

    seen = pages.select(host_of(F.col("url")).alias("host"), "html")
    # Copies of one page say nothing about the site: they count once.
    seen = seen.mapInArrow(candidates, "host string, page string, found array<string>").dropDuplicates(["host", "page"])
    # The count of pages rides along as an empty digest that every page has.
    each = seen.select("host", F.explode(F.concat(F.array(F.lit("")), "found")).alias("digest"))
    counts = materialize(each.groupBy("host", "digest").agg(F.count("*").alias("n")).where(F.col("n") >= least), "subtrees")
    pages_of = counts.where(F.col("digest") == "").select("host", F.col("n").alias("pages"))
    often = counts.where(F.col("digest") != "").join(pages_of, "host").where(F.col("n") >= F.col("pages") * share)
    return often.groupBy("host").agg(F.collect_set("digest").alias("templates"))


# Template lists of all hosts together that are sent to every task; beyond it the join is shuffled.
BROADCAST_DIGESTS = 200_000


def extract_main_text(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``).

    Null html is empty. Pages without a host (null address) count as pages of one host without a name.
    """
    templates = materialize(site_templates(pages, share, least), "templates")
    size = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0))).first()[0]
    if size <= BROADCAST_DIGESTS:
        templates = F.broadcast(templates)
    keyed = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    joined = keyed.join(templates, "host", "left").select("page_id", "url", "html", "templates")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, known in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True):
                root = parse(source or "")
                if known:
                    _hash(root)
                texts.append(main_text(root, frozenset(known or ())))
            sizes = pa.array(list(map(len, texts)), pa.int64())
            kept = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(kept, names=["page_id", "url", "text", "n_chars"])

    return joined.select(F.col("page_id").cast("long"), "url", "html", "templates").mapInArrow(
        extract, "page_id bigint, url string, text string, n_chars bigint"
    )
