"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks, each with its path of tags (and classes) from the root. What a page declares to be no
content (menus, page headers, footers, asides, forms, scripts, advert and comment sections by tag, role, class or id) is no
candidate. For the paths of the rest, text length and punctuation per block are worked out, smoothed over the part of the page
(the tag path's prefix) that they stand in, fused with its share of the text, and the paths whose value reaches a share of the
best one's are content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.common import bounded_batches, map_batches, session_of

#: A path is content if its fused ratio is at least this share of the page's best.
LEAST_SHARE = 0.12
#: How much more a path inside an article or main element counts than one outside it.
INSIDE = 25.0

# Fixed values of HTML: elements without content, with raw text, that are blocks, and that end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math canvas object audio video select".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption header footer nav aside form fieldset address details summary hr center dialog menu hgroup search legend button".split()
)
PARTS = frozenset("html body div section article main center".split())
LISTS = frozenset("ul ol dl table menu".split())
ENDS_P = BLOCKS - frozenset("button td th tr tbody thead tfoot caption legend summary".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An open item is not closed beyond these.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table", "tbody", "thead", "tfoot"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
# Tags, roles and words of class or id that say that a part is no content.
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu fieldset search head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar note status tablist".split())
ASIDE_WORDS = frozenset(
    """nav navbar navigation menu breadcrumb breadcrumbs masthead topbar toolbar footer foot colophon copyright sidebar sidebars side aside rail widget widgets ad ads adv
    adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted cookie cookies consent gdpr notice notices alert disclaimer
    newsletter subscribe subscription signup login popup modal overlay paywall share sharing social related recommended recommendations trending pagination pager
    comment comments commentlist disqus replies reply respond reactions form search skip hidden outbrain taboola tags teaser teasers""".split()
)
HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MAIN = frozenset(("article", "main"))

_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SKIPPED = re.compile(r"(has|no|with|is|tag|category|type|format|status|post)[-_]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|$)", re.I) for t in RAW}


class Element:
    """An open or closed element: where its path goes, whether it is no content by what it says, whether it holds main content."""

    __slots__ = ("above", "holds_main", "inside", "named_off", "off", "path", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], above: Element | None):
        self.tag, self.above, self.holds_main = tag, above, False
        names = attributes.get("class", "").split()
        self.path = (above.path if above else "") + "/" + ".".join([tag, *sorted(names)])
        self.inside = tag in MAIN or attributes.get("role") in MAIN or bool(above and above.inside)
        words = {w.lower() for n in [*names, attributes.get("id", "")] if not _SKIPPED.match(n) for w in _WORD.findall(n)}
        self.off = tag in ASIDE_TAGS or (tag == "header" and not (above and above.inside)) or attributes.get("role") in ASIDE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        self.named_off = tag not in ("html", "body", "main") and bool(words & ASIDE_WORDS)
        if tag in MAIN and self.candidate():
            at = above
            while at and not at.holds_main:
                at.holds_main, at = True, at.above

    def candidate(self, words: bool = True) -> bool:
        """Neither this nor what it stands in is no content; a wrapper that holds the main element is what that is. words: whether
        class names and ids count."""
        at: Element | None = self
        while at:
            if (at.off or words and at.named_off) and not at.holds_main:
                return False
            at = at.above
        return True


def attributes_of(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


def blocks(html: str) -> Iterator[tuple[Element, str, int]]:
    """(innermost block element, text, characters in links) of each block of a page that has text, in order."""
    root = Element("", {}, None)
    now, own, linked, links = root, [], 0, 0
    at = 0

    def block(e: Element) -> Element:
        while e.tag not in BLOCKS and e.above:
            e = e.above
        return e

    def say(text: str) -> None:
        nonlocal linked
        own.append(text)
        linked += len(text) if links else 0

    def done() -> Iterator[tuple[Element, str, int]]:
        nonlocal own, linked
        text = " ".join(unescape("".join(own)).split()) if own else ""
        if text:
            yield block(now), text, linked
        own, linked = [], 0

    while at < len(html):
        m = _MARKUP.search(html, at)
        if m is None:
            say(html[at:])
            break
        if m.start() > at:
            say(html[at : m.start()])
        at = m.end()
        closing, tag = m[1] or m[4], (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if closing:
            e = now
            while e.above and e.tag != tag:
                e = e.above
            if tag == "p" and e.tag != tag:
                yield from done()
            if e.tag != tag or not e.above or (tag not in BLOCKS and block(now) is not block(e)):
                continue
            if tag in BLOCKS:
                yield from done()
            if tag == "a":
                links = 0
            now = e.above
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in VOID:
            if tag == "hr":
                yield from done()
            elif tag == "br":
                own.append(" ")
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            own.append(" " if tag in ("textarea", "iframe", "object", "video", "audio", "canvas", "select", "svg") else "")
            continue
        if tag in BLOCKS:
            yield from done()
            links = 0
            # what may not stay open around this element ends here
            shut = CLOSED_BY.get(tag, set())
            e, last = now, None
            while e.above and e.tag not in FENCE.get(tag, {"button", "td", "th"} | (set() if tag != "p" else {"li", "div", "article", "section", "blockquote"})):
                if e.tag in shut or (e.tag == "p" and tag in ENDS_P):
                    last = e
                e = e.above
            if last is not None:
                now = last.above
            while now.above and now.tag not in BLOCKS:  # an unclosed <b> doesn't reach into the next block
                now = now.above
        elif tag == "a":
            links = 1
        now = Element(tag, attributes_of(attributes), now) if tag in BLOCKS or attributes else Element(tag, {}, now)
    yield from done()


def container(e: Element) -> Element:
    """What a block's path is smoothed with: the innermost article or main element around it, else the nearest part of a layout
    (lists, tables, quotes and figures belong to the part they stand in)."""
    at: Element | None = e
    while at and at.above and not (at.tag in MAIN if e.inside else at.tag in PARTS):
        at = at.above
    return at or e


def content(found: list[tuple[Element, str, int]]) -> np.ndarray:
    """Which candidate blocks are content, by the ratios of their paths."""
    known, of = np.unique([e.path for e, _, _ in found], return_inverse=True)
    first = np.zeros(len(known), np.int64)
    first[of[::-1]] = np.arange(len(found))[::-1]
    total = lambda values, by: np.bincount(by, weights=values)
    # per path: characters that aren't links, punctuation, and blocks
    blocks_of = np.bincount(of)
    free = total([max(0, len(t) - links) for _, t, links in found], of)
    marks = total([len(_PUNCTUATION.findall(t)) if links < len(t) else 0 for _, t, links in found], of)
    length = total([len(t) for _, t, _ in found], of)
    # smoothed up the tree: all paths in one part of the page share its ratios
    holders = [container(found[k][0]) for k in first]
    parts, up = np.unique([h.path for h in holders], return_inverse=True)
    n, text = total(blocks_of, up), total(free, up)
    ratio = text / n * (1 + total(marks, up) / n)
    fused = (ratio * np.sqrt(text / max(1.0, text.sum())) * np.where(total([e.inside for e in holders], up) > 0, INSIDE, 1.0))[up]
    # a list whose text is links only is a menu, wherever it stands
    lists = np.array([any(x.split(".")[0] in LISTS for x in p.split("/")[-3:]) for p in known])
    chosen = (fused >= LEAST_SHARE * fused.max()) & ~(lists & (free < 0.3 * length)) if fused.max() > 0 else np.ones(len(known), bool)
    keep = chosen[of]
    # a heading belongs to what it heads
    for k in range(len(found) - 2, -1, -1):
        keep[k] |= keep[k + 1] and found[k][0].tag in HEADS
    return keep


def main_text(html: str | None) -> str:
    """Content blocks of a page, white space within each as one space, joined by line feeds."""
    every = list(blocks(html or ""))
    found = [x for x in every if x[0].candidate() and not in_header(x[0])]
    # where class names leave nothing of a page, they say nothing about it
    found = found or [x for x in every if x[0].candidate(words=False) and not in_header(x[0])]
    return "\n".join(t for keep, (_, t, _) in zip(content(found), found) if keep) if found else ""


def in_header(e: Element) -> bool:
    """Inside an article's own header, but for its headings."""
    if e.tag in HEADS:
        return False
    at: Element | None = e
    while at:
        if at.tag == "header":
            return True
        at = at.above
    return False


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `html` replaced by `text` and `n_chars`, whole pages of any length.

    Null or empty html gives an empty text; repeated rows stay, and so do other columns, with an underscore before the name where
    it clashes with the new ones.
    """
    spark = session_of(pages)
    bounded_batches(spark)
    at = pages.columns.index(html)
    kept = [f for k, f in enumerate(pages.schema) if k != at]
    results = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    names: list[str] = []
    for f in kept:
        name = f.name
        while name.lower() in {"text", "n_chars", *(n.lower() for n in names)}:
            name = f"_{name}"
        names.append(name)
    schema = T.StructType([*(T.StructField(f"k{k}", f.dataType) for k, f in enumerate(kept)), *results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(at).to_pylist()]
            columns = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return map_batches(pages, run, schema).toDF(*names, "text", "n_chars")
