"""Main text of web pages by tag-path ratios.

A page becomes blocks: stretches of text between block-level tags, each under its path of
tags from the root. Per path, the text outside links and its punctuation are summed and
divided by the number of blocks. These two ratios are smoothed over neighbouring blocks,
nearer for paths that share a parent, and fused; paths below a share of the spread of
all blocks go, and so do paths made of links. Menus, forms, comments and the like also go
by the meaning of their tags and names; where a page marks its article, the paths inside
it are judged among themselves. Kept paths give all their blocks, however short.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplake.llm.shared import map_batches

NEIGHBOURS = (1.0, 0.6, 0.14)           # weights of blocks 0, 1 and 2 places off: a Gaussian of deviation 1
SAME_PARENT, UNRELATED = 0.5, 0.1       # weight of another path's block, by kinship; 1 for the same path
SPREAD = 0.8                            # least fused score of a path, in deviations of all blocks
LEAST_PLAIN = 0.1                       # share of a path's text that must lie outside links
LEAST_ARTICLE = 0.2                     # least score of one of several articles, against the best of them

# Block-level elements of HTML.
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary
table tbody td tfoot th thead tr ul""".split())
# Elements without content of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no markup; it ends at their end tag only.
RAW = set("script style title textarea noscript iframe noembed noframes xmp".split())
# Elements that show no running text.
UNSEEN = set("""head template svg object canvas audio video map button select option optgroup datalist label output
progress meter""".split())
# Elements whose open paragraph or item a start tag ends.
ENDS_PARAGRAPH = BLOCK - set("body html tbody td tfoot th thead tr".split())
ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th")}
SCOPES = {"li": set("ul ol menu dir".split()), "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
          "th": {"tr", "table"}}
# Elements, roles and words of class or id that mark what is not the article. What is marked by the loose ones may
# still wrap the article.
JUNK_TAGS = set("nav footer aside menu dialog search".split())
LOOSE_TAGS = {"form"}
JUNK_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
JUNK_WORDS = set("""comment comments commentlist disqus reply replies respond discussion related recommended
recommendations sidebar breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer""".split())
LOOSE_WORDS = set("""ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo
promotion promoted banner cookie cookies consent gdpr notice notices notification notifications alert popup modal
overlay toast newsletter subscribe subscription signup login widget widgets trending share sharing social follow topbar
toolbar masthead copyright form skip""".split())
LAYOUT_WORDS = set("has no with without is".split())        # "has-sidebar" names a neighbour
HEAD_TAGS = set("meta link base title style script noscript template object head".split())

_ATTRIBUTES = r"""(?:[^>=]|=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)?+)*+"""
_MARKUP = re.compile(rf"<(?:(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>|(!--)(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))",
                     re.S)
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""",
                    re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOPS = re.compile(r"[.,;:!?…。，、；：！？।؟،]")


@dataclass(slots=True)
class Mark:
    """A reason to leave out what an element holds; a loose one is void if it turns out to wrap an article."""
    loose: bool
    outer: Mark | None
    void: bool = False
    junk: bool = False          # set at the page's end


@dataclass(slots=True)
class Element:
    tag: str
    path: int                   # of block-level tags, this one included
    parent: int
    mark: Mark | None           # innermost
    link: bool
    article: int                # number of the outermost article, or -1
    main: bool


@dataclass(slots=True)
class Block:
    path: int
    parent: int
    mark: Mark | None
    article: int
    main: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0             # characters inside links, white space aside
    size: int = 0               # characters, white space aside
    text: str = ""


def _attributes(raw: str) -> tuple[list[str], str, bool]:
    """(words of class and id, role, hidden)."""
    words, role, hidden = [], "", False
    for name, *values in _NAMED.findall(raw):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            for one in value.split():
                found = [w.lower() for w in _WORDS.findall(one)]
                if found and found[0] not in LAYOUT_WORDS:
                    words += found
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden |= re.search(r"display\s*:\s*none", value, re.I) is not None
    return words, role, hidden


class Page:
    """The blocks of one page. The tree is rebuilt as far as text needs it: unclosed paragraphs and
    items end where the next begins, end tags without a start are passed over."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.stack = [Element("", 0, 0, None, False, -1, False)]
        self.marks: list[Mark] = []
        self.open: dict[str, int] = {}
        self.articles = 0
        self.unseen = 0             # open elements that show no text
        self.current: Block | None = None
        for kind, tag, value in _tokens(html):
            if kind == "text":
                if not self.unseen:
                    self._text(value)
            elif kind == "start":
                self._start(tag, value)
            else:
                self._end(tag)
        self._flush()
        for m in self.marks:
            m.junk = not m.void or (m.outer is not None and m.outer.junk)

    def _flush(self) -> None:
        if self.current:
            self.current.text = " ".join("".join(self.current.parts).split())
            self.current.size = len(self.current.text) - self.current.text.count(" ")
            if self.current.text:
                self.blocks.append(self.current)
        self.current = None

    def _text(self, value: str) -> None:
        top = self.stack[-1]
        if not self.current:
            if not value.strip():
                return
            heading = any(self.open.get(f"h{k}") for k in range(1, 7))
            self.current = Block(top.path, top.parent, top.mark, top.article, top.main, heading)
        self.current.parts.append(value)
        if top.link:
            self.current.linked += len("".join(value.split()))

    def _start(self, tag: str, raw: str) -> None:
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self._flush() if tag == "hr" else self._break()
            return
        if self.open.get("head") and tag not in HEAD_TAGS:
            self._close("head", set())
        if tag in ENDS_PARAGRAPH and self.open.get("p"):
            self._close("p", {"button", "td", "th", "table"})
        for other in ENDS_ITEM.get(tag, ()):
            if self.open.get(other):
                self._close(other, SCOPES[tag])
        if tag == "a" and self.open.get("a"):
            self._close("a", BLOCK)
        if tag in BLOCK:
            self._flush()
        top = self.stack[-1]
        block = tag in BLOCK
        path, parent = top.path, top.parent
        if block:
            path, parent = self.paths.setdefault((top.path, tag), len(self.paths) + 1), top.path
        article, main, mark = top.article, top.main, top.mark
        words, role, hidden = _attributes(raw) if raw else ([], "", False)
        root = tag in ("article", "main") or role in ("main", "article")
        loose = self._reason(tag, words, role, hidden, root, main or article >= 0)
        if loose is not None:
            mark = Mark(loose, mark)
            self.marks.append(mark)
        elif root:
            m = mark
            while m and not m.void:
                m.void, m = m.loose, m.outer
            if tag == "main" or role == "main":
                main = True
            elif article < 0:
                article = self.articles
                self.articles += 1
        if tag in UNSEEN or tag in RAW:
            self.unseen += 1
        self.stack.append(Element(tag, path, parent, mark, top.link or tag == "a", article, main))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _reason(self, tag: str, words: list[str], role: str, hidden: bool, root: bool, inside: bool) -> bool | None:
        """Whether what an element holds goes: not at all (None), for good (False), or loosely (True)."""
        if hidden:
            return False
        if tag in ("html", "body", "main") or role == "main":
            return None                     # names of the frame tell its layout
        if root:
            words = words[:1]               # "comment even", not "post with comments"
        if tag in JUNK_TAGS or role in JUNK_ROLES or JUNK_WORDS.intersection(words):
            return False
        if tag == "header" or "header" in words:
            return None if inside else True
        if tag in LOOSE_TAGS or LOOSE_WORDS.intersection(words):
            return not root
        return None

    def _break(self) -> None:
        if self.current:
            self.current.parts.append(" ")

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._break()
        elif self.open.get(tag):
            self._close(tag, set() if tag in BLOCK else BLOCK)
        elif tag == "p":
            self._flush()                   # an empty paragraph

    def _close(self, tag: str, fence: set[str]) -> None:
        """Close the innermost `tag` and what is inside, unless an element of `fence` lies between."""
        at = len(self.stack) - 1
        while self.stack[at].tag != tag:
            if self.stack[at].tag in fence:
                return
            at -= 1
        for e in self.stack[at:]:
            self.open[e.tag] -= 1
            if e.tag in BLOCK:
                self._flush()
            if e.tag in UNSEEN or e.tag in RAW:
                self.unseen -= 1
        del self.stack[at:]


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("text", "", decoded), ("start", tag, attributes) and ("end", tag, "") in page order.

    A tag that the page's end cuts off goes, as in browsers; "<" before anything but a name is text.
    """
    at = begin = 0
    while True:
        opens = _OPENS.search(html, at)
        if not opens:
            break
        m = _MARKUP.match(html, opens.start())
        if not m:
            if opens.start() > begin:
                yield "text", "", unescape(html[begin:opens.start()])
            return
        if m.start() > begin:
            yield "text", "", unescape(html[begin:m.start()])
        at = begin = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            yield "end", tag, ""
            continue
        yield "start", tag, m[3]
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if not end:
                return
            at = begin = end.end()
            yield "end", tag, ""
    if begin < len(html):
        yield "text", "", unescape(html[begin:])


def _scores(blocks: list[Block]) -> tuple[dict[int, float], list[float]]:
    """Fused score of each path, and of each block after smoothing."""
    count: dict[int, int] = {}
    plain: dict[int, int] = {}
    stops: dict[int, int] = {}
    for b in blocks:
        count[b.path] = count.get(b.path, 0) + 1
        rest = b.size - b.linked
        plain[b.path] = plain.get(b.path, 0) + rest
        stops[b.path] = stops.get(b.path, 0) + (len(_STOPS.findall(b.text)) if rest > b.linked else 0)
    smooth = []
    for i, b in enumerate(blocks):
        text = stop = weight = 0.0
        for off in range(-2, 3):
            j = i + off
            if 0 <= j < len(blocks):
                other = blocks[j]
                w = NEIGHBOURS[abs(off)] * (1 if other.path == b.path else
                                            SAME_PARENT if other.parent == b.parent else UNRELATED)
                text += w * plain[other.path] / count[other.path]
                stop += w * stops[other.path] / count[other.path]
                weight += w
        smooth.append(text / weight * (1 + stop / weight))
    total: dict[int, float] = {}
    for b, s in zip(blocks, smooth, strict=True):
        total[b.path] = total.get(b.path, 0.0) + s
    return {p: total[p] / count[p] for p in count}, smooth


def _links_only(blocks: list[Block]) -> set[int]:
    """Paths whose text lies in links, but for headings."""
    size: dict[int, int] = {}
    linked: dict[int, int] = {}
    for b in blocks:
        if not b.heading:
            size[b.path] = size.get(b.path, 0) + b.size
            linked[b.path] = linked.get(b.path, 0) + b.linked
    return {p for p in size if size[p] - linked[p] < LEAST_PLAIN * size[p]}


def _kept(page: Page) -> list[Block]:
    blocks = [b for b in page.blocks if not (b.mark and b.mark.junk)]
    inside = [b for b in blocks if b.article >= 0]
    if inside:
        return _articles(inside)
    inside = [b for b in blocks if b.main]
    blocks = inside or blocks
    links = _links_only(blocks)
    blocks = [b for b in blocks if b.path not in links]
    if inside or not blocks:
        return blocks
    scores, smooth = _scores(blocks)
    mean = sum(smooth) / len(smooth)
    least = SPREAD * math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    good = {p for p, s in scores.items() if s >= least}
    homes = {b.parent for b in blocks if b.path in good}
    top = {page.paths.get((0, "html"), 0), page.paths.get((0, "body"), 0), 0}
    top.add(page.paths.get((page.paths.get((0, "html"), 0), "body"), 0))
    # a heading or short list beside kept paragraphs belongs to them, unless their home is the whole page
    return [b for b in blocks if b.path in good or b.parent in homes and (b.heading or b.parent not in top)]


def _articles(blocks: list[Block]) -> list[Block]:
    """Of several articles the full ones stay, teasers go; paths of links inside them go."""
    links = _links_only(blocks)
    blocks = [b for b in blocks if b.path not in links]
    if len({b.article for b in blocks}) < 2:
        return blocks
    scores, smooth = _scores(blocks)
    total: dict[int, float] = {}
    for b, s in zip(blocks, smooth, strict=True):
        total[b.article] = total.get(b.article, 0.0) + s
    best = max(total.values())
    return [b for b in blocks if total[b.article] >= LEAST_ARTICLE * best]


def main_text(html: str) -> str:
    """Blocks of the main text, two line feeds between them; empty if there is none."""
    return "\n\n".join(b.text for b in _kept(Page(html)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of `pages` (page_id, url, html).

    The whole html is read. A null, empty or textless page has an empty text; plain text
    without tags is its own main text. Character references are decoded; white space
    inside a block, no-break spaces and `<br>` included, is one space. Equal rows stay, null
    ids and urls stay null, an empty table stays empty; other columns, whatever their
    names, are ignored. Work and memory are in proportion to a page's length.
    """
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def work(page_id, url, html):
        text = [main_text(h) for h in html]
        return {"page_id": page_id, "url": url, "text": text, "n_chars": [len(t) for t in text]}
    return map_batches(found, "page_id long, url string, text string, n_chars long", work)
