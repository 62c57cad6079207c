"""Main text of web pages by line-block distribution.

Markup is stripped in one pass into lines: one line per block of text, and empty lines for every block that is a menu, a footer, a
sidebar, a form, a script, a style or hidden, by its tag, role or attributes. Over a window of lines that slides down the page,
the lengths of the texts outside links are summed. Where the sum surges above the page's level there is main text; its region ends
where the sum dives to nothing, and all text between stays, with what else stands in the same container.

Blocks that are adverts, notices, comments and the like by class or id alone are left out only where the sums agree: their
windows are held against those of the rest of the page, so that a wrapper or a section of the text with such a name stays.
A page may mark its article. Then the lines outside count as empty ones and the level is zero, so that short paragraphs stay
too; of several marks, those stay whose windows come near the best one's.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

WINDOW = 3
#: Outside a marked article: the least window sum of a region, in characters, and as a share of the page's largest.
LEAST_SUM = 80
LEAST_SHARE = 0.1
#: A block whose class names something else than text stays if its largest window sum is so many times that of the rest of the page.
RESCUE = 4

# Elements of HTML by what they mean for the text.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "math", "iframe", "object", "xmp", "noembed",
        "noframes", "canvas", "audio", "video"}
_AWAY = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "datalist", "fieldset", "label", "input", "head"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
           "ins", "kbd", "mark", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt",
           "u", "var", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NEVER = {"html", "body", "article", "main"}
#: Elements without text that end where they say so.
_SELF_CLOSED = {"svg", "math", "object", "canvas", "audio", "video", "template", "noscript"}
_AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
#: What readers or advertisers wrote, or what leads to other pages.
_OTHERS_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
                 "related", "recommended", "comment", "comments", "commentlist", "discussion", "reply", "replies", "respond", "responses",
                 "disqus", "teaser"}
_AWAY_WORDS = {"banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
               "sidebar", "aside", "widget", "widgets", "share", "sharing", "social", "nav", "navbar", "navigation", "menu", "breadcrumb",
               "breadcrumbs", "footer", "masthead", "newsletter", "subscribe", "subscription", "signup", "login", "search", "toolbar",
               "pagination", "pager", "tags", "copyright", "disclaimer", "skip", "rail"}
#: These only say so outside a marked article, where they may name its own head.
_AWAY_WORDS_OUTSIDE = {"header", "topbar", "logo", "brand"}
#: Words beside those that change nothing: "comment-list", "site-footer", "ad-slot".
_FILLER_WORDS = {"area", "bar", "block", "box", "btn", "buttons", "container", "content", "form", "group", "inner", "left", "link", "links",
                 "list", "main", "message", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section",
                 "site", "slot", "text", "thread", "top", "bottom", "unit", "wrap", "wrapper"}
#: "no-sidebar" and "content-with-sidebar" tell of the page around.
_PAGE_WORDS = {"no", "not", "non", "has", "with", "without", "hide", "hidden"}
#: Class and id say something of these alone.
_CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "header", "figure", "details", "article", "center"}
_TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "figure", "figcaption", "table",
                "thead", "tbody", "tfoot", "tr", "td", "th", "address", "details", "summary", "center"}
#: A stray end tag within a line doesn't close these.
_HOLDERS = {"article", "main", "body", "td", "table"}
#: Elements whose start ends an open paragraph, list item or cell of the same family.
_CLOSED_BY = {"p": {"p", "div", "ul", "ol", "li", "table", "section", "article", "aside", "footer", "header", "nav", "form", "h1", "h2",
                    "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "hr", "main", "address", "dl", "fieldset", "details"},
              "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
              "option": {"option"}}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_ATTRIBUTE_NAME = re.compile(r"[^\s/>=]+|=")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STRONG, _WEAK, _OTHERS = "strong", "weak", "others"


class _Tags:
    """Start and end tags, raw elements and texts of a page, each character looked at a fixed number of times."""

    def __init__(self, html: str):
        self.html, self.size, self.last = html, len(html), html.rfind(">")
        self.no_more = {'"': False, "'": False}  # no such quote stands ahead

    def attributes(self, at: int) -> tuple[int, dict[str, str], bool] | None:
        """(behind the tag, attributes, whether it closes itself) from behind a tag's name on; None if the page ends before the tag."""
        found: dict[str, str] = {}
        html = self.html
        while True:
            at = _SPACE.match(html, at).end()
            if at >= self.size:
                return None
            if html[at] == ">":
                return at + 1, found, html[at - 1] == "/"
            name = _ATTRIBUTE_NAME.match(html, at)
            at, value = name.end(), ""
            equals = _EQUALS.match(html, at)
            if equals:
                at = equals.end()
                quote = html[at:at + 1]
                stop = -1
                if quote in self.no_more and quote and not self.no_more[quote]:
                    stop = html.find(quote, at + 1)
                    self.no_more[quote] = stop < 0
                if stop >= 0:
                    value, at = html[at + 1:stop], stop + 1
                else:
                    bare = _BARE.match(html, at)
                    value, at = bare.group().strip("\"'"), bare.end()
            found.setdefault(name.group().lower(), value)

    def __iter__(self) -> Iterator[tuple[str, str, dict[str, str], bool]]:
        """(kind, tag or text, attributes, closes itself): kind is text, start, end or raw."""
        html, at = self.html, 0
        while at < self.size:
            start = html.find("<", at)
            if start < 0 or start > self.last:  # no tag ends any more
                yield "text", html[at:], {}, False
                return
            if start > at:
                yield "text", html[at:start], {}, False
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                at = end + 3 if end >= 0 else self.size
                continue
            if html.startswith(("<!", "<?"), start):
                at = html.find(">", start) + 1
                continue
            closing = html.startswith("/", start + 1)
            name = _NAME.match(html, start + 1 + closing)
            if not name:
                yield "text", "<", {}, False
                at = start + 1
                continue
            tag = name.group().lower()
            if closing:
                at = html.find(">", name.end()) + 1 or self.size
                yield "end", tag, {}, False
                continue
            rest = self.attributes(name.end())
            if rest is None:  # the page is cut off within the tag
                yield "text", html[start:], {}, False
                return
            at, attributes, closed = rest
            if tag in _RAW:
                yield "raw", tag, attributes, closed
                if not (closed and tag in _SELF_CLOSED):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                    at = end.end() if end else self.size
                continue
            yield "start", tag, attributes, closed


def _is_away(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether tag, role or attributes alone say that a block is none of the text."""
    if tag in _NEVER and tag != "article":
        return False
    return (tag in _AWAY or tag == "header" and not in_article or "hidden" in attributes or attributes.get("role", "").lower() in _AWAY_ROLES
            or attributes.get("aria-hidden", "").lower() == "true")


def _named(tag: str, attributes: dict[str, str], in_article: bool) -> str | None:
    """What class and id say of a block: others' text, surely something else (strong), perhaps (weak), or nothing."""
    if tag not in _CONTAINERS:
        return None
    said = None
    known = _AWAY_WORDS if in_article else _AWAY_WORDS | _AWAY_WORDS_OUTSIDE
    for token in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = {w.lower() for w in _WORDS.findall(token)}
        if words & _PAGE_WORDS:
            continue
        if words & _OTHERS_WORDS and words <= _OTHERS_WORDS | known | _FILLER_WORDS:
            return _OTHERS
        if tag != "article" and words & known:
            said = _STRONG if words <= known | _FILLER_WORDS else said or _WEAK
        elif tag != "article" and words & _OTHERS_WORDS:
            said = said or _WEAK
    return said


class _Lines:
    """The lines of a page: text, characters outside links, mark (-1 for none), named block (-1), container."""

    def __init__(self, html: str):
        self.rows: list[tuple[str, int, int, int, int]] = []
        #: Named blocks: what was said, the block around, whether it stands in a mark, and whether the first mark stands in it.
        self.blocks: list[list] = []
        self._held: list[tuple[str, bool]] = []
        self._stack: list[tuple[str, bool, bool, int]] = []  # tag, left out, marks, own number
        self._places: dict[str, list[int]] = defaultdict(list)  # of open tags, by name
        self._blocks_open: list[int] = []  # places of open tags that are no parts of a line
        self._holders: list[int] = []
        self._away, self._marks, self._links, self._named = 0, [], 0, []
        self._number = 0
        for kind, tag, attributes, closed in _Tags(html):
            if kind == "text":
                if not self._away:
                    self._held.append((tag, self._links > 0))
            elif kind == "end":
                self._end(tag)
            else:
                self._start(kind, tag, attributes, closed)
        self._close(0)
        self._end_line()

    def _gap(self) -> None:
        self.rows.extend([("", 0, -1, -1, -1)] * WINDOW)

    def _end_line(self) -> None:
        if not self._held:
            return
        text = " ".join(unescape("".join(t for t, _ in self._held)).split())
        if text:
            own = len(" ".join(unescape("".join(t for t, linked in self._held if not linked)).split()))
            mark = self._marks[0] if self._marks else -1
            self.rows.append((text, own, mark, self._named[-1] if self._named else -1, self._container()))
        self._held.clear()

    def _container(self) -> int:
        """The element around the block of the open line: of a paragraph or item the next one that is no block of text itself."""
        for k in range(len(self._blocks_open) - 1, max(-1, len(self._blocks_open) - 9), -1):
            tag, _, _, number = self._stack[self._blocks_open[k]]
            if tag not in _TEXT_BLOCKS:
                return number
        return -1

    def _close(self, upto: int) -> None:
        while len(self._stack) > upto:
            tag, is_away, is_marked, number = self._stack[-1]
            if tag not in _INLINE:
                self._end_line()
                self._blocks_open.pop()
            self._stack.pop()
            self._places[tag].pop()
            self._links -= tag == "a"
            if self._holders and self._holders[-1] == len(self._stack):
                self._holders.pop()
            if self._named and self.blocks[self._named[-1]][4] == number:
                self._named.pop()
            if is_away:
                self._away -= 1
                if not self._away:
                    self._gap()
            if is_marked:
                self._marks.pop()
                self._gap()

    def _end(self, tag: str) -> None:
        places = self._places.get(tag)
        if not places:
            return
        if (tag in _INLINE or tag in ("p", "li")) and self._holders and self._holders[-1] > places[-1]:
            return
        self._close(places[-1])

    def _start(self, kind: str, tag: str, attributes: dict[str, str], closed: bool) -> None:
        if tag not in _INLINE:
            if self._blocks_open and tag in _CLOSED_BY.get(self._stack[self._blocks_open[-1]][0], ()):
                self._close(self._blocks_open[-1])
            self._end_line()
        if kind == "raw":
            return
        if tag == "br":
            if not self._away:
                self._held.append((" ", self._links > 0))
            return
        if tag in _VOID or closed and tag not in _NEVER | _AWAY:
            return
        is_away = _is_away(tag, attributes, bool(self._marks))
        is_marked = not is_away and (tag in ("article", "main") or attributes.get("role", "").lower() == "main")
        said = None if is_away or self._away else _named(tag, attributes, bool(self._marks))
        self._number += 1
        if said:
            self.blocks.append([said, self._named[-1] if self._named else -1, bool(self._marks), False, self._number])
            self._named.append(len(self.blocks) - 1)
        if is_marked and said is None and not self._away and not any(b[3] for b in self.blocks):
            for k in self._named:
                self.blocks[k][3] = True
        if is_away or is_marked:
            if not self._away:
                self._end_line()
                self._gap()
        self._away += is_away
        if is_marked:
            self._marks.append(self._number)
        self._links += tag == "a"
        self._places[tag].append(len(self._stack))
        if tag in _HOLDERS:
            self._holders.append(len(self._stack))
        if tag not in _INLINE:
            self._blocks_open.append(len(self._stack))
        self._stack.append((tag, is_away, is_marked, self._number))


def _window_sums(lengths: np.ndarray) -> np.ndarray:
    """The best window of each line."""
    if not len(lengths):
        return lengths
    windows = np.convolve(lengths, np.ones(WINDOW, dtype=np.int64))  # each window that holds a line, by its last line
    return np.max([windows[k:k + len(lengths)] for k in range(WINDOW)], axis=0)


def _left_out(lines: _Lines, own: np.ndarray, block: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Which lines lie in a named block that the sums don't speak for."""
    out = np.zeros(len(own), dtype=bool)
    if not lines.blocks:
        return out
    around = np.array([b[1] for b in lines.blocks] + [-1])
    rest = np.where((block < 0) & (marked if marked.any() else True), own, 0)
    outside = int(_window_sums(rest).max(initial=0))
    order = np.argsort(block, kind="stable")
    first = np.searchsorted(block[order], np.arange(len(lines.blocks) + 1))
    total = [np.array([len(lines.rows[k][0]) for k in order[first[b]:first[b + 1]]], dtype=np.int64) for b in range(len(lines.blocks))]
    gone = np.zeros(len(lines.blocks) + 1, dtype=bool)
    for b, (said, _, in_mark, holds_mark, _) in enumerate(lines.blocks):
        mine = own[order[first[b]:first[b + 1]]]
        inside, prose = int(_window_sums(mine).max(initial=0)), 2 * mine.sum() >= total[b].sum()
        if holds_mark or said == _OTHERS:
            continue
        if said == _STRONG:
            gone[b] = inside < outside * (1 if in_mark else RESCUE)
        else:
            gone[b] = outside > 0 and (not prose or inside < min(LEAST_SUM, LEAST_SHARE * outside))
    others = np.array([b[0] == _OTHERS and not b[3] for b in lines.blocks] + [False])
    for b in range(len(lines.blocks)):  # a block comes behind the one around it
        gone[b] |= gone[around[b]]
        others[b] |= others[around[b]]
    if (np.where(others[block] | gone[block], 0, own) > 0).any():  # there is text that is not of others
        gone |= others
    return gone[block]


def regions(sums: np.ndarray, level: float) -> list[tuple[int, int]]:
    """Runs of lines whose window sum surges above ``level`` somewhere, each up to where the sum has dived to nothing."""
    above = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if sums[a:b].max() > level]


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by line feeds; empty for an empty page or one without text."""
    lines = _Lines(html or "")
    if not lines.rows:
        return ""
    own, mark, block, container = (np.array(c, dtype=np.int64) for c in list(zip(*lines.rows))[1:])
    away = _left_out(lines, own, block, mark >= 0)
    full = np.array([len(r[0]) for r in lines.rows], dtype=np.int64)
    if (full[(mark >= 0) & ~away] > 0).any():
        lengths = np.where((mark >= 0) & ~away, full, 0)
        sums = _window_sums(lengths)
        best = {m: int(sums[mark == m].max()) for m in np.unique(mark[lengths > 0]).tolist()}
        least = LEAST_SHARE * max(best.values())
        chosen = (lengths > 0) & np.isin(mark, [m for m, top in best.items() if top >= least])
    else:
        lengths = np.where(away, 0, own)
        sums = _window_sums(lengths)
        top = int(sums.max())
        level = min(max(LEAST_SUM, LEAST_SHARE * top), top) - 1 if top else 0
        chosen = np.zeros(len(own), dtype=bool)
        for start, stop in regions(sums, level):
            walked = np.flatnonzero(lengths[start:stop] > 0) + start
            chosen[walked[0]:walked[-1] + 1] = True  # lines of links alone at its ends are none of it
        # What a block that is left out divides from the text stays with it: lines of the same container.
        held = np.unique(container[chosen & (lengths > 0)])
        chosen |= (lengths > 0) & np.isin(container, held[held >= 0])
        chosen &= ~away
    return "\n".join(lines.rows[k][0] for k in np.flatnonzero(chosen).tolist() if lines.rows[k][0])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of the text).

    Null html counts as empty, and a page without text has an empty text. Repeated rows give repeated results; an empty
    table gives no rows; further columns are not read. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                      text_of(F.col(f"`{html_col}`")).alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
