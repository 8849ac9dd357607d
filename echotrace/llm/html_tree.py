"""Main text of web pages by tree scoring.

Each paragraph passes points (one, plus one per comma, plus one per hundred
characters up to three) to its nearest five containers: all to the first, half to
the second, a ninth, a twelfth, ... above.  A container's points are discounted by
its link density.  The best container, or the article element around it, is kept
with those siblings that score well too.  Ties prefer the container that opens first.

Elements that are no article text by their kind (menus, footers, forms, ...) or by
an unmistakable name (adverts, reader comments, ...) are left out.  Blocks with a
name that may mean either (related, social, notice, ...) pass no points upwards and
are judged by place, length and link density: inside the chosen container they stay
if they hold a paragraph's worth of text outside links.

A page is one row; the work is row-local, needs no shuffle, holds one page at a time
and takes time in proportion to its tags, however deep they nest.  Blocks are runs of
text between block-level tags.

Defined results: null or empty html gives an empty text; broken markup never
fails (an unclosed script or comment swallows the rest, a stray end tag is
ignored); repeated pages get equal texts; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.arrow_text import plain_strings, slices

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: Attributes of an element that closes itself: a slash that is no part of an unquoted value.
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z|^<svg/\Z", re.I)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

LEAVES = frozenset("p li td th pre blockquote h1 h2 h3 h4 h5 h6 dd dt figcaption caption summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section article main ul ol dl table thead tbody tfoot tr figure center details "
                       "address hgroup".split())
BLOCKS = LEAVES | CONTAINERS
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is skipped up to their end tag; only foreign ones (svg) may close themselves.
RAW = frozenset("script style textarea title template iframe svg".split())
#: Elements that never hold article text.
DROPPED = frozenset("nav footer aside form head button select menu dialog".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|nav|navbar|navigation|menus?|"
    r"breadcrumbs?|sidebars?|footers?|masthead|site-header|page-header|cookies?|consent|popups?|modals?|"
    r"newsletters?|subscribe|comments?|comment-list|disqus|replies|pagination|pager|login|signup)(?:$|[\s_-])", re.I)
#: Names that article sections bear as well as what stands around them.
DOUBTFUL_NAMES = re.compile(
    r"(?:^|[\s_-])(?:promos?|banners?|notices?|share|sharing|social|related|recommended|responses|widgets?)(?:$|[\s_-])", re.I)
#: A doubtful block stays from so many characters outside links on, below this link density.
DOUBTFUL_CHARS, DOUBTFUL_LINKS = 80, 0.25
#: A new element of the key closes an open one of the value (up to the nearest of the listed bounds).
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
MIN_PARAGRAPH = 25
#: Containers above a paragraph that get points.
LEVELS = 5


class Page:
    """Block-level tree of one page: parallel lists, children after their parents."""

    def __init__(self, source: str):
        self.tag, self.parent, self.doubtful = ["#root"], [-1], [False]
        self.blocks: list[tuple[int, str, float]] = []  # owner, text, share of link characters
        self._parts: list[str] = []
        self._links = 0
        # open elements: (tag, node or nearest node above, dropped), where each tag and where any block-level one stands
        self._stack: list[tuple[str, int, bool]] = [("#root", 0, False)]
        self._places: dict[str, list[int]] = {}
        self._levels: list[int] = []
        self._read(source)

    def _flush(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                self.blocks.append((self._stack[-1][1], text, min(1.0, self._links / len(text))))
            self._parts, self._links = [], 0

    @staticmethod
    def _is_block(name: str) -> bool:
        return name in BLOCKS or name in DROPPED or name == "header"

    def _push(self, name: str, node: int, dropped: bool) -> None:
        self._places.setdefault(name, []).append(len(self._stack))
        if self._is_block(name):
            self._levels.append(len(self._stack))
        self._stack.append((name, node, dropped))

    def _pop_to(self, place: int) -> None:
        while len(self._stack) > place:
            name = self._stack.pop()[0]
            self._places[name].pop()
            if self._levels and self._levels[-1] == len(self._stack):
                self._levels.pop()

    def _last(self, names: Iterable[str]) -> int:
        return max((self._places[x][-1] for x in names if self._places.get(x)), default=0)

    def _skip(self, source: str, name: str, at: int) -> int:
        """Place behind the end tag of a raw element; svg may nest."""
        depth, tag = 1, re.compile(rf"<(/?){name}(?![A-Za-z0-9:-])[^>]*>", re.I)
        while depth:
            found = tag.search(source, at)
            if not found:
                return len(source)
            at = found.end()
            if found.group(1):
                depth -= 1
            elif name == "svg" and not CLOSED.search(found.group(0)[:-1]):
                depth += 1
        return at

    def _read(self, source: str) -> None:
        at, in_link, end = 0, 0, len(source)
        while at < end:
            found = MARKUP.search(source, at)
            upto = found.start() if found else end
            if upto > at and not self._stack[-1][2]:
                piece = source[at:upto]
                self._parts.append(piece)
                if in_link:
                    self._links += len(piece)
            if not found:
                break
            at = found.end()
            name = found.group(2)
            if name is None:
                continue
            name = name.lower()
            if found.group(1):
                if name == "a":
                    in_link = 0
                self._close(name)
                continue
            attributes = found.group(3)
            if name in VOID:
                if not self._stack[-1][2]:
                    if name == "hr":
                        self._flush()
                    elif name == "br":
                        self._parts.append(" ")
                continue
            if name in RAW:
                if name != "svg" or not CLOSED.search(attributes):
                    at = self._skip(source, name, at)
                continue
            if self._is_block(name):
                self._flush()
                self._imply_end(name)
            self._open(name, attributes)
            if name == "a":
                in_link = 1
        self._flush()

    def _open(self, name: str, attributes: str) -> None:
        _, node, dropped = self._stack[-1]
        if not dropped:
            verdict = self._judge(name, attributes)
            if verdict == "dropped":
                dropped = True
            elif name in BLOCKS:
                self.tag.append(name)
                self.parent.append(node)
                self.doubtful.append(verdict == "doubtful")
                node = len(self.tag) - 1
        self._push(name, node, dropped)

    def _close(self, name: str) -> None:
        block = self._is_block(name)
        if block:
            self._flush()
        place = self._last([name])
        if place and (block or not self._levels or place > self._levels[-1]):
            self._pop_to(place)

    def _imply_end(self, name: str) -> None:
        if name in IMPLIED_END:
            ends, bounds = IMPLIED_END[name]
            bound = self._last(bounds)
            first = min((p[i] for x in ends if (p := self._places.get(x)) and (i := bisect.bisect_right(p, bound)) < len(p)), default=0)
            if first:
                self._pop_to(first)
        # a block element ends an open paragraph, with the inline elements in it
        if self._levels and self._stack[self._levels[-1]][0] == "p":
            self._pop_to(self._levels[-1])

    def _judge(self, name: str, attributes: str) -> str:
        """Whether an element is ``dropped``, ``doubtful`` or neither."""
        if name in DROPPED:
            return "dropped"
        if name == "noscript":  # in a sentence it is text, elsewhere a notice
            return "" if self._levels and self._stack[self._levels[-1]][0] in LEAVES else "dropped"
        if name == "header" and not (self._places.get("article") or self._places.get("main")):
            return "dropped"
        if not attributes:
            return ""
        whole = name in ("html", "body", "article", "main")
        doubtful = False
        for key, a, b, c in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key in ("class", "id") and (not whole or "omment" in value):
                if DROPPED_NAMES.search(value):
                    return "dropped"
                doubtful |= bool(DOUBTFUL_NAMES.search(value))
            if whole and "omment" not in attributes:
                continue
            if key == "role" and value.lower() in DROPPED_ROLES or key == "hidden":
                return "dropped"
            if key == "aria-hidden" and value.lower() == "true":
                return "dropped"
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "dropped"
        return "doubtful" if doubtful and name in BLOCKS else ""


def main_blocks(source: str) -> list[str]:
    """Blocks of the main text, in page order."""
    page = Page(source)
    n = len(page.tag)
    points, chars, links = [0.0] * n, [0.0] * n, [0.0] * n
    for owner, text, linked in page.blocks:
        chars[owner] += len(text)
        links[owner] += linked * len(text)
        if len(text) < MIN_PARAGRAPH or page.tag[owner] in HEADINGS:
            continue
        gain = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - linked)
        node = owner
        if page.tag[owner] in LEAVES:
            node = page.parent[owner] if not page.doubtful[owner] else -1
        for level in range(LEVELS):
            if node < 0:
                break
            points[node] += gain / (1 if level == 0 else 2 if level == 1 else 3 * (level + 1))
            node = page.parent[node] if not page.doubtful[node] else -1
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        links[page.parent[i]] += links[i]
    density = [l / c if c else 0.0 for l, c in zip(links, chars)]
    score = [p * (1 - d) for p, d in zip(points, density)]
    best = max(range(n), key=lambda i: (not page.doubtful[i], score[i], -i))
    if score[best] <= 0:
        whole = [i for i in range(n) if page.tag[i] in ("article", "main") and chars[i]]
        kept = {whole[0] if whole else 0}
        lists = set() if whole else {i for i in range(n) if page.tag[i] in ("ul", "ol", "dl", "table") and density[i] >= 0.5}  # menus
        return _texts(page, kept, chars, density, lists)
    above = page.parent[best]
    while above > 0:
        if page.tag[above] in ("article", "main") and density[above] < 0.5:
            best = above
        above = page.parent[above]
    kept = {best}
    if page.tag[best] not in ("article", "main", "body", "html", "#root"):
        limit = max(10.0, 0.2 * score[best])
        for i in range(1, n):
            if page.parent[i] == page.parent[best] and i != best and chars[i] and not page.doubtful[i]:
                good_leaf = page.tag[i] in LEAVES and density[i] < 0.25 and (chars[i] > 80 or page.tag[i] in ("h1", "h2"))
                if score[i] >= limit or good_leaf:
                    kept.add(i)
    elif page.tag[best] == "article":
        # a page of several articles in one container
        for i in range(1, n):
            if page.parent[i] == page.parent[best] and page.tag[i] == "article" and score[i] >= 0.2 * score[best]:
                kept.add(i)
    return _texts(page, kept, chars, density, set())


def _texts(page: Page, kept: set[int], chars: list[float], density: list[float], out: set[int]) -> list[str]:
    """Texts of the blocks inside ``kept`` nodes, but not inside ``out`` or doubtful blocks that say too little."""
    inside = [False] * len(page.tag)
    for i in range(len(page.tag)):
        inside[i] = i in kept or (i > 0 and inside[page.parent[i]])
        if i in out or inside[i] and page.doubtful[i] and not (
                density[i] < DOUBTFUL_LINKS and chars[i] * (1 - density[i]) >= DOUBTFUL_CHARS):
            inside[i] = False
    return [t for o, t, _ in page.blocks if inside[o]]


def extract(pages: DataFrame, key: tuple[str, ...] = ("page_id", "url"), markup: str = "html") -> DataFrame:
    """``key`` columns, text, n_chars: one row per row of ``pages``."""
    chosen = pages.select(*key, F.col(markup).alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*key).schema) + ", text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = ["\n\n".join(main_blocks(x)) for x in plain_strings(part.column("__html")).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in key] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*key, "text", "n_chars"])

    return chosen.mapInArrow(run, schema)
