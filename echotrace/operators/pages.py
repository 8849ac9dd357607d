"""Article body extraction from stored HTML pages (with P8, F8).

The reference fetches a page, picks a CSS selector by the page's domain key
and returns the selected element's text; when there is no selector or it
finds nothing it joins the text of every ``<p>`` with newlines.

Spark plan: the domain key (P8) and the selector lookup are JVM-side — an
equi-join of the host's key (or its label suffixes) with the (domain,
selector) table.  Only the HTML parsing runs in Python, as an Arrow-batched
``mapInPandas`` over ``(page_id, html, selector)``; each page is parsed once
in the whole job, and other jobs join the extracted bodies by page.

The parser is an element stack over the standard library tokenizer: void
elements close at once, an end tag closes the most recent open element of
that name (or is ignored), an unclosed ``<p>`` nests so its text also counts
for the outer one; script, style and comment text is not text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.functions.text import domain_key, url_host

# Domain key -> CSS selector of the article body, as in the
# reference (a key is the last two labels of the host in the default mode).
SELECTOR_MAP = {
    "n.news.naver.com": "article#dic_area",
    "m.sports.naver.com": "div._article_content",
    "m.entertain.naver.com": "article#comp_news_article div._article_content",
    "imbc.com": "div.news_txt[itemprop='articleBody']",
    "ytn.co.kr": "div#CmAdContent",
    "mt.co.kr": "div#textBody[itemprop='articleBody']",
    "heraldcorp.com": "article.article-body#articleText",
    "hankookilbo.com": "div.col-main[itemprop='articleBody']",
    "edaily.co.kr": "div.news_body[itemprop='articleBody']",
    "fnnews.com": "div#article_content",
    "seoul.co.kr": "div#articleContent .viewContent",
    "pressian.com": "div.article_body",
    "kbs.co.kr": "div#cont_newstext",
    "hani.co.kr": "div.article-text",
    "nocutnews.co.kr": "div#pnlContent",
    "asiae.co.kr": "div.article.fb-quotable#txt_area",
    "mediatoday.co.kr": "article#article-view-content-div",
    "khan.co.kr": "div#articleBody",
    "sedaily.com": "div.article_view[itemprop='articleBody']",
    "imaeil.com": "div#articlebody[itemprop='articleBody']",
    "ebn.co.kr": "article#article-view-content-div",
    "kyeongin.com": "div#article-body",
    "obsnews.co.kr": "article#article-view-content-div",
    "incheonilbo.com": "article#article-view-content-div",
}

VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split())
NON_TEXT = frozenset(["script", "style", "template"])


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("[document]", {}, None)
        self.stack = [self.root]
        self.buf: list[str] = []

    def _flush(self):
        if self.buf:
            text = "".join(self.buf)
            self.buf = []
            if self.stack[-1].tag not in NON_TEXT:
                self.stack[-1].children.append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        node = _Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)
        if tag not in VOID_ELEMENTS:
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self._flush()
        node = _Node(tag, {k: (v if v is not None else "") for k, v in attrs}, self.stack[-1])
        self.stack[-1].children.append(node)

    def handle_endtag(self, tag):
        self._flush()
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.buf.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def close(self):
        super().close()
        self._flush()


def _iter(node: _Node):
    """Elements in document order (pre-order), excluding the root."""
    todo = list(reversed([c for c in node.children if isinstance(c, _Node)]))
    while todo:
        n = todo.pop()
        yield n
        todo.extend(reversed([c for c in n.children if isinstance(c, _Node)]))


def _text(node: _Node) -> str:
    """``get_text(strip=True)``: every text piece stripped, empties dropped,
    joined with no separator."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            s = n.strip()
            if s:
                out.append(s)
        elif n.tag not in NON_TEXT:
            todo.extend(reversed(n.children))
    return "".join(out)


_COMPOUND = re.compile(r"""([#.][\w-]+)|\[\s*([\w-]+)\s*(?:=\s*(?:'([^']*)'|"([^"]*)"|([^\]\s]*)))?\s*\]""")


def _parse_compound(s: str):
    m = re.match(r"[a-zA-Z][\w-]*|\*", s)
    tag = None
    pos = 0
    if m:
        tag = None if m.group(0) == "*" else m.group(0).lower()
        pos = m.end()
    ids, classes, attrs = [], [], []
    for mm in _COMPOUND.finditer(s, pos):
        if mm.group(1):
            (ids if mm.group(1)[0] == "#" else classes).append(mm.group(1)[1:])
        else:
            val = next((v for v in mm.group(3, 4, 5) if v is not None), None)
            attrs.append((mm.group(2).lower(), val))
    return tag, ids, classes, attrs


def parse_selector(sel: str):
    """Supported grammar: ``tag``, ``#id``, ``.class`` (several), ``[attr='v']``
    and the descendant combinator (a space)."""
    return [_parse_compound(part) for part in sel.split()]


def _matches(node: _Node, comp) -> bool:
    tag, ids, classes, attrs = comp
    if tag is not None and node.tag != tag:
        return False
    if ids and any(node.attrs.get("id") != i for i in ids):
        return False
    if classes:
        have = node.attrs.get("class", "").split()
        if any(c not in have for c in classes):
            return False
    for name, val in attrs:
        if name not in node.attrs or (val is not None and node.attrs[name] != val):
            return False
    return True


def _matches_chain(node: _Node, chain) -> bool:
    if not _matches(node, chain[-1]):
        return False
    rest, anc = chain[:-1], node.parent
    while rest:
        while anc is not None and anc.tag != "[document]" and not _matches(anc, rest[-1]):
            anc = anc.parent
        if anc is None or anc.tag == "[document]":
            return False
        rest, anc = rest[:-1], anc.parent
    return True


def select_one(root: _Node, selector: str) -> _Node | None:
    chain = parse_selector(selector)
    if not chain:
        return None
    for n in _iter(root):
        if _matches_chain(n, chain):
            return n
    return None


def parse_html(html: str) -> _Node:
    b = _TreeBuilder()
    b.feed(html or "")
    b.close()
    return b.root


def extract_body(html: str | None, selector: str | None = None) -> str:
    """Selected element's text, else the text of every ``<p>`` joined by
    newlines; any parsing failure gives ''."""
    if html is None:
        return ""
    try:
        root = parse_html(html)
        if selector:
            hit = select_one(root, selector)
            if hit is not None:
                return _text(hit)
        return "\n".join(_text(n) for n in _iter(root) if n.tag == "p")
    except Exception:  # noqa: BLE001 — the reference turns any failure into ''
        return ""


# ---------------------------------------------------------------- Spark plan
def selector_table(spark, selectors: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """(domain, selector) table of any length; it is joined by domain."""
    if isinstance(selectors, DataFrame):
        return selectors.select(F.col(selectors.columns[0]).alias("domain"),
                                F.col(selectors.columns[1]).alias("selector"))
    items = sorted((selectors if selectors is not None else SELECTOR_MAP).items())
    schema = T.StructType([T.StructField("domain", T.StringType()), T.StructField("selector", T.StringType())])
    return spark.createDataFrame(items, schema)


def with_selector(pages: DataFrame, selectors=None, url: str = "url", match: str = "literal") -> DataFrame:
    """Adds ``selector`` (null when the page's domain has none).

    ``literal``: the key is the last two host labels (the reference's rule,
    under which keys such as ``ytn.co.kr`` never match).  ``suffix``: the
    longest map key equal to the host or to one of its label suffixes."""
    sel = selector_table(pages.sparkSession, selectors)
    if match == "literal":
        keyed = pages.withColumn("_dk", domain_key(url))
        return (keyed.join(sel.withColumnRenamed("domain", "_dk"), "_dk", "left").drop("_dk"))
    if match != "suffix":
        raise ValueError("match must be 'literal' or 'suffix'")
    labels = F.split(url_host(url), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    keyed = pages.withColumn("_pid", F.monotonically_increasing_id())
    cand = (keyed.select("_pid", F.posexplode(suffixes).alias("_depth", "domain"))
                 .join(sel, "domain")
                 .groupBy("_pid").agg(F.min_by("selector", "_depth").alias("selector")))
    return keyed.join(cand, "_pid", "left").drop("_pid")


_OUT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                     T.StructField("body", T.StringType())])


def _extract_batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        bodies = [extract_body(h, s if isinstance(s, str) else None)
                  for h, s in zip(pdf["html"], pdf["selector"])]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "body": bodies})


def extract_bodies(pages: DataFrame, selectors=None, match: str = "literal") -> DataFrame:
    """``(page_id, url, body)`` for every page."""
    p = with_selector(pages.select("page_id", "url", "html"), selectors, "url", match)
    return p.select("page_id", "url", "html", "selector").mapInPandas(_extract_batches, _OUT)
