import html
import html.parser
import re

from echotrace.llm import html_tree as H

ARTICLE = ("<p>First paragraph, with a comma, and enough text to count as a paragraph.</p>"
           "<p>Second one &amp; more,\n  text with <b>bold</b> and <a href=x>a link</a>&nbsp;here.<p>Third, unclosed and long enough to score.")
WANT = ["First paragraph, with a comma, and enough text to count as a paragraph.",
        "Second one & more, text with bold and a link here.", "Third, unclosed and long enough to score."]


def test_article_without_the_rest():
    page = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><p>Site header, long enough,"
            " to count.</p></header><nav><ul><li><a href=/>Home</a></ul></nav><!-- ad <p>no</p> --><div class='ad box'>Buy now, it is cheap,"
            " and very good indeed.</div><div id=main><article>" + ARTICLE + "</article><div class='comments'><p>Reader comment, long enough, to"
            " count too.</p></div></div><aside>Aside, text, text, text, text, text.</aside><form><p>Form text, which is long, too, yes.</p></form>"
            "<footer>&copy; Footer, text</footer></body></html>")
    assert H.main_blocks(page) == WANT


def test_scoring_without_semantic_tags():
    links = "".join(f"<li><a href=/{i}>Some link text, with commas, number {i}</a></li>" for i in range(30))
    page = f"<div><ul>{links}</ul></div><div><h1>Title</h1>{ARTICLE}</div><div><p>Short.</p></div>"
    assert H.main_blocks(page) == ["Title"] + WANT
    siblings = f"<div class=x>{ARTICLE}</div><div class=y>{ARTICLE}</div>"
    assert H.main_blocks(f"<body><section>{siblings}</section></body>") == WANT + WANT


def test_broken_markup_and_edges(spark):
    cases = [None, "", "plain text only", "<", "<p", "<p>a < b & c &lt;d&gt; &#233; &unknown;", "<script>never closed <p>x</p>", "<!-- never closed",
             "</div></p><p>stray end tags are ignored here, yes</b></p>", "<div hidden><p>Hidden text, which is long enough, gone.</p></div>",
             "<a " + '"' * 1001, "<p>" * 3000 + "deep, deep text that is long enough to count" + "</p>" * 3000]
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(i, "u", c, "clash", 1) for i, c in enumerate(cases)] + [(0, "u", None, "clash", 1), (None, None, "<p>x</p>", "clash", 1)]
    got = H.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[0] == by[1] == by[6] == by[7] == by[9] == "" and by[2] == "plain text only"
    assert by[5] == "a < b & c <d> é &unknown;" and by[8] == "stray end tags are ignored here, yes"
    assert by[11].startswith("deep, deep") and all(r.n_chars == len(r.text) for r in got)
    assert H.extract(spark.createDataFrame([], schema)).count() == 0


LONG = "This passage is long enough to be a paragraph of its own, with commas, and it says something about the matter at hand."


def test_scripts_never_close_themselves():
    for raw in ("<script src=https://x.org/a/>CODE, more code, and more</script>", "<style media=all/>p{}, q{}, r{}</style>",
                "<script async />CODE</script>", "<title x=/>T</title>", "<svg viewBox='0 0'/>", "<svg/>",
                "<svg><svg><text>icon</text></svg> more </svg>", "<textarea rows=2/>typed</textarea>"):
        assert H.main_blocks(f"<body>{raw}<article>{raw}{ARTICLE}</article>") == WANT, raw


def test_article_sections_by_score_not_by_name():
    for name in "related social share banner notice promo widget responses".split():
        section = f"<section id={name}><h2>About {name}</h2><p>{LONG}</p></section>"
        assert H.main_blocks(f"<body><article>{ARTICLE}</p>{section}</article></body>") == [*WANT, f"About {name}", LONG], name
        links = "".join(f"<li><a href=/{i}>Another article, number {i}</a></li>" for i in range(9))
        around = f"<div class='box {name}'><ul>{links}</ul></div><div class={name}>Short, one line.</div>"
        assert H.main_blocks(f"<body><article>{ARTICLE}</p>{around}</article>{around}<div class={name}><p>{LONG}</p></div></body>") == WANT, name
    assert H.main_blocks(f"<article>{ARTICLE}</p><div class=comments><p>{LONG}</p></div><div class='ad box'><p>{LONG}</p></div></article>") == WANT


def test_inline_elements_keep_their_text():
    page = (f"<article>{ARTICLE}</p><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is <object data=x>an object</object>,"
            " <noscript>plain</noscript> and <canvas>drawn</canvas>, nothing else at all.</p><noscript>Enable it, please, now.</noscript></article>")
    assert H.main_blocks(page) == [*WANT, "The sum a+b is an object, plain and drawn, nothing else at all."]


def test_links_stay_when_nothing_scores():
    assert H.main_blocks("<p><a href=x>One link</a></p><ul><li><a href=a>A</a><li><a href=b>B</a></ul>") == ["One link"]
    assert H.main_blocks("<article><ul><li><a href=a>A</a></ul><p>b</article>") == ["A", "b"]


def test_deep_nesting_takes_linear_time():
    import time

    pages = {
        "divs": "<div>" * 50_000 + f"<p>{LONG}</p>",
        "paragraphs": f"<div><p>{LONG}" * 20_000,
        "stray ends": "<div>" * 50_000 + "</section></i></li>" * 50_000 + f"<p>{LONG}</p>",
        "items": "<ul><li>" + "<div>" * 50_000 + "<dt></dt><td></td></b>" * 50_000 + f"<p>{LONG}</p>",
        "inline": "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000 + LONG,
    }
    for name, page in pages.items():
        began = time.process_time()
        assert LONG in H.main_blocks(page), name
        assert time.process_time() - began < 8, name


class PlainTree(html.parser.HTMLParser):
    """Pages of proper markup (only paragraphs may stay open) as nested lists, by the standard parser."""

    BLOCK = set("html body div section article main ul ol p li h1 h2 blockquote nav footer head title style script aside form".split())

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["#root", []]
        self.open, self.text, self.linked = [self.root], [], 0
        self.in_link = False
        self.feed(source)
        self.close()
        self.end_block()

    def end_block(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.open[-1][1].append((text, min(1.0, self.linked / len(text))))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.in_link = True
        if tag == "br":
            self.text.append(" ")
        if tag in self.BLOCK:
            self.end_block()
            if self.open[-1][0] == "p":
                self.open.pop()
            name = "aside" if ("class", "ad") in attrs else tag
            node = [name, []]
            self.open[-1][1].append(node)
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = False
        if tag in self.BLOCK:
            self.end_block()
            at = max((i for i, x in enumerate(self.open) if x[0] == tag or x[0] == "aside" and tag == "div"), default=0)
            if at:
                del self.open[at:]

    def handle_data(self, data):
        self.text.append(data)
        self.linked += len(data) * self.in_link


def plain_main_text(source):
    """The scoring rules once more, by recursion over nested lists."""
    def without(node):
        return [node[0], [without(c) if isinstance(c, list) else c for c in node[1]
                          if not (isinstance(c, list) and c[0] in ("nav", "footer", "head", "title", "style", "script", "aside", "form"))]]

    root = without(PlainTree(source).root)
    leaf = {"p", "li", "h1", "h2", "blockquote"}
    order, up = [], {}

    def visit(node, above):
        up[id(node)] = above
        order.append(node)
        for c in node[1]:
            if isinstance(c, list):
                visit(c, node)

    visit(root, None)
    texts = lambda node: [x for c in node[1] for x in (texts(c) if isinstance(c, list) else [c])]
    own = lambda node: [c for c in node[1] if not isinstance(c, list)]
    size = {id(x): sum(len(t) for t, _ in texts(x)) for x in order}
    density = {id(x): sum(len(t) * s for t, s in texts(x)) / size[id(x)] if size[id(x)] else 0.0 for x in order}
    points = {id(x): 0.0 for x in order}
    for x in order:
        for text, linked in own(x):
            if len(text) < 25 or x[0] in ("h1", "h2"):
                continue
            to = up[id(x)] if x[0] in leaf else x
            for part in (1, 2, 9, 12, 15):
                if to is not None:
                    points[id(to)] += (1 + text.count(",") + min(3, len(text) // 100)) * (1 - linked) / part
                    to = up[id(to)]
    score = {k: v * (1 - density[k]) for k, v in points.items()}
    best = max(order, key=lambda x: score[id(x)])  # the first of equal ones
    assert score[id(best)] > 0
    to = best
    while up[id(to)] is not None:
        to = up[id(to)]
        if to[0] in ("article", "main") and density[id(to)] < 0.5:
            best = to
    beside = [x for x in order if up[id(x)] is up[id(best)] and size[id(x)]] if best is not root else []
    kept = [best]
    for x in beside:
        if best[0] == "article":
            wanted = x[0] == "article" and score[id(x)] >= 0.2 * score[id(best)]
        elif best[0] in ("main", "body", "html"):
            wanted = False
        else:
            wanted = score[id(x)] >= max(10.0, 0.2 * score[id(best)]) or (
                x[0] in leaf and density[id(x)] < 0.25 and (size[id(x)] > 80 or x[0] in ("h1", "h2")))
        if wanted and x is not best:
            kept.append(x)
    return [t for x in order if any(x is k for k in kept) for t, _ in texts(x)]


def random_page(rng):
    words = ["alpha", "beta,", "gamma", "delta.", "epsilon", "zeta,", "&amp;", "eta"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def link():
        return f"<a href=/x>{say(rng.randrange(1, 6))}</a>"

    def block(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.45:
            inner = say(rng.randrange(0, 40)) + (" " + link() if rng.random() < 0.3 else "") + rng.choice(["", "<br>", "<b>bold</b> one"])
            return f"<p>{inner}" + ("</p>" if rng.random() < 0.8 else "")
        if kind < 0.55:
            return "<ul>" + "".join(f"<li>{link() if rng.random() < 0.7 else say(12)}</li>" for _ in range(rng.randrange(1, 7))) + "</ul>"
        if kind < 0.65:
            return f"<h1>{say(3)}</h1>"
        if kind < 0.72:
            return f"<{(t := rng.choice(['nav', 'footer', 'aside', 'form']))}>" + "".join(block(depth + 1) for _ in range(2)) + f"</{t}>"
        tag = rng.choice(["div", "div", "section", "blockquote" if depth > 3 else "div", "article" if depth == 1 and rng.random() < 0.1 else "div"])
        return f"<{tag}>" + rng.choice(["", say(8)]) + "".join(block(depth + 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    return "<html><body>" + f"<p>{LONG}</p>" + "".join(block(1) for _ in range(rng.randrange(1, 8))) + "</body></html>"


def test_random_pages_against_plain_scoring():
    import random

    rng = random.Random(12)
    for nr in range(400):
        page = random_page(rng)
        assert H.main_blocks(page) == plain_main_text(page), (nr, page)


def test_all_pages_against_plain_scoring(spark):
    from echotrace.llm import queries

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in queries.op10_main_text(spark, "/root/testdata/sf0.01").collect():
        assert r.text == "\n\n".join(plain_main_text(source[r.page_id]))
        bare = re.sub(r"</?article>", "", source[r.page_id])
        assert H.main_blocks(bare) == plain_main_text(bare)


def test_all_pages_against_the_article_element(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in H.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b)
