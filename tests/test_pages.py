"""HTML body extraction (P23) goldens and the Spark job."""

from echotrace.operators import pages as pg

PAGE = ('<html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>'
        '<!-- c --><div class="ad x" id="m">Ad <b>bold</b> c</div>'
        '<article itemprop="articleBody"><p><b>A &amp; B<br><p>x</p><p>y</p></article></body></html>')


def test_fallback_paragraphs_nest():
    # the unclosed <p> nests: its text is emitted for the outer and the inner one
    assert pg.extract_body(PAGE) == "A & Bxy\nx\ny"


def test_selectors():
    assert pg.extract_body(PAGE, "div.ad#m") == "Adboldc"
    assert pg.extract_body(PAGE, "div.x.ad") == "Adboldc"
    assert pg.extract_body(PAGE, "article p") == "A & Bxy"
    assert pg.extract_body(PAGE, "[itemprop='articleBody']") == "A & Bxy"
    assert pg.extract_body(PAGE, "body div#m b") == "bold"
    assert pg.extract_body(PAGE, "section") == pg.extract_body(PAGE)   # no match -> fallback


def test_empty_and_broken():
    assert pg.extract_body("") == ""
    assert pg.extract_body(None) == ""
    assert pg.extract_body("<p>only</p><p></p>") == "only\n"


def test_spark_job(spark):
    df = spark.createDataFrame([(1, "https://www.news.example.com/a", PAGE), (2, "https://m.b.example.org/x", PAGE),
                                (3, "https://other.net/", "<p>z</p>")], "page_id long, url string, html string")
    sel = {"example.com": "div.ad", "b.example.org": "article p"}
    lit = {r["page_id"]: r["body"] for r in pg.extract_bodies(df, sel).collect()}
    assert lit == {1: "Adboldc", 2: "A & Bxy\nx\ny", 3: "z"}     # literal: key of host 2 is example.org
    suf = {r["page_id"]: r["body"] for r in pg.extract_bodies(df, sel, match="suffix").collect()}
    assert suf == {1: "Adboldc", 2: "A & Bxy", 3: "z"}


def test_reference_map_keys_unreachable_literal(spark):
    df = spark.createDataFrame([(1, "https://www.ytn.co.kr/a", "<div id='CmAdContent'>body</div><p>p</p>")],
                               "page_id long, url string, html string")
    assert pg.extract_bodies(df).first()["body"] == "p"
    assert pg.extract_bodies(df, match="suffix").first()["body"] == "body"
