import math
import re

from echotrace.llm import url_templates as U

SCHEMA = "page_id long, url string, html string, host string, verdict string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in urls], SCHEMA).select("page_id", "url")


def shape(path, depth=1000):
    parts = [p for p in path.split("/") if p]

    def seg(x):
        m = re.search(r"\.[A-Za-z]{1,5}$", x)
        ext = m.group() if m else ""
        stem = re.sub(r"\.[A-Za-z]{1,5}$", "", x)
        kind = ("{n}" if re.search(r"^[0-9]+$", stem) else "{hex}" if re.search(r"^[0-9a-fA-F-]{16,}$", stem)
                else "{mixed}" if re.search("[0-9]", stem) else stem)
        return kind + ext
    return tuple(seg(p) for p in parts[:depth]) + (("**",) if len(parts) > depth else ())


def brute(urls, bad, depth=1000, min_support=5, z=1.96, smooth=4.0, reject_at=0.5):
    rows = []
    for i, u in urls:
        rest = u[u.index("://") + 3:] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rows.append([i, host, path, shape(path, depth), ""])
    for level in range(1 + max((len(r[3]) for r in rows), default=0)):
        count = {}
        for r in rows:
            if len(r[3]) > level:
                c = count.setdefault((r[1], r[4]), {}).setdefault(r[3][level], [0, 0])
                if r[0] in bad:
                    c[0] += 1
                    c[1] += bad[r[0]]
        names = {}
        for node, children in count.items():
            p = sum(c[1] for c in children.values()) / max(1, sum(c[0] for c in children.values()))
            off = lambda share, of, n: abs(share - of) > z * math.sqrt(of * (1 - of) / max(n, 1))
            bands = {}
            for s, (n, b) in children.items():
                names[node + (s,)] = "*"
                if n >= min_support and off(b / max(n, 1), p, n):
                    bands.setdefault(min(4, math.floor(5 * (b / max(n, 1)))), {})[s] = (n, b)
            for k, members in bands.items():
                n_all, b_all = (sum(x[i] for x in members.values()) for i in (0, 1))
                for s, (n, b) in members.items():
                    names[node + (s,)] = s if n == n_all or off(b / n, b_all / n_all, n) else f"*{k}"
        for r in rows:
            if len(r[3]) > level:
                r[4] += "/" + names[(r[1], r[4], r[3][level])]
    lab = [r for r in rows if r[0] in bad]
    g = sum(bad[r[0]] for r in lab) / max(1, len(lab))
    out = {}
    for i, host, path, _, t in rows:
        h = [bad[r[0]] for r in lab if r[1] == host]
        x = [bad[r[0]] for r in lab if r[1] == host and r[4] == t]
        hs = (sum(h) + smooth * g) / (len(h) + smooth)
        share = (sum(x) + smooth * hs) / (len(x) + smooth)
        rules = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(rules, key=lambda r: len(r.text)) if rules else None
        out[i] = (host, path, rule.text if rule else None, rule.verdict if rule else "block" if share >= reject_at else "allow", t)
    return out


def test_against_brute_force(spark):
    urls = [(i, f"https://site{i % 3}.org/{'news' if i % 4 else 'spam'}/{i}/{'a' if i % 2 else 'b'}.html?x=1#y") for i in range(300)]
    urls += [(1000, None), (1001, "no scheme"), (1002, "http://"), (1003, "HTTP://WWW.Example.COM/en/5"), (1004, "x://example.com/en/1"),
             (1005, "x://a.net/es/1"), (1006, "x://a.net/ES/1"), (1007, "x://net/fr/"), (1008, "x://h.org?q://z/"), (1009, "x://h.org/" + "a/" * 900),
             (1010, "x://notcom/"), (1011, "x://É.com/É"), (1012, "a://b://c/d"), (7, urls[7][1]), (7, urls[7][1])]
    bad = {i: int(i % 4 == 0 or i % 10 == 3) for i in range(300) if i % 5}
    labels = spark.createDataFrame([(i, b) for i, b in bad.items()] + [(3, None), (None, 1), (99999, 1)], "doc_id long, bad int")
    got = U.judge(pages(spark, urls), labels).collect()
    assert len(got) == len(urls)
    want = brute(urls, bad | {7: bad.get(7, 0)})
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.template) == want[r.page_id], r
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, bad int")
    assert U.judge(pages(spark, []), none).count() == 0
    assert [r.verdict for r in U.judge(pages(spark, [(1, "http://q.org/a")]), none).collect()] == ["allow"]
    raw = spark.createDataFrame([(1, None, None), (2, 0, None), (3, 1, 1), (4, None, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.bad for r in U.page_labels(raw).collect()} == {1: None, 2: 1, 3: 1, 4: 0, 5: 0}


def test_branches_that_part_below_the_fourth_segment(spark):
    urls = [(i, f"https://deep.org/blog/a/b/c/{'spam' if i % 2 else 'news'}/d/{'x' if i % 3 else 'y'}/{'p/' * (i % 7)}end") for i in range(240)]
    urls += [(500, "https://deep.org/" + "q/" * 900)]
    bad = {i: int(i % 2 == 1 or i % 12 == 0) for i in range(240)}
    labels = spark.createDataFrame(list(bad.items()), "doc_id long, bad int")
    got = U.judge(pages(spark, urls), labels).collect()
    want = brute(urls, bad, depth=1000)
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.template) == want[r.page_id], r
    assert {r.verdict for r in got if r.page_id % 2 and r.page_id < 240} == {"block"} and "allow" in {r.verdict for r in got}


def test_query_reads_all_segments(spark, tmp_path):
    from echotrace.llm.queries import op5_url_filter

    urls = [(i, f"https://deep.org/blog/a/b/c/{'spam' if i % 2 else 'news'}/x", None, "clash", "clash") for i in range(80)]
    spark.createDataFrame(urls, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {(r.page_id % 2, r.verdict) for r in op5_url_filter(spark, str(tmp_path)).collect()}
    assert got == {(1, "block"), (0, "allow")}


def test_branches_like_one_another_merge(spark, tmp_path):
    """Two bad branches and two middling ones, unlike their node: each pair one wildcard; the SQL agrees at any depth."""
    import duckdb

    from echotrace.llm import queries

    rows, bad = [], {}
    shares = {"casino": 0.9, "pills": 0.9, "forum": 0.5, "talk": 0.5, "odd": 0.25, "news": 0.0, "docs": 0.0, "help": 0.0, "team": 0.0}
    for name, share in shares.items():
        for _ in range(60):
            i = len(rows)
            rows.append((i, f"https://one.org/{name}/{'deep/' * (i % 3)}{i}", None, "clash", "clash"))
            bad[i] = int(i % 20 < 20 * share)
    rows += [(5000 + i, f"https://two.org/1/2/a/b/{'s' if i % 2 else 't'}/x", None, "clash", "clash") for i in range(200)]
    bad |= {5000 + i: i % 2 for i in range(200)}
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op5_url_filter(spark, str(tmp_path)).collect()
    want = brute([(i, u) for i, u, *_ in rows], bad)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict, r.template) == want[r.page_id], r
    first = {r.path.split("/")[1]: r.template.split("/")[1] for r in got if r.host == "one.org"}
    assert first["casino"] == first["pills"] == "*4" and first["forum"] == first["talk"] == "*2" and first["news"] == "*0"
    assert {(r.page_id % 2, r.verdict) for r in got if r.host == "two.org"} == {(1, "block"), (0, "allow")}
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    by_sql = con.sql(queries.SQL["op5_url_filter"]).fetchall()
    assert sorted(by_sql) == sorted((r.page_id, r.host, r.path, r.rule, r.verdict, r.template) for r in got)
