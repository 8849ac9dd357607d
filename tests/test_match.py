"""End-to-end matching on a tiny fixture."""

from echotrace.plans import match

BODY = "Officials said the new bridge will open next spring after years of delay and rising costs. " * 4


def test_match_end_to_end(spark):
    posts = spark.createDataFrame([
        (1, "Bridge opens", BODY + " Copied.", "bridge", "a", None),
        (2, "Nothing", "zzz qqq", "zzz", "b", None),
    ], "idx long, title string, content string, keyword string, account string, url string")
    arts = spark.createDataFrame([
        (10, "https://n.news.portal.example/mnews/article/001/10", BODY),
        (11, "https://n.news.portal.example/mnews/article/002/11", BODY),    # id not in the news list
        (12, "https://bad.example.com/12", BODY),                              # excluded domain
        (13, "https://ok.example.com/13", "bridge spring " * 5),               # body too short
        (14, "https://ok.example.com/14", BODY + " extra words here"),
    ], "article_id long, link string, body string")
    dct = spark.createDataFrame([("bridge", "ncn")], "surface string, tag string")
    p = match.MatchParams(k=5, excluded_domains=["bad.example.com"], portal="portal.example",
                          channels={"n.news.portal.example": ["001"]})
    res = {r["idx"]: (r["article_link"], r["copy_ratio"]) for r in match.match_posts(posts, arts, dct, p).collect()}
    assert res[2] == ("", 0.0)
    link, ratio = res[1]
    assert link in ('=HYPERLINK("https://n.news.portal.example/mnews/article/001/10")',
                    '=HYPERLINK("https://ok.example.com/14")')
    assert 0.9 <= ratio <= 1.0
    cands = {r["article_id"] for r in match.candidates(posts, arts, dct, p).collect()}
    assert cands == {10, 14}
    stats = match.bucket_stats(match.match_posts(posts, arts, dct, p)).first().asDict()
    assert stats == {"matched": 1, "ge50": 0, "ge90": 1, "gt0": 0}
    rep = match.with_stats_rows(match.match_posts(posts, arts, dct, p))
    labels = [r["label"] for r in rep.where("label IS NOT NULL").orderBy("stat_pos").collect()]
    assert labels == match.STAT_LABELS
    assert rep.where("label = '매칭건수'").first()["count_text"] == "1건"


def test_stored_terms_are_read_without_an_exchange(spark):
    """The matching job twice with stored term tables: same rows, and the tables stand under their joins as they are."""
    import re
    import uuid

    from echotrace.operators import score
    from echotrace.plans import catalog, fixtures

    sf = "/root/testdata/sf0.001"
    posts, arts, words = catalog._match_inputs(spark, sf)
    names = tuple(f"terms_{side}_{uuid.uuid4().hex}" for side in ("a", "b"))
    plain = match.MatchParams(**catalog.MATCH.__dict__)
    stored = match.MatchParams(**{**catalog.MATCH.__dict__, "term_tables": names, "term_buckets": 8})
    rows = lambda p: sorted((tuple(r) for r in match.scored_candidates(posts, arts, words, p).collect()), key=repr)
    try:
        want = rows(plain)
        assert want and rows(stored) == want and rows(stored) == want
        a, b = (spark.table(x) for x in names)
        assert a.count() == fixtures.articles(spark, sf).count()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        pairs = spark.createDataFrame([(f"{i}", i, i + 1) for i in range(50)], "pair string, a_id long, b_id long")
        plan = score.pair_cosine(pairs, a, b)._jdf.queryExecution().executedPlan().toString()
        # every scan of a term table reads its buckets, and only the pairs pass an exchange
        lines = plan.splitlines()
        for at in (i for i, x in enumerate(lines) if "Bucketed: true" in x):
            depth = lines[at].index("FileScan")
            above = []
            for x in reversed(lines[:at]):
                start = len(re.match(r"[\s:+*()\d-]*", x).group(0))
                if start < depth:
                    above.append(x)
                    depth = start
            upto = next(i for i, x in enumerate(above) if "SortMergeJoin" in x)
            assert not any("Exchange" in x for x in above[:upto])
        assert sum("Bucketed: true" in x for x in lines) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for x in names:
            spark.sql(f"DROP TABLE IF EXISTS {x}")


def test_match_job_scores_once_and_its_evidence_is_small(spark, monkeypatch, tmp_path):
    """Result and evidence read one stored best match; a body in the evidence of many posts takes little disk."""
    import random

    from pyspark.sql import functions as F

    from echotrace.plans import jobs
    from echotrace.sources import sinks

    rng = random.Random(6)
    posts, arts = str(tmp_path / "posts"), [(a, f"l{a}", "".join(rng.choice("0123456789abcdef") for _ in range(30_000))) for a in range(80)]
    n = 800
    spark.createDataFrame([(i, f"t{i}") for i in range(n)], "idx long, title string").coalesce(1).write.parquet(posts)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(x):
        seen.add(1)
        return x

    def scored(posts, articles, dictionary, p):
        return posts.select("idx", F.lit(0).alias("cand_pos"), F.floor(F.col("idx") / 10).alias("article_id"),
                            F.concat(F.lit("l"), F.floor(F.col("idx") / 10)).alias("link"), F.lit(0.5).alias("cosine"), told(F.lit(0.5)).alias("copy_ratio"))

    monkeypatch.setattr(match, "scored_candidates", scored)
    adf = spark.createDataFrame(arts + [(999, "unmatched", "x")], "article_id long, link string, body string").coalesce(1)
    out, evidence = str(tmp_path / "out"), str(tmp_path / "evidence")
    got = jobs.match_job(spark, posts, adf, None, out, evidence, match.MatchParams())
    assert seen.value == n
    assert got.where("copy_ratio = 0.5").count() == n
    back = {r["idx"]: r["content"] for r in spark.read.parquet(evidence).collect()}
    assert len(back) == n and all(x.startswith(f"[URL] l{i // 10}\n\n") for i, x in back.items())
    sinks.write_evidence(spark.createDataFrame([(i, "f", arts[i // 10][2]) for i in range(n)], "idx long, file_name string, content string").coalesce(1), evidence)
    assert sum(f.stat().st_size for f in (tmp_path / "evidence").iterdir()) < 2_500_000
