"""List-driven filters and the cleaning job."""

from pyspark.sql import functions as F

from echotrace.operators import filters as flt
from echotrace.plans import clean

SCHEMA = "idx long, title string, content string, keyword string, account string, url string"
POSTS = [
    (0, "좋은 소식&keyword=x", "오늘 발표했다. 좋은 소식", "소식", "acc", "http://blog/a"),
    (1, "스팸", "스팸 본문 소식", "소식", "acc", "http://spam-farm/x"),
    (2, "제목", "본문에 없음", "키워드", "acc", None),
    (3, "신춘문예 당선", "소식 입니다.", "소식", "acc", "http://b"),
    (4, "만평", "소식 만평 그림", "소식", "acc", "http://c"),
    (5, "공지", "소식 Copyright NEWS1 합니다.", "소식", "acc", "http://d"),
    (6, "소식", "그림만 있는 소식", "소식", "acc", "http://e"),
]
PARAMS = clean.CleanParams(excluded_urls=["spam-farm"], banned=[("content", "신춘문예"), ("title", "신춘문예"),
                                                                ("account", "뽐뿌뉴스")],
                           untrusted_phrases=["Copyright NEWS1"], untrusted_domains=[], trusted_domains=[])


def test_stages(spark):
    df = spark.createDataFrame(POSTS, SCHEMA)
    stage = {r["idx"]: r["stage"] for r in clean.flag_posts(df, PARAMS).collect()}
    # 0 kept: ending '다.' without '니다.'; 4 kept by the cartoon term; 6 removed by the ending filter
    assert stage == {0: 0, 1: 1, 2: 2, 3: 2, 4: 0, 5: 3, 6: 4}
    kept = [r["idx"] for r in clean.clean_posts(df, PARAMS).orderBy("idx").collect()]
    assert kept == [0, 4]
    assert clean.clean_posts(df, PARAMS).where("idx = 0").first()["title"] == "좋은 소식"


def test_counts_and_halves(spark):
    df = spark.createDataFrame(POSTS, SCHEMA)
    c = clean.stage_counts(df, PARAMS).first().asDict()
    assert c == {"total": 7, "after_url": 6, "removed_search": 2, "after_search": 4, "removed_untrusted": 1,
                 "kept_untrusted": 3, "removed_ending": 1, "kept": 2}
    flagged = df.withColumn("f", flt.untrusted_flag(["Copyright"], [], []))
    kept, removed = flt.split(flagged, "f")
    assert kept.count() + removed.count() == df.count()
    assert kept.join(removed, "idx").count() == 0


def test_null_handling(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)
    assert flt.exclude_urls(df, ["x"]).count() == 1            # missing URL is kept
    assert flt.keep_keyword_posts(df).count() == 0             # missing keyword matches nothing
    assert flt.drop_banned(df, [("content", "a")]).count() == 1
    assert df.select(flt.ending_flag("다.", "니다.", "만평").alias("m")).first()["m"] is True


def test_empty_input_and_counts(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert clean.clean_posts(df, PARAMS).count() == 0
    assert clean.clean_posts(df, PARAMS).columns == ["idx", "title", "content", "keyword", "account", "url"]
    c = flt.non_null_counts(spark.createDataFrame(POSTS, SCHEMA)).first()
    assert c["url"] == 6 and c["idx"] == 7


def test_long_lists_are_joined(spark):
    import random

    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc가") for _ in range(n))
    texts = [(i, None if i == 7 else word(rng.randint(0, 40))) for i in range(60)]
    values = [word(rng.randint(1, 9)) for _ in range(40)] + [None, "zz", ""]
    df = spark.createDataFrame(texts, "idx long, t string")
    want = {i: any(v in (t or "") for v in values if v) if t is not None else False for i, t in texts}
    by_join = flt.contains_flag(df, "idx", F.col("t"), spark.createDataFrame([(v,) for v in values], "v string"), "f")
    assert {r["idx"]: r["f"] for r in by_join.collect()} == want
    assert {r["idx"]: r["f"] for r in df.select("idx", flt.contains_any("t", values).alias("f")).collect()} == want
    long_list = [f"entry-{i}" for i in range(20_000)]
    few = spark.createDataFrame([(1, "x entry-19999 y"), (2, "entry"), (3, "an entry-5")], "idx long, t string")
    got = flt.contains_flag(few, "idx", F.col("t"), spark.createDataFrame([(v,) for v in long_list], "v string"), "f")
    assert {r["idx"]: r["f"] for r in got.collect()} == {1: True, 2: False, 3: True}


def test_missing_cells_print_none(spark):
    df = spark.createDataFrame([(1, None, None, "na", "a", None), (2, None, None, "non", "a", None)], SCHEMA)
    assert [r["idx"] for r in flt.keep_keyword_posts(df).collect()] == [2]


def test_null_and_repeated_keys_and_chunks(spark, monkeypatch):
    """Table and list form of the cleaning job give the same rows; grams in several chunks too."""
    rows = POSTS + [(None, "t", "소식 발표했다.", "소식", "acc", "http://spam-farm/y"), (None, "t", "소식 발표했다.", "소식", "acc", "http://ok"),
                    (9, "t", "소식 Copyright NEWS1 발표했다.", "소식", "acc", "http://f"), (9, "t", "소식 발표했다.", "소식", "acc", "http://g"),
                    (10, "t", "소식 Copyright NEWS1 trusted.kr 발표했다.", "소식", "acc", None), (11, "t", None, "None", "acc", "http://spam")]
    df = spark.createDataFrame(rows, SCHEMA)
    lists = dict(excluded_urls=["spam-farm", "x"], untrusted_phrases=["Copyright NEWS1", "가나다라마바사"], untrusted_domains=["f", "zz"],
                 trusted_domains=["trusted.kr"])
    params = clean.CleanParams(**{**PARAMS.__dict__, **lists})
    want = sorted((tuple(r) for r in clean.flag_posts(df, params).collect()), key=repr)
    frames = {k: spark.createDataFrame([(x,) for x in [*v, None, ""]], "v string") for k, v in lists.items()}
    as_tables = clean.CleanParams(**{**PARAMS.__dict__, **frames})
    assert sorted((tuple(r) for r in clean.flag_posts(df, as_tables).collect()), key=repr) == want
    monkeypatch.setattr(flt, "GRAM_CHUNK", 3)
    assert sorted((tuple(r) for r in clean.flag_posts(df, as_tables).collect()), key=repr) == want
    none = {k: spark.createDataFrame([], "v string") for k in lists}
    assert clean.flag_posts(df, clean.CleanParams(**{**PARAMS.__dict__, **none})).where("stage in (1, 3)").count() == 0


def test_job_counters_are_those_of_the_run(spark, tmp_path):
    from echotrace.plans import jobs

    df = spark.createDataFrame(POSTS, SCHEMA)
    df.write.parquet(f"{tmp_path}/posts")
    spark.createDataFrame([("spam-farm",)], "value string").write.option("header", True).csv(f"{tmp_path}/urls")
    kept, seen = jobs.clean_job_counted(spark, f"{tmp_path}/posts", f"{tmp_path}/out", {"excluded_urls": (f"{tmp_path}/urls", "value")}, PARAMS)
    assert seen == clean.stage_counts(df, PARAMS).first().asDict() and kept.count() == seen["kept"]
