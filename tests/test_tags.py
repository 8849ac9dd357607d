"""Token/tag tables (T1-T8, F10, J7-J9) and dictionary readers."""

import pytest
from pyspark.sql import functions as F

from echotrace.operators import tags as tg
from echotrace.sources import readers as rd
from echotrace.sources.reference_data import TAG_HIERARCHY_LINES

BLOCK = "롯데마트의\n\t롯데마트/ncn+의/jcm\n\t롯데마트의/ncn\n\n흑마늘\n\t흑마늘/ncn\n\t흑마늘/nqq\n"
TAB = "아버지\tNNG,*,F,아버지,*,*,*,*\n가\tJKS,*,F,가,*,*,*,*\nbroken line\n\tSY\nEOS\n"


def test_block_output(spark):
    df = spark.createDataFrame([(1, BLOCK)], "id int, out string")
    got = [tuple(r) for r in tg.parse_block_output(df, "id", "out")
           .orderBy("block_pos", "alt_no", "m_pos").select("block_pos", "surface", "alt_no", "morph", "tag").collect()]
    assert got == [(0, "롯데마트의", 0, "롯데마트", "ncn"), (0, "롯데마트의", 0, "의", "jcm"),
                   (0, "롯데마트의", 1, "롯데마트의", "ncn"), (1, "흑마늘", 0, "흑마늘", "ncn"),
                   (1, "흑마늘", 1, "흑마늘", "nqq")]


def test_tab_output(spark):
    df = spark.createDataFrame([(1, TAB)], "id int, out string")
    got = [(r["morph"], r["tag"]) for r in tg.parse_tab_output(df, "id", "out").orderBy("pos").collect()]
    assert got == [("아버지", "NNG"), ("가", "JKS"), ("", "SY"), ("", "SY")]


def test_joined_split_and_classes(spark):
    df = spark.createDataFrame([("a/b/NNP",), ("x",)], "j string")
    got = [(r["s"]["morph"], r["s"]["tag"]) for r in df.select(tg.split_last_slash("j").alias("s")).collect()]
    assert got == [("a/b", "NNP"), ("x", None)]
    tags = spark.createDataFrame([(t,) for t in ["ncpa", "jcs", "sf", "f", "ii", "xsnu", "unk", "iwg"]], "t string")
    got = [(r[0], r[1]) for r in tags.select(tg.tag_class("t", 22), tg.tag_class("t", 9)).collect()]
    assert got == [("NC", "N"), ("JC", "J"), ("S", "S"), ("F", "F"), ("II", "I"), ("XS", "X"), (None, None),
                   (None, None)]
    with pytest.raises(ValueError):
        tg.tag_class("t", 12)


def test_nouns_and_grouping(spark):
    arr = spark.createDataFrame([([("오픈소스", "NNG"), ("에", "JKB"), ("관심", "NNG"), ("개발자", "NNP")],)],
                                "t array<struct<morph:string,tag:string>>")
    r = arr.select(tg.nouns("t", "NN").alias("n"), tg.morphs("t").alias("m")).first()
    assert r["n"] == ["오픈소스", "관심", "개발자"] and r["m"] == ["오픈소스", "에", "관심", "개발자"]
    coarse = spark.createDataFrame([([("이", "Determiner"), ("것", "Noun")],)], "t array<struct<morph:string,tag:string>>")
    assert coarse.select(tg.nouns("t", exact="Noun")).first()[0] == ["것"]
    rows = spark.createDataFrame([(1, 0, 1, "b", "x"), (1, 0, 0, "a", "y"), (1, 1, 0, "c", "z")],
                                 "d int, w int, pos int, morph string, tag string")
    g = tg.group_tokens(rows, ["d", "w"], "pos", ["morph", "tag"]).orderBy("w")
    assert [[t["morph"] for t in r["tokens"]] for r in g.collect()] == [["a", "b"], ["c"]]
    flat = tg.flatten_groups(g, ["d"], "w").orderBy("w", "pos_in_group")
    assert [r["morph"] for r in flat.collect()] == ["a", "b", "c"]


def test_dictionaries(spark):
    user = rd.lines_frame(spark, "코모란\tNNP\n오픈소스\tNNG\n바람과 함께 사라지다\n")
    got = {r["surface"]: r["tag"] for r in rd.parse_user_dictionary(user).collect()}
    assert got == {"코모란": "NNP", "오픈소스": "NNG", "바람과 함께 사라지다": "NNP"}
    an = rd.lines_frame(spark, "가슴이\t가슴/ncn+이/jcs^가슴/ncn+이/jcc\n\n대해    대하/pvg+어/ecs^대해/ncn\n")
    got = sorted(tuple(r) for r in rd.parse_analyzed_dictionary(an).collect())
    assert ("가슴이", 1, 1, "이", "jcc") in got and ("대해", 1, 0, "대해", "ncn") in got and len(got) == 7
    toks = spark.createDataFrame([(0, "가슴이"), (1, "없음")], "pos int, token string")
    assert tg.candidate_analyses(toks, rd.parse_analyzed_dictionary(an)).count() == 4
    tagged = {r["token"]: r["tag"] for r in tg.tag_with_dictionary(
        toks, spark.createDataFrame([("가슴이", "ncn")], "surface string, tag string").withColumn(
            "tag", F.lit("pvg"))).collect()}
    assert tagged == {"가슴이": "pvg", "없음": "ncn"}


def test_hierarchy_closure(spark):
    edges = rd.parse_tag_hierarchy(rd.lines_frame(spark, TAG_HIERARCHY_LINES))
    cl = tg.closure(edges)
    members = {r["member"] for r in cl.where("group = 'n' AND is_leaf").collect()}
    assert {"ncpa", "ncn", "nqpa", "nqq", "nbu", "npp", "nnc"} <= members and "nq" not in members
    all_leaf = {r["member"] for r in cl.where("group = 'all' AND is_leaf").collect()}
    assert {"sf", "ncn", "jcs", "unk", "xsnca"} <= all_leaf


def test_closure_of_a_long_chain(spark):
    import time

    edges = spark.createDataFrame([(f"g{i}", f"g{i + 1}") for i in range(40)], "parent string, child string")
    t0 = time.time()
    assert tg.closure(edges).count() == 40 * 41 // 2
    assert time.time() - t0 < 30


def test_block_without_analyses_stays(spark):
    df = spark.createDataFrame([(1, "a\n\ta/N\n\nb\n\nc\n\tc/V+d/E")], "id int, t string")
    got = sorted((r["block_pos"], r["surface"], r["morph"] or "") for r in tg.parse_block_output(df, "id", "t").collect())
    assert got == [(0, "a", "a"), (1, "b", ""), (2, "c", "c"), (2, "c", "d")]


def test_first_dictionary_line_wins(spark):
    d = spark.createDataFrame([(2, "x", "b"), (1, "x", "c"), (3, "y", "n")], "nr int, surface string, tag string")
    assert {r["surface"]: r["tag"] for r in tg.first_entries(d, "nr").collect()} == {"x": "c", "y": "n"}
    t = spark.createDataFrame([("x",), ("x",)], "token string")
    assert [r["tag"] for r in tg.tag_with_dictionary(t, d, order="nr").collect()] == ["c", "c"]


def test_tagsets(spark, tmp_path):
    (tmp_path / "mini.json").write_text('{"NC": "보통명사", "JC": "격조사"}', encoding="utf-8")
    got = {(r["tagset"], r["tag"]): r["description"] for r in rd.read_tagsets(spark, str(tmp_path)).collect()}
    assert got == {("mini", "NC"): "보통명사", ("mini", "JC"): "격조사"}
    ts = spark.createDataFrame([("NC", "보통명사")], "tag string, description string")
    df = spark.createDataFrame([("NC",), ("ZZ",)], "tag string")
    assert {r["tag"]: r["description"] for r in tg.describe_tags(df, ts).collect()} == {"NC": "보통명사", "ZZ": None}


def test_block_texts_are_parsed_once(spark):
    """a text is rewritten and cut once, no line arrays are filtered by size(); odd breaks, white space, slashes and empty texts."""
    texts = ["s\r\n\t a/N+c/V \x85\r\n\n\n\nt\x0b\tx", "\n \n", "", None, "u  /N \ta//N"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "w\n\tw/N")] * 2, "id int, t string")
    out = tg.parse_block_output(df, "id", "t")
    got = sorted(map(str, (tuple(r) for r in out.collect())))
    assert got == sorted(map(str, [
        (0, 0, "s", 0, 0, "a", "N"), (0, 0, "s", 0, 1, "c", "V"), (0, 2, "t", 0, None, None, None),
        (4, 0, "u", 0, None, None, None), (4, 0, "u", 1, 0, "a/", "N"), (None, 0, "w", 0, 0, "w", "N"), (None, 0, "w", 0, 0, "w", "N")]))
    assert "size(" not in out._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


DOCS = [(1, "aa bbbb aa\n\n. \ncc aa", "en", "s", 1), (1, "aa bbbb", "en", "s", 1), (None, "aa", "en", "s", 1), (None, "aa", "en", "s", 1),
        (2, None, "en", "s", 1), (3, "", "en", "s", 1), (4, "bbbb", "fr", "s", 1), (4, "bbbb", "fr", "s", 1)]


def test_token_analyses_are_counted_per_token(spark, tmp_path):
    """occurrences are combined before any shuffle; ids that come twice or are null count as they always did."""
    from echotrace.plans import catalog, fixtures

    sf = _documents(spark, tmp_path, DOCS)
    out = catalog.q_token_analyses(spark, sf)
    an = rd.parse_analyzed_dictionary(catalog._analyzed_lines(fixtures.dictionary(spark, sf)))
    whole = tg.candidate_analyses(fixtures.tokens(spark, sf), an).groupBy("token").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doc_id", "pos", "alt_no").alias("n_alternatives"),
        F.count_if(F.col("a_tag") == "jcs").alias("n_jcs"))
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(tuple(r) for r in whole.collect()) and ("aa", 6, 3, 6) in got
    below = _plan(out).split("Join Inner, (token", 1)[1]
    assert "Aggregate [token" in below.split("Generate", 1)[0]  # no join above the token rows


def test_flat_groups_move_texts_not_tokens(spark, tmp_path):
    """F16: one exchange, by document and below the token rows; ids that come twice or are null."""
    from echotrace.plans import catalog

    out = catalog.q_flat_groups(spark, _documents(spark, tmp_path, DOCS))
    got = sorted(str(tuple(r)) for r in out.collect())
    line = [(0, 0, "aa"), (0, 1, "bbbb"), (0, 2, "aa"), (2, 0, "cc"), (2, 1, "aa")]  # of the first text: line, place, word
    first = [(1, 0, i, w) for i, w in enumerate(["aa", "aa", "bbbb", "bbbb", "aa"])] + [(1, *x) for x in line[3:]]
    want = first + [(None, 0, i, "aa") for i in range(2)] + [(4, 0, i, "bbbb") for i in range(2)]
    assert got == sorted(str(x) for x in want)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange hashpartitioning(doc_id" in out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan.split("Generate", 1)[0] and "line_pos" not in "".join(
        x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
