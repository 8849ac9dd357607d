"""Readers and sinks."""

from pyspark.sql import functions as F

from echotrace.sources import readers as rd
from echotrace.sources import sinks


def test_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("지방공무원법\n\n본문", encoding="utf-8")
    (tmp_path / "b.txt").write_text("둘째", encoding="utf-8")
    (tmp_path / "skip.md").write_text("x", encoding="utf-8")
    got = {r["file_name"]: r["content"] for r in rd.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "지방공무원법\n\n본문", "b.txt": "둘째"}
    sizes = {r["file_name"]: r["file_size"] for r in rd.corpus_listing(spark, str(tmp_path)).collect()}
    assert sizes["b.txt"] == len("둘째".encode())


def test_lists_oids_stopwords(spark, tmp_path):
    (tmp_path / "oid.csv").write_text("oid\n1\n1234\n\n7.0\n1\n", encoding="utf-8")
    assert sorted(r["oid"] for r in rd.load_oids(spark, str(tmp_path / "oid.csv")).collect()) == ["001", "007", "1234"]
    assert rd.load_oids(spark, str(tmp_path / "missing.csv")).count() == 0
    (tmp_path / "stop.txt").write_text("  a b \n\nc\nc\n", encoding="utf-8")
    assert sorted(r["word"] for r in rd.load_stopwords(spark, str(tmp_path / "stop.txt")).collect()) == ["a b", "c"]
    assert rd.load_stopwords(spark, str(tmp_path / "nope.txt")).count() == 0
    (tmp_path / "lst.csv").write_text(" 도메인 ,x\nabc,1\n,2\n", encoding="utf-8")
    assert [r["value"] for r in rd.load_list(spark, str(tmp_path / "lst.csv"), "도메인").collect()] == ["abc"]


def test_posts_headers_and_index(spark, tmp_path):
    p = tmp_path / "posts.csv"
    p.write_text(" 게시글제목 ,게시글내용,검색어,게시글 등록일자\nt1,c1,k,2024-01-01\nt2,c2,k,0012\n", encoding="utf-8")
    df = rd.read_posts(spark, str(p), fmt="csv")
    assert set(df.columns) == {"title", "content", "keyword", "reg_date", "idx"}
    got = sorted((r["idx"], r["title"], r["reg_date"]) for r in df.collect())
    assert got == [(0, "t1", "2024-01-01"), (1, "t2", "0012")]


def test_row_index_follows_the_files(spark, tmp_path):
    # files of unequal size, the largest last: Spark packs splits by size
    n = 0
    for f, rows in enumerate([3, 40, 1, 5000]):
        (tmp_path / f"p{f}.csv").write_text("title\n" + "".join(f"t{n + i} {'x' * (i % 50)}\n" for i in range(rows)), encoding="utf-8")
        n += rows
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = rd.read_posts(spark, str(tmp_path), fmt="csv")
        got = {r["idx"]: r["title"].split()[0] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {i: f"t{i}" for i in range(n)}


def test_struct_title(spark):
    df = spark.createDataFrame([(("제목", "http://x"), "본문")], "`게시글제목` struct<value:string,link:string>, c string")
    r = rd.normalize_headers(df).first()
    assert (r["title"], r["url"]) == ("제목", "http://x")


def test_sinks(spark, tmp_path):
    empty = spark.createDataFrame([], "idx long, article_link string, copy_ratio double")
    sinks.write_result(empty, str(tmp_path / "out_csv"), fmt="csv")
    text = "".join(f.read_text() for f in (tmp_path / "out_csv").glob("*.csv"))
    assert text.startswith("idx,article_link,copy_ratio")
    sinks.write_result(empty, str(tmp_path / "out_pq"))
    assert spark.read.parquet(str(tmp_path / "out_pq")).columns == ["idx", "article_link", "copy_ratio"]
    m = spark.createDataFrame([(0, 'a:b/c', "http://l", "body")], "idx long, title string, link string, body string")
    ev = sinks.evidence(m).first()
    assert ev["file_name"] == "001_abc.txt" and ev["content"] == "[URL] http://l\n\nbody"
    lines = spark.createDataFrame([("x",), ("y",)], "value string")
    sinks.append_lines(lines, str(tmp_path / "log"))
    sinks.append_lines(lines, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 4


def test_token_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("이 / NR", "차 / NNB"), ("나가 / VV", None)], "a string, b string")
    sinks.write_token_csv(df, str(tmp_path / "tok"))
    back = sorted(tuple(r) for r in rd.read_token_csv(spark, str(tmp_path / "tok")).collect())
    assert back == [("나가 / VV", None), ("이 / NR", "차 / NNB")]


def test_corpus_in_chunks_and_lines(spark, tmp_path):
    from echotrace.sources.corpus_source import read_corpus_chunks

    texts = {"a.txt": "지방공무원법😀é" * 700 + "\n\nx", "b.txt": "", "c.txt": "plain\r\nlines\n"}
    for name, t in texts.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "skip.md").write_text("x")
    for size in (7, 4096, 1 << 20):
        got = {}
        for r in sorted(read_corpus_chunks(spark, str(tmp_path), chunk_bytes=size).collect(), key=lambda r: (r["file_name"], r["start"])):
            got[r["file_name"]] = got.get(r["file_name"], "") + r["content"]
            assert len(r["content"].encode()) <= size + 3
        assert got == texts
    lines = {}
    for r in sorted(rd.read_corpus_lines(spark, str(tmp_path)).collect(), key=lambda r: (r["file_name"], r["block_start"], r["row"])):
        lines.setdefault(r["file_name"], []).append(r["line"])
    assert lines["a.txt"] == texts["a.txt"].split("\n") and lines["c.txt"] == ["plain\r", "lines"]


def test_text_files_of_counted_attempts_only(spark, tmp_path):
    from echotrace.sources.corpus_source import TextFileWriter, write_text_files

    df = spark.createDataFrame([(f"{i:03d}_t.txt", f"본문 {i}\n" if i else None) for i in range(40)], "file_name string, content string")
    write_text_files(df.repartition(4), str(tmp_path / "out"))
    found = {p.name: p.read_text(encoding="utf-8") for p in (tmp_path / "out").rglob("*.txt")}
    assert found == {f"{i:03d}_t.txt": f"본문 {i}\n" if i else "" for i in range(40)}
    writer = TextFileWriter(str(tmp_path / "retry"))
    lost = writer.write(iter([{"file_name": "x.txt", "content": "lost attempt"}]))
    kept = writer.write(iter([{"file_name": "x.txt", "content": "kept"}]))
    writer.commit([kept, None])
    assert [p.read_text() for p in (tmp_path / "retry").rglob("*.txt")] == ["kept"] and lost.folder != kept.folder
    writer.write(iter([{"file_name": "y.txt", "content": "aborted"}]))
    writer.abort([])
    assert not list((tmp_path / "retry").rglob("y.txt"))


def test_ragged_csv_round_trip(spark, tmp_path):
    rows = [[], ["a"], ["a", None, "", "b,c"], ['say "hi"', "line one\nline two\n", '"'], ["1", "-2.5", "x1"], [None, None], ["\n\n", '"\n"'], [None], ["한글", ""],
            ["\x01,\x03", "\x01\x02"], ['"' * 20_000, "x\n" * 9000]]
    for split, some in (("128m", rows), ("16", rows[:-1])):
        path = str(tmp_path / split)
        sinks.write_ragged_csv(spark.createDataFrame([(r,) for r in some], "fields array<string>").coalesce(1), path)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = [r["fields"] for r in rd.read_ragged_csv(spark, path).orderBy("row").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == [[""] if r == [None] else r for r in some]


def test_tag_sets_of_any_shape(spark):
    files = [("a.json", '{"N": "noun", "V": {"x": [1, "y"]}, "Z": null, "n": 5}'), ("b.json", '{"N": '), ("c.json", "[1]"), ("d.json", None), ("e.json", "{}")]
    got = rd.parse_tagsets(spark.createDataFrame(files, "file_name string, content string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([("a", "N", "noun"), ("a", "V", '{"x":[1,"y"]}'), ("a", "Z", None), ("a", "n", "5")], key=repr)
