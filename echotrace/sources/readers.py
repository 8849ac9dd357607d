"""Readers (S1-S12) and row index (P25).

Everything returns a DataFrame with an explicit schema; nothing is collected.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echotrace.functions import regex as R
from echotrace.functions.text import py_strip
from echotrace.session import cut_lineage
from echotrace.sources.reference_data import USER_DICT_DEFAULT_TAG

# Source sheet headers and the column names used here.
POST_HEADERS = {
    "게시글제목": "title",
    "게시글URL": "url",
    "게시글내용": "content",
    "검색어": "keyword",
    "계정명": "account",
    "게시글 등록일자": "reg_date",
    "원본기사": "article_link",
    "복사율": "copy_ratio",
}

POST_SCHEMA = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("account", T.StringType()),
    T.StructField("reg_date", T.StringType()),
])


# ---------------------------------------------------------------- P25
def with_row_index(df: DataFrame, name: str = "idx") -> DataFrame:
    """0-based consecutive row index in file order, for a frame read from files.

    A row's place is (file path, start of its split, position in the split);
    rows never move.  The rows are checkpointed first, so the counts and the
    result see the same rows; offsets have one row per split."""
    tagged = cut_lineage(df.select("*", F.col("_metadata.file_path").alias("_file"),
                                   F.col("_metadata.file_block_start").alias("_start"),
                                   F.monotonically_increasing_id().alias("_mid")))
    splits = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    offsets = splits.select(F.col("_file").alias("_of"), F.col("_start").alias("_os"), "_first",
                            (F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n")).alias("_off"))
    out = tagged.join(offsets, (F.col("_file") == F.col("_of")) & (F.col("_start") == F.col("_os")))
    return out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first")).select(*df.columns, name)


# ---------------------------------------------------------------- S1 / S2
def normalize_headers(df: DataFrame, header_map: dict[str, str] | None = None) -> DataFrame:
    """Trim header names, rename source headers, flatten a title cell stored
    as ``struct<value, link>`` into ``title`` and ``url``."""
    hm = POST_HEADERS if header_map is None else header_map
    df = df.toDF(*[c.strip() for c in df.columns])
    df = df.toDF(*[hm.get(c, c) for c in df.columns])
    if "title" in df.columns and isinstance(df.schema["title"].dataType, T.StructType):
        df = df.withColumn("url", F.col("title.link")).withColumn("title", F.col("title.value"))
    return df


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
               header_map: dict[str, str] | None = None, **options) -> DataFrame:
    """A post table with trimmed, mapped headers; a date column stays a
    string (explicit schema or CSV text); ``idx`` added when missing."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if "idx" not in normalize_headers(df, header_map).columns:
        df = with_row_index(df)
    df = normalize_headers(df, header_map)
    if "reg_date" in df.columns:
        df = df.withColumn("reg_date", F.col("reg_date").cast("string"))
    return df


# ---------------------------------------------------------------- S3
def load_list(spark: SparkSession, path: str, column: str, fmt: str = "csv", **options) -> DataFrame:
    """One column of a reference sheet: nulls dropped, as string."""
    r = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        r = r.option("header", True)
    df = r.load(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(F.col(f"`{column}`").cast("string").alias("value")).where(F.col("value").isNotNull())


def list_frame(spark: SparkSession, values, name: str = "value") -> DataFrame:
    """A literal reference list as a one-column DataFrame."""
    schema = T.StructType([T.StructField(name, T.StringType())])
    return spark.createDataFrame([(v,) for v in values], schema)


def _is_missing(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


# ---------------------------------------------------------------- S4
def zero_fill(col, width: int = 3):
    """``str.zfill(3)``: left-pad with zeros, never truncate."""
    c = col if not isinstance(col, str) else F.col(col)
    neg = c.startswith("-")
    digits = F.when(neg, F.substring(c, 2, 1 << 30)).otherwise(c)
    padded = F.when(F.length(c) < width,
                    F.concat(F.when(neg, F.lit("-")).otherwise(F.lit("")),
                             F.lpad(digits, width - neg.cast("int"), "0"))).otherwise(c)
    return padded


def load_oids(spark: SparkSession, path: str, column: str = "oid", fmt: str = "csv", **options) -> DataFrame:
    """Publisher ids: drop nulls, integer, string, zero-filled to 3, distinct.
    A cell that is no number is left out and the other ids stay (in the reference one such
    cell empties the list).  A missing file gives an empty table; any other error is raised."""
    try:
        vals = load_list(spark, path, column, fmt, **options)
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        return spark.createDataFrame([], "oid string")
    as_int = F.expr("try_cast(try_cast(value AS DOUBLE) AS BIGINT)")
    return (vals.select(as_int.alias("_i")).where(F.col("_i").isNotNull())
                .select(zero_fill(F.col("_i").cast("string")).alias("oid")).distinct())


def channel_oids(frames: dict[str, DataFrame]) -> DataFrame:
    """(channel, oid) table from one id table per channel (J3 input)."""
    out = None
    for ch, df in frames.items():
        part = df.select(F.lit(ch).alias("channel"), "oid")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- S5
def load_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """Stripped, non-empty, distinct lines; a missing file gives no words, any other error is raised."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if not _is_missing(e):
            raise
        return spark.createDataFrame([], "word string")
    return lines.select(py_strip("value").alias("word")).where(F.col("word") != "").distinct()


# ---------------------------------------------------------------- S6 / S7
def read_corpus(spark: SparkSession, directory: str, extension: str = "txt") -> DataFrame:
    """``(file_name, content)``: one row per file of the extension."""
    df = spark.read.text(directory, wholetext=True, pathGlobFilter=f"*.{extension}")
    return df.select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


def read_corpus_lines(spark: SparkSession, directory: str, extension: str = "txt") -> DataFrame:
    """``(file_name, block_start, row, line)``: corpus files of any size, read in splits from any store.

    Lines of a file in the order of (block_start, row) are the file."""
    df = spark.read.text(directory, lineSep="\n", pathGlobFilter=f"*.{extension}")
    return df.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block_start"),
                     F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))


def corpus_listing(spark: SparkSession, directory: str, extension: str = "txt") -> DataFrame:
    """``(file_name, file_size)`` of the corpus files (metadata only)."""
    df = spark.read.text(directory, wholetext=True, pathGlobFilter=f"*.{extension}")
    return df.select(F.col("_metadata.file_name").alias("file_name"),
                     F.col("_metadata.file_size").alias("file_size")).distinct()


# ---------------------------------------------------------------- S8
def parse_user_dictionary(lines: DataFrame, col: str = "value") -> DataFrame:
    """``surface<TAB>tag`` lines; a missing tag becomes ``NNP``."""
    parts = F.split(F.col(col), "\t", 2)
    return (lines.where(F.col(col) != "")
                 .select(F.try_element_at(parts, F.lit(1)).alias("surface"),
                         F.coalesce(F.nullif(py_strip(F.try_element_at(parts, F.lit(2))), F.lit("")),
                                    F.lit(USER_DICT_DEFAULT_TAG)).alias("tag")))


def read_user_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_user_dictionary(spark.read.text(path))


# ---------------------------------------------------------------- S9
def parse_analyzed_dictionary(lines: DataFrame, col: str = "value") -> DataFrame:
    """``surface  m/t+m/t^m/t…`` (tab or spaces): ``^`` separates alternatives,
    ``+`` morphemes, the tag follows the last ``/``.  Blank lines skipped.
    Returns ``(surface, alt_no, m_pos, morph, tag)``."""
    parts = F.split(py_strip(F.col(col)), R.WS + "+", 2)
    base = (lines.where(py_strip(F.col(col)) != "")
                 .select(F.try_element_at(parts, F.lit(1)).alias("surface"), F.try_element_at(parts, F.lit(2)).alias("analyses")))
    alts = base.select("surface", F.posexplode(F.split("analyses", r"\^", -1)).alias("alt_no", "alt"))
    ms = alts.select("surface", "alt_no", F.posexplode(F.split("alt", r"\+", -1)).alias("m_pos", "mt"))
    return ms.select("surface", "alt_no", "m_pos",
                     F.regexp_extract("mt", r"^(.*)/([^/]*)$", 1).alias("morph"),
                     F.regexp_extract("mt", r"^(.*)/([^/]*)$", 2).alias("tag"))


def read_analyzed_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_analyzed_dictionary(spark.read.text(path))


# ---------------------------------------------------------------- S10
def parse_tagsets(files: DataFrame, name_col: str = "file_name", text_col: str = "content") -> DataFrame:
    """JSON objects tag -> description, one per file -> ``(tagset, tag, description)``.

    Files are parsed as VARIANT: a nested description comes out as its JSON text, a null
    one as null; a file that is broken or no object gives no rows."""
    parsed = files.select(F.regexp_replace(F.col(name_col), r"\.json$", "").alias("tagset"), F.try_parse_json(F.col(text_col)).alias("v"))
    objects = parsed.where(F.schema_of_variant("v").startswith("OBJECT"))
    rows = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("v").outer()))
    text = F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")) \
            .when(F.schema_of_variant("value") != "VOID", F.to_json("value"))
    return rows.select("tagset", F.col("key").alias("tag"), text.alias("description"))


def read_tagsets(spark: SparkSession, directory: str) -> DataFrame:
    return parse_tagsets(read_corpus(spark, directory, "json"))


def tagset_frame(spark: SparkSession, mapping: dict[str, str], name: str) -> DataFrame:
    schema = T.StructType([T.StructField("tagset", T.StringType()), T.StructField("tag", T.StringType()),
                           T.StructField("description", T.StringType())])
    return spark.createDataFrame([(name, k, v) for k, v in mapping.items()], schema)


# ---------------------------------------------------------------- S11
def parse_tag_hierarchy(lines: DataFrame, col: str = "value") -> DataFrame:
    """``TSET parent children…`` lines -> ``(parent, child)`` edges."""
    parts = F.split(py_strip(F.col(col)), R.WS + "+", -1)
    t = lines.where(F.col(col).rlike("^TSET" + R.WS)).select(parts.alias("p"))
    return t.select(F.try_element_at("p", F.lit(2)).alias("parent"),
                    F.explode(F.slice("p", 3, F.size("p"))).alias("child"))


def read_tag_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    return parse_tag_hierarchy(spark.read.text(path))


def lines_frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


# ---------------------------------------------------------------- S12
def read_token_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of strings (UTF-8, no header); empty fields are null."""
    return spark.read.csv(path, encoding="UTF-8", header=False)


def csv_fields(record: Column) -> Column:
    """The raw fields of a CSV record: separators outside quotes part it.

    Every other piece between quotes lies outside them; there separators become U+0001
    U+0003 (and U+0001 everywhere U+0001 U+0002, so that no text is mistaken for one)."""
    marked = F.transform(F.split(F.replace(record, F.lit("\x01"), F.lit("\x01\x02")), '"', -1), lambda x, i: F.when(
        i % 2 == 0, F.replace(x, F.lit(","), F.lit("\x01\x03"))).otherwise(x))
    return F.transform(F.split(F.array_join(marked, '"'), "\x01\x03", -1), lambda x: F.replace(x, F.lit("\x01\x02"), F.lit("\x01")))


def read_ragged_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV records of any number of fields, as ``(row, fields array<string>)`` in file order by ``row``.

    Quoted fields may hold separators, doubled quotes and newlines.  Files are read in
    splits: a line begins a record if the quotes before it in its file are even in
    number, counted inside each split and carried over the splits before.  A plain empty
    field is null, a quoted one is empty, an empty line is a record without fields."""
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("row"), "value").withColumn(
        "q", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    lines = cut_lineage(lines)
    split, in_file = Window.partitionBy("f", "b").orderBy("row"), Window.partitionBy("f").orderBy("b")
    before = Window.unboundedPreceding
    carried = lines.groupBy("f", "b").agg(F.sum("q").alias("n")).select(
        F.col("f").alias("cf"), F.col("b").alias("cb"), F.coalesce(F.sum("n").over(in_file.rowsBetween(before, -1)), F.lit(0)).alias("n0"))
    starts = (lines.join(carried, (F.col("f") == F.col("cf")) & (F.col("b") == F.col("cb")))
                   .withColumn("open", (F.col("n0") + F.coalesce(F.sum("q").over(split.rowsBetween(before, -1)), F.lit(0))) % 2 == 1)
                   .withColumn("own", F.last(F.when(~F.col("open"), F.col("row")), ignorenulls=True).over(split)))
    # lines ahead of the first record of a split belong to the last one of the splits before
    ends = starts.groupBy("f", "b").agg(F.max("own").alias("last")).select(
        F.col("f").alias("ef"), F.col("b").alias("eb"),
        F.last("last", ignorenulls=True).over(Window.partitionBy("f").orderBy("b").rowsBetween(before, -1)).alias("former"))
    records = (starts.join(ends, (F.col("f") == F.col("ef")) & (F.col("b") == F.col("eb")))
                     .groupBy(F.coalesce("own", "former").alias("record"))
                     .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]), "\n").alias("text")))
    records = records.select("record", "text", csv_fields(F.col("text")).alias("raw"))
    fields = F.transform("raw", lambda x: F.when(x.startswith('"'), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"')))
                         .when(x != "", x))
    return records.select(F.col("record").alias("row"),
                          F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(fields).alias("fields"))
