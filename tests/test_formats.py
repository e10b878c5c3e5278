"""Row formats and result files, with golden text."""

import datetime
import glob
import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubespark.functions.scalar import format_number
from cubespark.operators import results as RS
from cubespark.operators.ordering import row_index
from cubespark.session import settings
from cubespark.sources import tables as TB
from cubespark.sources.json_rows import parse_json_rows
from cubespark.sources.nested_csv import CsvOptions, parse_nested_csv, to_nested_csv
from cubespark.sources.text import parse_tokens, read_delimited, to_hive_text

PAIRS = "array<struct<key: int, value: string>>"


def schema(spark, ddl):
    return T.StructType.fromDDL(ddl)


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


@pytest.fixture(scope="module")
def nested(spark):
    return schema(
        spark,
        f"a string, b varchar(20), c int, d char(10), e array<int>, f {PAIRS}, g struct<a: int, b: {PAIRS}>",
    )


# The rows and texts below are what the formats must give.


def test_csv_read(spark, nested):
    flat = schema(spark, "a string, b varchar(20), c int, d char(10)")
    df = parse_nested_csv(
        lines(
            spark,
            'hello,"yes, okay",1,char',
            'hello,"NULL",1,char',
            'hello,"yes, okay",NULL,NULL',
        ),
        flat,
    )
    assert [tuple(r) for r in df.collect()] == [
        ("hello", "yes, okay", 1, "char      "),
        ("hello", None, 1, "char      "),
        ("hello", "yes, okay", None, None),
    ]
    text = '"hello","yes, okay","1","char","1,NULL,3","5=five,NULL=six,7=NULL","8:5=five,NULL=six,7=NULL"'
    row = parse_nested_csv(lines(spark, text), nested).first()
    assert row["e"] == [1, None, 3]
    assert [tuple(p) for p in row["f"]] == [(5, "five"), (None, "six"), (7, None)]
    assert row["g"]["a"] == 8 and [tuple(p) for p in row["g"]["b"]] == [(5, "five"), (None, "six"), (7, None)]


def test_csv_separators_and_escape(spark):
    flat = schema(spark, "a string, b varchar(20), c int, d char(10)")
    tabs = parse_nested_csv(lines(spark, "hello\t'yes\tokay'\t1\tchar"), flat, CsvOptions(sep="\t", quote="'"))
    assert tuple(tabs.first()) == ("hello", "yes\tokay", 1, "char      ")
    escaped = parse_nested_csv(
        lines(spark, "hello,'yes\\'okay',1,char"), flat, CsvOptions(quote="'", escape="\\")
    )
    assert tuple(escaped.first()) == ("hello", "yes'okay", 1, "char      ")


def test_csv_write_and_read_back(spark, nested):
    text = '"hello","yes, ""okay""","1","char      ","1,NULL,3","5=five,NULL=six,7=NULL","8:5=five,NULL=six,7=NULL"'
    df = parse_nested_csv(lines(spark, text), nested)
    assert to_nested_csv(df).first()[0] == text
    nulls = '"NULL","NULL","NULL","NULL","NULL","NULL","NULL"'
    assert to_nested_csv(parse_nested_csv(lines(spark, nulls), nested)).first()[0] == nulls


def test_csv_union(spark):
    union = T.StructType(
        [T.StructField("tag", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())]
    )
    sch = T.StructType([T.StructField("u", union, metadata={"union": True})])
    df = parse_nested_csv(lines(spark, '"0:5"', '"1:x:y"', '"NULL"'), sch)
    assert [r["u"] and tuple(r["u"]) for r in df.collect()] == [(0, 5, None), (1, None, "x:y"), None]
    assert [r[0] for r in to_nested_csv(df).collect()] == ['"0:5"', '"1:x:y"', '"NULL"']


def test_json(spark):
    sch = schema(spark, "a string, b varchar(20), c int, d char(4)")
    df = parse_json_rows(
        lines(
            spark,
            '{\n  "a":"hello",\n  "B":"yes",\n  "c":1,\n  "d":"char"\n}',
            '{"a":"hello","c":1,"d":"char"}',
            '{"a":"hello","b":"yes","c":"no number"}',
            '{"a":"one","A":"two"}',
        ),
        sch,
    )
    assert [tuple(r) for r in df.collect()] == [
        ("hello", "yes", 1, "char"),
        ("hello", None, 1, "char"),
        ("hello", "yes", None, None),
        ("two", None, None, None),
    ]
    deep = schema(spark, "a array<int>, b map<string,string>, c struct<a: int, b: int>")
    row = parse_json_rows(
        lines(spark, '{"a":[1,2,3],"b":{"a":"b","c":"d","e":"f"},"c":{"a":1,"b":2}}'), deep
    ).first()
    assert row["a"] == [1, 2, 3] and row["b"] == {"a": "b", "c": "d", "e": "f"} and tuple(row["c"]) == (1, 2)
    bad = lines(spark, "no json")
    assert tuple(parse_json_rows(bad, sch, mode="PERMISSIVE").first()) == (None,) * 4
    with pytest.raises(Exception, match="(?i)malformed"):
        parse_json_rows(bad, sch).collect()


def test_delimited(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes(b"1\x01one\n\x01two\n3\x01\\N\n\\N\x01\\N\n5\x01\n")
    df = read_delimited(spark, str(tmp_path), schema(spark, "id int, idstr string"), sep="\x01")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(
        [(1, "one"), (None, "two"), (3, None), (None, None), (5, "")], key=str
    )


def test_tokens(spark):
    df = parse_tokens(lines(spark, "  a \t b  c ", "d"), ["x", "y", "z"])
    assert [tuple(r) for r in df.collect()] == [("a", "b", "c"), ("d", None, None)]


# --------------------------------------------------------------------- result files

RESULT = (
    "firstcol int, secondcol string, thirdcol varchar(20), fourthcol char(15), "
    "fifthcol array<tinyint>, sixthcol struct<a: int, b: varchar(10)>, "
    "seventhcol array<struct<key: int, value: char(10)>>"
)
CSV_GOLDEN = [
    '"1","one","one","one","1","1:one","1=one"',
    '"2","two","two","two","1,2","2:two","1=one,2=two"',
    '"NULL","three","three","three","1,2,NULL","NULL:three","1=one,2=two,NULL=three"',
    '"4","NULL","NULL","NULL","1,2,NULL,4","4:NULL","1=one,2=two,NULL=three,4=NULL"',
    '"NULL","NULL","NULL","NULL","1,2,NULL,4,NULL","NULL:NULL","1=one,2=two,NULL=three,4=NULL,5=NULL"',
]
CSV_HEADER = '"firstcol","secondcol","thirdcol","fourthcol","fifthcol","sixthcol","seventhcol"'


@pytest.fixture(scope="module")
def result(spark):
    plain = RESULT.replace("varchar(20)", "string").replace("char(15)", "string")
    plain = plain.replace("varchar(10)", "string").replace("char(10)", "string")
    pairs = [(1, "one"), (2, "two"), (None, "three"), (4, None), (5, None)]
    words = ["one", "two", "three", None, None]
    numbers = [1, 2, None, 4, None]
    rows = [
        (numbers[i], words[i], words[i], words[i], numbers[: i + 1], (numbers[i], words[i]), pairs[: i + 1])
        for i in range(5)
    ]
    return spark.createDataFrame(rows, plain).coalesce(1)


def text_of(spark, path, encoding="UTF-8"):
    return [r["value"] for r in RS.merge_parts(spark, path, encoding).collect()]


def test_result_with_header_and_footer(spark, result, tmp_path):
    path = RS.write_result(result, str(tmp_path / "r"), RS.ResultOptions(header=True, footer=True))
    assert text_of(spark, path) == [CSV_HEADER] + CSV_GOLDEN + ["Total rows:5"]
    given = RS.ResultOptions(header="# given", footer="the end", ext="txt")
    path = RS.write_result(result, str(tmp_path / "g"), given)
    assert text_of(spark, path) == ["# given"] + CSV_GOLDEN + ["the end"]
    RS.write_result(result, path, RS.ResultOptions())
    assert text_of(spark, path) == CSV_GOLDEN, "nothing of the earlier result is left"


def test_result_encoding_and_compression(spark, result, tmp_path):
    options = RS.ResultOptions(header="# names", footer=True, encoding="UTF-16LE")
    path = RS.write_result(result, str(tmp_path / "u"), options)
    raw = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path}/*/part-*.csv")))
    assert raw.decode("utf-16-le").splitlines() == ["# names"] + CSV_GOLDEN + ["Total rows:5"]
    assert text_of(spark, path, "UTF-16LE") == ["# names"] + CSV_GOLDEN + ["Total rows:5"]
    path = RS.write_result(result, str(tmp_path / "z"), RS.ResultOptions(compress=True))
    (file,) = glob.glob(f"{path}/*/part-*.csv.gz")
    assert gzip.open(file, "rt").read().splitlines() == CSV_GOLDEN
    path = RS.write_result(result, str(tmp_path / "d"), RS.ResultOptions(compress=True, codec="deflate"))
    assert glob.glob(f"{path}/*/part-*.csv.deflate") and text_of(spark, path) == CSV_GOLDEN


def test_line_break_in_other_encoding(spark, tmp_path):
    df = spark.createDataFrame(
        [("a\nb", "#x"), (" c\r ", ""), ('say "x"\\', None)], "x string, y string"
    ).coalesce(1)
    want = '"a\nb","#x"\n" c\r ",""\n"say ""x""\\","NULL"\n'
    for encoding in ("UTF-16LE", "UTF-8"):
        path = RS.write_result(df, str(tmp_path / encoding), RS.ResultOptions(encoding=encoding))
        (file,) = glob.glob(f"{path}/*/part-*.csv")
        assert open(file, "rb").read().decode(encoding) == want
    assert "".join(r[0] + "\n" for r in RS.csv_rows(df).collect()) == want
    lines = RS.ResultOptions(formatter=lambda d: d.select(F.col("y").alias("value")))
    with pytest.raises(Exception, match="need UTF-8"):
        RS.write_result(df.filter("y = ''"), str(tmp_path / "no"), lines)


def test_result_split(spark, result, tmp_path):
    options = RS.ResultOptions(header=True, footer=True, split=True, max_rows=2)
    path = RS.write_result(result, str(tmp_path / "s"), options)
    assert text_of(spark, path) == (
        [CSV_HEADER] + CSV_GOLDEN[:2] + [CSV_HEADER] + CSV_GOLDEN[2:4] + [CSV_HEADER] + CSV_GOLDEN[4:]
        + ["Total rows:5"]
    )
    assert len(glob.glob(f"{path}/part=*")) == 3


def test_empty_result(spark, result, tmp_path):
    for split in (False, True):
        options = RS.ResultOptions(header=True, footer=True, split=split)
        path = RS.write_result(result.limit(0), str(tmp_path / f"e{split}"), options)
        assert text_of(spark, path) == [CSV_HEADER, "Total rows:0"]


def test_hive_text(spark, result):
    got = [r[0] for r in to_hive_text(result, schema(spark, RESULT)).collect()]
    pad = lambda w, n: w.ljust(n)
    assert got[0] == "\x01".join(
        ["1", "one", "one", pad("one", 15), "1", "1\x02one", "1\x03" + pad("one", 10)]
    )
    assert got[2] == "\x01".join(
        [
            "\\N", "three", "three", pad("three", 15), "1\x022\x02\\N", "\\N\x02three",
            "\x02".join(["1\x03" + pad("one", 10), "2\x03" + pad("two", 10), "\\N\x03" + pad("three", 10)]),
        ]
    )
    assert got[4].startswith("\\N\x01\\N\x01\\N\x01\\N\x011\x022\x02\\N\x024\x02\\N\x01\\N\x02\\N\x01")


def test_merge_of_part_files(spark, tmp_path):
    for name, text in (("000010_1", "e\n"), ("000000_2", "a\nb\n"), ("000001_0", "c\nd\n"), ("_SUCCESS", "x")):
        (tmp_path / name).write_text(text)
    assert text_of(spark, str(tmp_path)) == ["a", "b", "c", "d", "e"]
    big = RS.format_persisted(spark, str(tmp_path), ["v"], str(tmp_path / "no"), RS.ResultOptions(size_threshold=3))
    assert big == str(tmp_path)
    options = RS.ResultOptions(header="h", footer=True)
    out = RS.format_persisted(spark, str(tmp_path), ["v"], str(tmp_path.parent / "out"), options)
    assert text_of(spark, out) == ["h", "a", "b", "c", "d", "e", "Total rows:5"]


def test_pages(spark, monkeypatch):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    want = [r["id"] for r in df.orderBy("k", "id").collect()][200:230]
    assert [r["id"] for r in RS.page(df, ["k", "id"], 200, 30).collect()] == want
    numbered = row_index(df.orderBy("k", "id"), "row").orderBy("row").collect()
    assert [r["row"] for r in numbered] == list(range(1000))
    assert [r["id"] for r in numbered][200:230] == want


def test_result_metadata(spark):
    df = spark.sql("select 1 as a, cast('x' as string) as b, array(1.5d) as c from range(3)")
    got = [tuple(r) for r in RS.result_schema(df).orderBy("position").collect()]
    assert got == [(3, 0, "a", "int"), (3, 1, "b", "string"), (3, 2, "c", "array<double>")]


def test_names_and_tables(spark, tmp_path):
    assert TB.physical_name("db.t") == "db.t"
    assert TB.physical_name("db.t", {TB.DB_PROPERTY: "default"}) == "t"
    assert TB.physical_name("db.t", {TB.DB_PROPERTY: "x", TB.TABLE_PROPERTY: "y"}) == "x.y"
    assert TB.physical_name("t", {TB.TABLE_PROPERTY: "y"}) == "y"
    TB.create_text_table(spark, "test_text", "id int, name string", str(tmp_path / "t"), null="-NA-")
    df = spark.createDataFrame([(1, "one"), (2, None)], "k long, v string")
    TB.insert_overwrite(df, "test_text")
    TB.insert_overwrite(df, "test_text")
    assert sorted(map(tuple, spark.table("test_text").collect())) == [(1, "one"), (2, None)]
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "t" / "part-*")))
    assert "2,-NA-" in text
    spaced = spark.createDataFrame([(1, " a, b "), (2, ""), (3, None)], "id int, name string")
    TB.insert_overwrite(spaced, "test_text")
    assert sorted(map(tuple, spark.table("test_text").collect())) == [(1, " a, b "), (2, ""), (3, None)]
    TB.write_directory(spaced, str(tmp_path / "d"), sep="|")
    back = read_delimited(spark, str(tmp_path / "d"), spaced.schema, sep="|")
    assert sorted(map(tuple, back.collect())) == [(1, " a, b "), (2, ""), (3, None)]
    with pytest.raises(ValueError):
        TB.insert_overwrite(df.select("k"), "test_text")
    TB.drop_table(spark, "test_text")
    assert not spark.catalog.tableExists("test_text")


def test_functions(spark):
    row = spark.sql("select 1234567.891d as x, date'2013-01-31' as d").select(
        format_number("x", 4), format_number("x", "##################.###"), F.date_sub("d", 3), F.to_date("d")
    ).first()
    day = datetime.date
    assert tuple(row) == ("1,234,567.8910", "1234567.891", day(2013, 1, 28), day(2013, 1, 31))


def test_numbered_lines_do_not_move(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.range(0, 20_000, 1, 7).selectExpr("cast(id as string) as value").write.text(path)
    with settings(spark, spark_sql_files_maxPartitionBytes="5000"):  # files in pieces
        lines = RS.numbered_lines(spark, path)
        got = lines.collect()
        plan = lines._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["row"], r["value"]) for r in got) == [(i, str(i)) for i in range(20_000)]
    assert len({r["chunk"] for r in got}) > 7
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan
    (tmp_path / "none").mkdir()
    assert RS.numbered_lines(spark, str(tmp_path / "none")).count() == 0


def test_persisted_lines_keep_their_order_when_split(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(0, 1000, 1, 5).selectExpr("cast(id as string) as value").write.text(source)
    options = RS.ResultOptions(split=True, max_rows=300, footer=True, ext="txt")
    path = RS.format_persisted(spark, source, ["v"], str(tmp_path / "out"), options)
    got = [(r["part"], r["value"]) for r in RS.merge_parts(spark, path).collect()]
    assert got == [(i // 300, str(i)) for i in range(1000)] + [(3, "Total rows:1000")]
    whole = RS.format_persisted(spark, source, ["v"], str(tmp_path / "whole"), RS.ResultOptions(header=True, footer=True, ext="txt"))
    assert text_of(spark, whole)[1:-1] == [str(i) for i in range(1000)]


@pytest.mark.parametrize("start,size", [(0, 10), (95, 10), (500, 300), (990, 100), (2000, 5), (0, 5000)])
def test_deep_pages(spark, start, size):
    df = spark.range(0, 1000, 1, 6).selectExpr("id", "id % 7 as k", "if(id % 5 = 0, null, id % 3) as _range")
    order = [F.desc_nulls_last("k"), F.asc("_range")]
    rows = RS.page(df, order, start, size, deep=50)
    every = df.orderBy(*order, "id").collect()
    assert rows.columns == df.columns and rows.collect() == every[start : start + size]
