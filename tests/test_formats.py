"""Round trips and traps of the four file formats."""

import csv
import io
import itertools
import json
import random
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.sources import csv_files, csv_splits, json_files, json_tabular, sheet_xml, workbooks

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("big", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("d", T.DecimalType(18, 2)),
        T.StructField("t", T.TimestampNTZType()),
        T.StructField("day", T.DateType()),
        T.StructField("b", T.BinaryType()),
    ]
)


@pytest.fixture
def mixed(spark):
    return spark.sql(
        """SELECT * FROM VALUES
        (1, 9007199254740993, 'a,"b"', true, 1.5D, 1.20BD, timestamp_ntz '2024-01-01 00:00:01', date '2024-01-02', X'00ff'),
        (2, -1, ' line\nbreak\t', false, 1e6D, -3.00BD, timestamp_ntz '1999-12-31 23:59:59', date '1970-01-01', X''),
        (3, 0, 'é😀 _x0041_ <&>', true, -0.00001D, 0.00BD, timestamp_ntz '2000-02-29 12:00:00', date '2000-02-29', X'41')
        AS v(id, big, name, ok, x, d, t, day, b)"""
    ).select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA])


def by_id(df):
    return [tuple(row) for row in df.orderBy("id").collect()]


def write_files(folder: Path, **files) -> str:
    folder.mkdir()
    for name, content in files.items():
        data = content if isinstance(content, bytes) else content.encode()
        (folder / name.replace("_", ".")).write_bytes(data)
    return str(folder)


# ---------------------------------------------------------------- csv


def test_csv_round_trip(spark, mixed, tmp_path):
    path = str(tmp_path / "out")
    csv_files.write_csv(mixed.repartition(3), path)
    back = csv_files.read_csv(spark, path)
    assert {f.dataType for f in back.schema} == {T.StringType()}
    typed = back.select(
        *[(F.unbase64(f.name) if f.name == "b" else F.col(f.name).cast(f.dataType)).alias(f.name) for f in SCHEMA]
    )
    assert by_id(typed) == by_id(mixed)


def test_csv_text_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "", 'q"x', " y ", 1234567.5)], "i int, n string, e string, q string, s string, f double")
    path = str(tmp_path / "out")
    csv_files.write_csv(df.coalesce(1), path)
    (part,) = Path(path).glob("part-*.csv")
    assert part.read_text() == 'i,n,e,q,s,f\n1,,,"q""x", y ,1.2345675e+06\n'


def test_csv_empty_fields(spark, tmp_path):
    path = write_files(tmp_path / "in", a_csv='a,b,c\n1,"",\n\n2, x ,"y, ""z"""\n')
    assert sorted(map(tuple, csv_files.read_csv(spark, path).collect())) == [("1", "", ""), ("2", " x ", 'y, "z"')]
    nulls = csv_files.read_csv(spark, path, empty_as="null").where("a = '1'").first()
    assert tuple(nulls) == ("1", None, None)


def test_csv_line_breaks_are_found(spark, tmp_path):
    plain = write_files(tmp_path / "plain", a_csv='a,b\n"x","y ""z"""\n')
    broken = write_files(tmp_path / "broken", a_csv='a,b\n"x\n\ny",z\n', b_csv="a,b\n1,2\n")
    assert not csv_splits.find_breaks(spark, plain).broken
    assert csv_splits.find_breaks(spark, broken) == csv_splits.Breaks(True, False)
    assert sorted(map(tuple, csv_files.read_csv(spark, broken).collect())) == [("1", "2"), ("x\n\ny", "z")]


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    values = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_csv_line_breaks_in_splits(spark, tmp_path, small_splits):
    """Records within a split, across two of them and over many; the same rows as with a task per file."""
    draw = random.Random(3)
    words = ['he said ""no""', "a,b", "line\nbreak", "crlf\r\nwithin", "é\n\n\n", '""', "plain", "tail\r"]
    for name, ends in (("unix", "\n"), ("windows", "\r\n")):
        files = {}
        for f in range(3):
            rows = [f'{f}{i},"{" ".join(draw.choices(words, k=draw.randrange(1, 9)))}",{draw.choice(["x", "", " y "])}' for i in range(60)]
            rows[20] = f'{f}20,"{"long field " + chr(10) * 3}{"no break here " * 90}{chr(10)}",z'
            rows[40] = f'{f}40,"{("many lines, one field" + chr(10)) * 70}",z'
            files[f"f{f}_csv"] = ends.join(['id,"the\ntext",end', *rows, "", ""])
        path = write_files(tmp_path / name, **files)
        assert csv_splits.find_breaks(spark, path) == csv_splits.Breaks(True, True)
        found = csv_files.read_csv(spark, path)
        assert found.rdd.getNumPartitions() > 20
        wanted = [tuple(row) for text in files.values() for row in list(csv.reader(io.StringIO(text, newline="")))[1:] if row]
        assert found.columns == ["id", "the\ntext", "end"]
        assert sorted(map(tuple, found.collect())) == sorted(wanted)
        assert found.count() == len(wanted) == 180


@pytest.mark.parametrize(
    ("text", "message"),
    [('a,b\n5" x,y\n6" z,w\n', "within a field that is not quoted"), ('a,b\n"x\ny",1\n2,"no end\n', "does not end"), ('a,b\n"x\ny",1,2\n', "MALFORMED|malformed")],
)
def test_csv_misquoted_fields_fail(spark, tmp_path, text, message):
    with pytest.raises(Exception, match=message):
        csv_files.read_csv(spark, write_files(tmp_path / "in", a_csv=text)).collect()


def test_csv_other_header_with_line_breaks_fails(spark, tmp_path):
    path = write_files(tmp_path / "in", a_csv='a,b\n"1\n",2\n', b_csv="b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        csv_files.read_csv(spark, path).collect()


@pytest.mark.parametrize("bad", ["1\n", "1,2,3\n"])
def test_csv_ragged_rows_fail(spark, tmp_path, bad):
    path = write_files(tmp_path / "in", a_csv="a,b\n1,2\n" + bad)
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        csv_files.read_csv(spark, path).collect()


def test_csv_other_header_fails(spark, tmp_path):
    path = write_files(tmp_path / "in", a_csv="a,b\n1,2\n", b_csv="b,a\n1,2\n")
    with pytest.raises(Exception, match="header"):
        csv_files.read_csv(spark, path).collect()


def test_csv_without_rows_keeps_its_header(spark, tmp_path):
    path = str(tmp_path / "out")
    csv_files.write_csv(spark.createDataFrame([], "a int, b string"), path)
    back = csv_files.read_csv(spark, path)
    assert back.columns == ["a", "b"] and back.count() == 0


# ---------------------------------------------------------------- json


def test_json_round_trip(spark, mixed, tmp_path):
    path = str(tmp_path / "out")
    json_files.write_json(mixed.repartition(3), path)
    assert by_id(json_files.read_json(spark, path, SCHEMA)) == by_id(mixed)


def test_json_keeps_nulls_and_order(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2])], "z int, a string, m array<int>")
    path = str(tmp_path / "out")
    json_files.write_json(df.coalesce(1), path)
    (part,) = Path(path).glob("part-*.json")
    assert part.read_text() == '{"z":1,"a":null,"m":[1,2]}\n'


def test_json_header_is_the_first_object(spark, tmp_path):
    lines = (
        '\n{"z": 1, "a": "x", "n": {"k": 1}, "w": 1}\n\n{"a": "y", "extra": true, "z": 9007199254740993}\n'
        '{"z": 3, "n": {"k": 2}, "w": "t"}\n'
    )
    path = write_files(tmp_path / "in", a_json=lines, b_json='{"other": 1, "z": 4}\n')
    df = json_files.read_json(spark, path)
    assert df.columns == ["z", "a", "n", "w"]
    rows = sorted(tuple(r) for r in df.select("z", "a", F.to_json("n"), "w").collect())
    assert rows == [
        (1, "x", '{"k":1}', "1"), (3, None, '{"k":2}', "t"), (4, None, None, None), (9007199254740993, "y", None, None),
    ]


def test_json_bad_lines_fail(spark, tmp_path):
    path = write_files(tmp_path / "in", a_json='{"a": 1}\n{"a": }\n')
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        json_files.read_json(spark, path).collect()
    other = write_files(tmp_path / "list", a_json="[1]\n")
    with pytest.raises(ValueError, match="expected JSON object"):
        json_files.read_json(spark, other)


def test_json_long_lines(spark, tmp_path):
    path = write_files(tmp_path / "in", a_json=json.dumps({"a": "x" * 1_000_000}) + "\n")
    assert json_files.read_json(spark, path).select(F.length("a")).first()[0] == 1_000_000


# ---------------------------------------------------------------- tabular json

SAMPLE = (
    '{"fields":["lot","crop","organic","tonnes"],"types":["integer","string","boolean","number"],'
    '"rows":[[41,"barley",false,12.25],[42,"flax",true,3.5]]}'
)


def test_tabular_sample(spark, tmp_path):
    path = write_files(tmp_path / "in", a_json=SAMPLE, b_json=SAMPLE.replace("barley", "rübsen").replace("12.25", "null"))
    df = json_tabular.read_json_tabular(spark, path)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "boolean", "double"]
    assert sorted(map(tuple, df.where("lot = 41").collect())) == [(41, "barley", False, 12.25), (41, "rübsen", False, None)]


def test_tabular_round_trip(spark, mixed, tmp_path):
    path = str(tmp_path / "out")
    json_tabular.write_json_tabular(mixed.repartition(2), path)
    back = json_tabular.read_json_tabular(spark, path)
    assert [f.dataType for f in back.schema] == [f.dataType for f in SCHEMA]
    assert by_id(back) == by_id(mixed)


def test_tabular_documents_are_bounded(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 25, 1, 2).select("id", F.concat(F.lit("n"), "id").alias("name"))
    json_tabular.write_json_tabular(df, path, rows_per_document=5)
    documents = [json.loads(p.read_text()) for p in Path(path).glob("part-*")]
    assert all(len(d["rows"]) <= 5 and d["types"] == ["bigint", "text"] for d in documents)
    assert sorted(row[0] for d in documents for row in d["rows"]) == list(range(25))
    assert json_tabular.read_json_tabular(spark, path).count() == 25


def test_tabular_documents_are_bounded_in_bytes(spark, tmp_path):
    df = spark.range(0, 300, 1, 1).select("id", F.repeat(F.lit("x"), (F.col("id") % 7 * 100).cast("int")).alias("t"))
    json_tabular.write_json_tabular(df, str(tmp_path / "b"), rows_per_document=50, bytes_per_document=2_000)
    files = list((tmp_path / "b").glob("part-*"))
    assert len(files) > 30 and max(f.stat().st_size for f in files) < 2_300
    assert sorted(json_tabular.read_json_tabular(spark, str(tmp_path / "b")).collect()) == sorted(df.collect())


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_long_tabular_documents_are_read_in_splits(spark, mixed, tmp_path, small_splits):
    path = str(tmp_path / "out")
    df = spark.range(0, 900, 1, 1).select(
        "id", F.when(F.col("id") % 3 > 0, F.repeat(F.lit('],[ "é\\ \n'), (F.col("id") % 9).cast("int"))).alias("t"), F.col("id").cast("decimal(18,2)").alias("d")
    )
    json_tabular.write_json_tabular(df, path)
    (file,) = Path(path).glob("part-*")
    back = json_tabular.read_json_tabular(spark, path)
    assert sorted(back.collect()) == sorted(df.collect()) and back.schema["d"].dataType == T.DecimalType(18, 2)
    busy = back.select(F.spark_partition_id().alias("task")).distinct().count()
    assert busy >= file.stat().st_size // 4096 > 8
    # A full document that ends in blank lines, and short ones beside it.
    json_tabular.write_json_tabular(df, path, "append", rows_per_document=400, bytes_per_document=9_000)
    assert sorted(json_tabular.read_json_tabular(spark, path).collect()) == sorted(df.union(df).collect())


def test_long_tabular_documents_of_others(spark, tmp_path, small_splits):
    rows = [[i, "x" * (i % 50), bool(i % 2), i / 4] for i in range(600)]
    document = {"fields": ["lot", "crop", "organic", "tonnes"], "types": ["integer", "string", "boolean", "number"], "rows": rows}
    head = json.dumps({**document, "rows": []}, separators=(",", ":"))[:-2]
    texts = {
        "one_line": json.dumps(document),
        "indented": json.dumps(document, indent=1),
        "rows_first": json.dumps(dict(reversed(document.items()))),
        "several_a_line": head + "\n" + ",\n".join(json.dumps(row) for row in rows) + "\n]}\n",
        "a_row_a_line": head + "\n" + "\n,".join(json.dumps(row) for row in rows) + "\n]}",
    }
    for name, text in texts.items():
        path = write_files(tmp_path / name, a_json=text, b_json=SAMPLE)
        found = json_tabular.read_json_tabular(spark, path)
        expected = [*map(tuple, rows), (41, "barley", False, 12.25), (42, "flax", True, 3.5)]
        assert sorted(map(tuple, found.collect())) == sorted(expected), name
    own = texts["a_row_a_line"]
    bad = {
        "a row does not have 4 values": own.replace(',[300, "', ',[1, 300, "'),
        "more than a row": own.replace("\n,[300", ",[300"),
        "more than a row ": own.replace(',[300, "', ',[1,"a",true,2]],"other":[[300, "'),
        "MALFORMED|malformed|Malformed": own.replace(',[300, "', ',[300 "'),
        "malformed|MALFORMED|Malformed": own.replace("\n,[300", "\n[300"),
        "different fields or types": own.replace('"crop"', '"plant"'),
        "MALFORMED|Malformed|malformed": own.removesuffix("\n]}"),
    }
    for i, (message, text) in enumerate(bad.items()):
        path = write_files(tmp_path / f"bad{i}", a_json=SAMPLE, b_json=text)
        with pytest.raises(Exception, match=message.strip()):
            json_tabular.read_json_tabular(spark, path).collect()


def test_short_tabular_documents_take_no_scan_by_lines(spark, tmp_path):
    path = write_files(tmp_path / "in", a_json=SAMPLE)
    plan = json_tabular.read_json_tabular(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


@pytest.mark.parametrize("kind", ["no partitions", "empty partitions", "local"])
def test_tabular_without_rows(spark, tmp_path, kind):
    path = str(tmp_path / "out")
    empty = {
        "no partitions": lambda: spark.createDataFrame(spark.sparkContext.emptyRDD(), "a int, b string"),
        "empty partitions": lambda: spark.range(0, 9, 1, 3).where("id > id + 1").selectExpr("cast(id as int) a", "'' b"),
        "local": lambda: spark.createDataFrame([], "a int, b string"),
    }[kind]()
    json_tabular.write_json_tabular(empty, path)
    texts = [p.read_text() for p in Path(path).glob("part-*")]
    assert texts and all(json.loads(t) == {"fields": ["a", "b"], "types": ["int", "text"], "rows": []} for t in texts)
    back = json_tabular.read_json_tabular(spark, path)
    assert back.columns == ["a", "b"] and back.count() == 0


@pytest.mark.parametrize(
    ("document", "message"),
    [
        (SAMPLE.replace('"number"', '"thing"'), "unknown type 'thing' for column 'tonnes'"),
        (SAMPLE.replace('[42,"flax",true,3.5]', '[42,"flax"]'), "a row does not have 4 values"),
        (SAMPLE.replace("3.5]]", "3.5],]"), "MALFORMED|malformed|Malformed"),
        (SAMPLE.replace('[42,"flax"', '["two","flax"'), "CAST_INVALID_INPUT"),
        (SAMPLE.replace(',"types":["integer","string","boolean","number"]', ""), "columns and types mismatch"),
    ],
)
def test_tabular_errors(spark, tmp_path, document, message):
    path = write_files(tmp_path / "in", a_json=document)
    with pytest.raises(Exception, match=message):
        json_tabular.read_json_tabular(spark, path).collect()


def test_tabular_headers_must_agree(spark, tmp_path):
    path = write_files(tmp_path / "in", a_json=SAMPLE, b_json=SAMPLE.replace('"crop"', '"plant"'))
    with pytest.raises(Exception, match="different fields or types"):
        json_tabular.read_json_tabular(spark, path).collect()


# ---------------------------------------------------------------- workbooks


def workbook(sheet: str, shared: str = "", second: str = "") -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    kind = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w") as package:
        package.writestr(
            "xl/workbook.xml",
            f'<workbook {main} {rel}><sheets><sheet name="A" sheetId="1" r:id="r2"/><sheet name="B" sheetId="2" r:id="r1"/></sheets></workbook>',
        )
        package.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="r1" Type="{kind}" Target="worksheets/one.xml"/>'
            f'<Relationship Id="r2" Type="{kind}" Target="/xl/worksheets/two.xml"/></Relationships>',
        )
        package.writestr("xl/worksheets/one.xml", f"<worksheet {main}><sheetData>{second}</sheetData></worksheet>")
        package.writestr("xl/worksheets/two.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        if shared:
            package.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
    return target.getvalue()


HEADER = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>flag</t></is></c></row>'
SHARED = "<si><t>id</t></si><si><r><t>na</t></r><r><t>me</t></r><rPh><t>no</t></rPh></si><si><t>Zoë</t></si>"


def test_workbook_cells(spark, tmp_path):
    rows = (
        '<row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" t="b"><v>1</v></c><c r="D2"><v>9</v></c></row>'
        '<row r="3"><c r="A3"><v>2.5</v></c></row>'
        '<row r="4"><c r="B4" t="str"><v>f</v></c><c r="C4" t="b"><v>0</v></c></row>'
        '<row r="5"><c r="A5" t="n"><v>45000</v></c><c r="C5"/></row>'
        '<row r="6"><c r="A6"><v>3</v></c><c r="B6" t="e"><v>#DIV/0!</v></c></row>'
    )
    other = '<row><c t="s"><v>1</v></c></row>'
    path = write_files(tmp_path / "in", a_xlsx=workbook(HEADER + rows, SHARED, other), b_xlsx=workbook(HEADER, SHARED))
    df = workbooks.read_workbooks(spark, path, origin_columns=True)
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "bigint", "double", "string", "boolean"]
    assert [tuple(r)[1:] for r in df.orderBy("_row").collect()] == [
        (1, 1.0, "Zoë", True), (2, 2.5, None, None), (3, None, "f", False), (4, 45000.0, "", None), (5, 3.0, "#DIV/0!", None),
    ]


def test_workbook_mixed_columns_are_text(spark, tmp_path):
    rows = '<row><c><v>1</v></c><c><v>2</v></c><c t="b"><v>1</v></c></row><row><c t="b"><v>1</v></c><c t="s"><v>2</v></c></row>'
    path = write_files(tmp_path / "in", a_xlsx=workbook(HEADER + rows, SHARED))
    df = workbooks.read_workbooks(spark, path)
    assert sorted(map(tuple, df.collect()), key=repr) == [("1", "2", True), ("true", "Zoë", None)]


def test_workbook_headers_must_agree(spark, tmp_path):
    path = write_files(
        tmp_path / "in", a_xlsx=workbook(HEADER, SHARED), b_xlsx=workbook(HEADER.replace("flag", "other"), SHARED)
    )
    with pytest.raises(Exception, match="has the header"):
        workbooks.read_workbooks(spark, path).collect()


def test_workbook_round_trip(spark, mixed, tmp_path):
    path = str(tmp_path / "out")
    workbooks.write_workbooks(mixed.repartition(2), path)
    assert by_id(workbooks.read_workbooks(spark, path, SCHEMA)) == by_id(mixed)
    assert not list(Path(path).glob("_temporary*"))
    with pytest.raises(FileExistsError):
        workbooks.write_workbooks(mixed, path)


def test_workbook_sheets_are_bounded(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 25, 1, 2).select("id", F.when(F.col("id") > 3, F.col("id") / 2).alias("half"))
    workbooks.write_workbooks(df, path, rows_per_workbook=5)
    sizes = [len(list(sheet_xml.read_rows(io.BytesIO(p.read_bytes())))) for p in Path(path).glob("*.xlsx")]
    assert sum(sizes) - len(sizes) == 25 and max(sizes) == 6
    back = workbooks.read_workbooks(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(
        [(float(i), i / 2 if i > 3 else None) for i in range(25)], key=str
    )


def test_workbook_without_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    workbooks.write_workbooks(spark.range(0, 9, 1, 3).where("id > id + 1").selectExpr("id", "'' name"), path)
    back = workbooks.read_workbooks(spark, path)
    assert back.columns == ["id", "name"] and back.count() == 0


def test_failed_workbook_copy_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    bad = spark.range(0, 100, 1, 4).select(F.assert_true(F.col("id") < 90).isNull().alias("ok"), "id")
    with pytest.raises(Exception, match="USER_RAISED|is not true"):
        workbooks.write_workbooks(bad, str(path))
    # A task that is still running may write on into the hidden folder; nothing reads that.
    assert not list(path.glob("*.xlsx"))


def test_sheet_text_survives(tmp_path):
    texts = ["a\x01b", "_x0041_", "_x_", " lead", "tab\t", "line\nbreak", "cr\r\n", "<&>", "￿", ""]
    target = io.BytesIO()
    plain = [text for text in texts if text in (" lead", "<&>", "")]
    for values in (texts, plain):
        sheet_xml.write_rows(target, ["t"], [pa.RecordBatch.from_pydict({"t": values})])
        target.seek(0)
        assert [row[0] for row in sheet_xml.read_rows(target)][1:] == [("s", value) for value in values]
        target = io.BytesIO()


def flat_parts(target):
    parts = list(sheet_xml.read_parts(target))
    return [list(zip(*row, strict=True)) for kinds, cells in parts for row in zip(kinds.to_pylist(), cells.to_pylist(), strict=True)]


def test_own_sheets_are_not_parsed(monkeypatch):
    """A sheet of this library is taken apart by chunks, with the rows that parsing gives; no row of it is parsed."""
    draw = random.Random(5)
    texts = ["", "<c/>", "a & b", "&lt;", "_x000D_", "cr\r\n", "\x01", "é<>\"'", "]]>", "\n\t", "\uffff", "</row><row>", None, "𝄞", "1"]
    n = 3000
    batch = pa.RecordBatch.from_pydict({
        "t": [draw.choice(texts) for _ in range(n)],
        "d": [draw.choice([1.5, float("nan"), float("inf"), 1e300, -0.0, None, 5e-324]) for _ in range(n)],
        "i": [draw.choice([1, -5, None]) for _ in range(n)],
        "b": [draw.choice([True, False, None]) for _ in range(n)],
    })
    for part in (batch, batch.slice(7, 900), batch.slice(0, 0), batch.select(["i"])):
        target = io.BytesIO()
        sheet_xml.write_rows(target, part.schema.names, [part])
        found = list(sheet_xml.read_rows(target))
        with monkeypatch.context() as patch:
            patch.setattr(sheet_xml, "read_rows", None)
            patch.setattr(sheet_xml, "_CHUNK", 1000)
            assert flat_parts(target) == found


def test_sheets_of_others_are_parsed():
    """Whatever a sheet holds, parts of rows have what parsing gives, or fail as it does."""
    opening, closing = sheet_xml._OPENING.decode(), sheet_xml._CLOSING.decode()
    text = '<c t="inlineStr"><is><t xml:space="preserve">'
    own = "<row><c><v>1</v></c><c/></row>"
    bodies = [
        own + '<row r="2"><c r="B2"><v>2</v></c></row>' + own, "<row/>", "", "<row></row>", "<row><!-- x --><c><v>1</v></c></row>", own + " " + own,
        "<row><c><v>x</v></c><c><v></v></c><c><v> 5 </v></c><c><v>1e5</v></c><c><v>nan</v></c></row>", "<row><c><v>&#49;</v></c></row>",
        '<row><c t="b"><v>0</v></c><c t="b"><v></v></c><c t="b"><v>7</v></c></row>', f"<row>{text}a</v></c></row>", "<row><c><v>1</t></is></c></row>",
        f"<row>{text}a\r\nb</t></is></c></row>", f"<row>{text}<![CDATA[<c/>]]></t></is></c></row>", f"<row>{text}a&#x41;_x0041_</t></is></c></row>",
        "<row><c/>x</row>", "<row><c><v>1&amp;</v></c></row>", "<row><c><v>1&nbsp;</v></c></row>", own + "<row><c/>", "<row><row><c/></row></row>",
    ]

    def tried(read, target):
        try:
            return list(read(target))
        except ElementTree.ParseError:
            return "fails"

    for body, end in itertools.product(bodies, (closing, "", closing + " ")):
        target = io.BytesIO()
        with zipfile.ZipFile(target, "w") as package:
            for name, content in sheet_xml._PACKAGE.items():
                package.writestr(name, content)
            package.writestr("xl/worksheets/sheet1.xml", opening + body + end)
        assert tried(flat_parts, target) == tried(sheet_xml.read_rows, target), body + end


def test_number_cells(tmp_path):
    values = [1.5, 1e21, float("nan"), float("-inf"), None]
    target = io.BytesIO()
    batch = pa.RecordBatch.from_pydict({"f": values, "i": [1, -2, None, 2**60, 0], "b": [True, None, False, True, False]})
    sheet_xml.write_rows(target, ["f", "i", "b"], [batch])
    rows = list(sheet_xml.read_rows(target))[1:]
    assert [row[1:] for row in rows[:2]] == [[("n", "1"), ("b", "true")], [("n", "-2"), ("e", "")]]
    assert rows[3][1] == ("n", str(2**60))
    assert [kind for (kind, _), *_ in rows] == ["n", "n", "s", "s", "e"]
    assert [float(text) for (_, text), *_ in rows[:2]] == values[:2]


def test_json_keys_beyond_the_header(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b": 1}\n')
    (tmp_path / "b.json").write_text('{"b": 2, "z": {}, "a": "x"}\n')
    path = str(tmp_path)
    assert json_files.read_json(spark, path).columns == ["b"]
    with pytest.raises(ValueError, match="'a', 'z'"):
        json_files.read_json(spark, path, extra="fail")
    for schema in (None, T.StructType([T.StructField("b", T.LongType())])):
        wide = json_files.read_json(spark, path, schema, extra="widen")
        assert sorted(map(tuple, wide.collect())) == [(1, None, None), (2, "x", "{}")] and wide.columns == ["b", "a", "z"]


def test_json_objects_used_as_maps(spark, tmp_path, monkeypatch):
    objects = [{"b": 1, **{f"k{i * 10 + j:03}": j for j in range(10)}} for i in range(40)]
    (tmp_path / "a.json").write_text("".join(json.dumps(o) + "\n" for o in [{"b": 0}, *objects]))
    path = str(tmp_path)
    with pytest.raises(ValueError) as error:
        json_files.read_json(spark, path, extra="fail")
    assert str(error.value).count("'k") == json_files.NAMED
    assert len(json_files.read_json(spark, path, extra="widen").columns) == 401
    monkeypatch.setattr(json_files, "WIDEST", 399)
    with pytest.raises(ValueError, match="more than 399 keys"):
        json_files.read_json(spark, path, extra="widen")
    assert json_files.read_json(spark, path).columns == ["b"]
    assert json_files.keys_beyond(spark, path, [], 500) == ["b", *[f"k{i:03}" for i in range(400)]]


def test_cells_beyond_the_header(spark, tmp_path, monkeypatch):
    rows = [[("s", "b")], [("n", "1"), ("n", "2.5"), ("e", "")], [("n", "3")]]
    (tmp_path / "a.xlsx").write_bytes(b"-")
    monkeypatch.setattr(workbooks.sheet_xml, "read_rows", lambda file: iter(rows))
    batch = pa.RecordBatch.from_pydict({"path": ["p"], "content": [b"-"]})
    assert [b.column("cells").to_pylist() for b in workbooks._cells_of(["b"], "drop")([batch])] == [[["1"], ["3"]]]
    assert [b.column("cells").to_pylist() for b in workbooks._cells_of(["b"], "widen")([batch])] == [[["1", "2.5", ""], ["3"]]]
    with pytest.raises(ValueError, match="beyond the header"):
        list(workbooks._cells_of(["b"], "fail")([batch]))
    monkeypatch.setattr(workbooks, "read_header", lambda spark, path: ["b"])
    cells = spark.createDataFrame([("p", 1, "nne", ["1", "2.5", ""]), ("p", 2, "n", ["3"])], workbooks._CELLS)
    monkeypatch.setattr(workbooks, "_workbooks", lambda spark, path: type("", (), {"mapInArrow": staticmethod(lambda *_: cells)}))
    wide = workbooks.read_workbooks(spark, "p", extra="widen")
    assert wide.columns == ["b", "_c1"] and sorted(map(tuple, wide.collect()), key=repr) == [(1.0, 2.5), (3.0, None)]
