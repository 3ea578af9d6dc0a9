import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions import sqltypes, texts

# Vendor, type name, canonical type.
CANONICAL = [
    ("postgresql", "INT", "int"), ("postgresql", "integer", "int"), ("postgresql", "INT4", "int"),
    ("clickhouse", "Int32", "int"), ("postgresql", "INT8", "bigint"), ("clickhouse", "Int64", "bigint"),
    ("mssql", "TINYINT", "smallint"), ("mysql", "TINYINT", "smallint"), ("mysql", "TINYINT(1)", "boolean"),
    ("mariadb", "tinyint(10)", "boolean"), ("mssql", "TINYINT(1)", "smallint"), ("postgresql", "INT2", "smallint"),
    ("clickhouse", "Int16", "smallint"), ("clickhouse", "UInt8", "boolean"), ("clickhouse", "UInt16", "int"),
    ("clickhouse", "UInt32", "bigint"), ("clickhouse", "UInt64", "bigint"), ("postgresql", "bool", "boolean"),
    ("mssql", "money", "decimal"), ("postgresql", "numeric(10,3)", "decimal"), ("sqlite3", "DEC", "decimal"),
    ("sqlite3", "REAL", "float"), ("postgresql", "double precision", "float"), ("clickhouse", "Float32", "float"),
    ("mssql", "nchar(3)", "char"), ("postgresql", "character", "char"), ("clickhouse", "FixedString(8)", "char"),
    ("mssql", "nvarchar(20)", "varchar"), ("clickhouse", "String", "varchar"), ("sqlite3", "CLOB", "text"),
    ("postgresql", "bytea", "binary"), ("mssql", "VARBINARY(MAX)", "binary"), ("clickhouse", "Date32", "date"),
    ("postgresql", "time", "time"), ("mssql", "smalldatetime", "datetime"), ("clickhouse", "DateTime64(3)", "datetime"),
    ("mssql", "uniqueidentifier", "uuid"), ("mysql", "BIGINT UNSIGNED", "bigint"), ("mysql", "int(10) unsigned", "int"),
    ("clickhouse", "Nullable(Decimal(18,2))", "decimal"), ("clickhouse", "LowCardinality(String)", "varchar"),
    ("clickhouse", "LowCardinality(Nullable(String))", "text"), ("clickhouse", "Nullable(LowCardinality(String))", "varchar"),
    ("mssql", "BIT", "text"), ("postgresql", "JSONB", "text"), ("postgresql", "", "text"), ("clickhouse", "Nullable", "text"),
    ("postgresql", "  uuid ", "uuid"), ("postgresql", "DECIMAL (18,2)", "text"), ("postgresql", None, "text"),
    (None, "INT", "int"),
]


def test_canonical_types(spark):
    df = spark.createDataFrame([(v, t) for v, t, _ in CANONICAL], "v string, t string")
    rows = df.select("v", "t", sqltypes.canonical_type(F.col("v"), F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in rows] == CANONICAL


def test_strict_types_refuse_unknown_names(spark):
    df = spark.createDataFrame([("uuid",), ("JSONB",)], "t string")
    strict = df.select(sqltypes.canonical_type("postgresql", F.col("t"), strict=True).alias("c"))
    assert strict.where("t = 'uuid'").first().c == "uuid"
    with pytest.raises(Exception, match="unknown column type: JSONB"):
        strict.collect()


def test_vendor_types_cover_the_matrix(spark):
    pairs = [(v, c) for c in sqltypes.CANONICAL_TYPES for v in sqltypes.VENDORS]
    df = spark.createDataFrame([*pairs, ("oracle", "int"), ("mysql", "json"), (None, "int")], "v string, c string")
    rows = df.select("v", "c", sqltypes.vendor_type(F.col("v"), F.col("c")).alias("t")).collect()
    for v, c, t in rows:
        assert t == (sqltypes.VENDOR_TYPES[c][sqltypes.VENDORS.index(v)] if (v, c) in pairs else "")


def test_conversion(spark):
    row = spark.range(1).select(sqltypes.convert_type("clickhouse", "postgresql", F.lit("UInt8")).alias("t")).first()
    assert row.t == "BOOLEAN"


def test_quoting(spark):
    cases = [("mysql", "a`b", "`a``b`"), ("mssql", "a]b", "[a]]b]"), ("postgresql", 'a"b', '"a""b"'),
             ("sqlite3", "x", "`x`"), ("clickhouse", "", "``"), ("mariadb", 'a"', '`a"`'), ("oracle", "a", "")]
    df = spark.createDataFrame([c[:2] for c in cases], "v string, n string")
    rows = df.select("v", "n", sqltypes.quote_identifier(F.col("v"), F.col("n")).alias("q")).collect()
    assert [tuple(r) for r in rows] == cases
    assert [sqltypes.quoted(v, n) for v, n, q in cases if q] == [q for *_, q in cases if q]


def test_create_table_statement(spark):
    schema = T.StructType.fromDDL("id bigint, `a]b` string, x double, n decimal(10,3), t timestamp_ntz, b binary")
    assert sqltypes.create_table_statement("mssql", "[t]", schema) == (
        "CREATE TABLE [t] ([id] BIGINT,[a]]b] TEXT,[x] FLOAT,[n] DECIMAL(18,2),[t] DATETIME2,[b] VARBINARY(MAX))"
    )
    with pytest.raises(ValueError, match="columns and types mismatch or empty"):
        sqltypes.create_table_statement("mssql", "[t]", T.StructType())


FLOATS = [
    (0.0, "0", "0"), (1.0, "1", "1"), (-1.5, "-1.5", "-1.5"), (104999.0, "104999", "104999"), (999999.5, "999999.5", "999999.5"),
    (1e6, "1e+06", "1000000"), (-1234567.5, "-1.2345675e+06", "-1234567.5"), (1e7, "1e+07", "10000000"),
    (123456789.0, "1.23456789e+08", "123456789"), (0.001, "0.001", "0.001"), (0.0001, "0.0001", "0.0001"),
    (-0.00015, "-0.00015", "-0.00015"), (2.5e-5, "2.5e-05", "0.000025"), (1e21, "1e+21", "1e+21"), (1e-7, "1e-07", "1e-7"),
    (1.5e300, "1.5e+300", "1.5e+300"), (float("inf"), "+Inf", "Infinity"), (float("-inf"), "-Inf", "-Infinity"),
    (float("nan"), "NaN", "NaN"), (123456789012345680.0, "1.2345678901234568e+17", "123456789012345680"),
]


def test_float_texts(spark):
    df = spark.createDataFrame([(i, v) for i, (v, *_) in enumerate(FLOATS)], "i int, v double")
    shown = df.select("i", texts.float_text(F.col("v")).alias("f"), texts.script_number_text(F.col("v")).alias("s"))
    assert [(r.f, r.s) for r in shown.orderBy("i").collect()] == [(f, s) for _, f, s in FLOATS]


def shortest(value, plain_from, plain_to, width):
    """A float's shortest digits, plain within two exponents and else with an exponent."""
    number = decimal.Decimal(repr(value)).normalize()
    if plain_from <= number.adjusted() < plain_to:
        return f"{number:f}"
    mantissa, _, exponent = f"{number:e}".partition("e")
    return f"{mantissa}e{'-' if int(exponent) < 0 else '+'}{abs(int(exponent)):0{width}d}"


def test_float_texts_of_many_sizes(spark):
    rng = random.Random(3)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 15) for _ in range(3_000)]
    values += [round(rng.uniform(0, 1e8), rng.randint(0, 4)) for _ in range(3_000)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    shown = df.select("i", texts.float_text(F.col("v")).alias("f"), texts.script_number_text(F.col("v")).alias("s"))
    for row in shown.collect():
        value = values[row.i]
        assert (row.f, row.s) == (shortest(value, -4, 6, 2), shortest(value, -6, 21, 1))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_time_texts(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = (
            spark.sql(
                "select timestamp_ntz '2024-03-10 02:30:00.125' n, date '2024-01-02' d, "
                "timestamp '2024-01-01 00:00:00.5Z' z, X'00ff' b, array(1, null) a, cast(null as timestamp_ntz) m"
            )
        )
        flat, cells = texts.to_text(row).first(), texts.render_cells(row).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    at = "2024-01-01T00:00:00" if zone == "UTC" else "2023-12-31T19:00:00"
    offset = "Z" if zone == "UTC" else "-05:00"
    assert tuple(flat) == ("2024-03-10T02:30:00Z", "2024-01-02T00:00:00Z", at + offset, "AP8=", "[1,null]", None)
    assert tuple(cells) == ("2024-03-10T02:30:00.125Z", "2024-01-02T00:00:00Z", f"{at}.5{offset}", "AP8=", "[1,null]", "null")


def test_json_rows(spark):
    df = spark.createDataFrame(
        [(1, 'a"é\n', None, True, [1.5], decimal.Decimal("1.20"), dt.datetime(2024, 1, 1)), (None,) * 7],
        "i int, `s.x` string, n string, b boolean, a array<double>, d decimal(10,2), t timestamp_ntz",
    )
    lists = [r[0] for r in df.select(texts.json_list(df)).collect()]
    assert lists == ['[1,"a\\"é\\n",null,true,[1.5],1.20,"2024-01-01T00:00:00Z"]', "[null,null,null,null,null,null,null]"]
    objects = [r[0] for r in df.select(texts.json_object(df)).collect()]
    assert objects[1] == '{"i":null,"s.x":null,"n":null,"b":null,"a":null,"d":null,"t":null}'


def test_alignment():
    right = {"int": True, "STRING": False, "name": False, "Text": False, "unknown": False, "varchar(3)": False, "double": True}
    assert {name: texts.aligns_right(name) for name in right} == right


def test_lengths_count_utf16_units(spark):
    df = spark.createDataFrame([("a",), ("é",), ("a😀",)], "s string")
    assert [r[0] for r in df.select(texts.shown_length(F.col("s"))).collect()] == [1, 1, 3]


def test_small_functions(spark):
    paths = {"a/b": "b", "a\\b.db": "b.db", "": "", "x": "x", "a/": "", "/a/b\\c": "c"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.n for r in df.select("p", texts.base_name(F.col("p")).alias("n")).collect()} == paths
    taken = spark.createDataFrame([(0,), (1,), (1_000_000,), (1_000_001,)], "n long")
    shown = taken.select(texts.duration_ms(F.col("n")), texts.duration_text(F.col("n"), 15)).collect()
    assert [tuple(r) for r in shown] == [(0, "<15 ms"), (1, "1 ms"), (1, "1 ms"), (2, "2 ms")]
