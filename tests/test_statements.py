"""Statement rules against a model that goes through a text line by line."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowferry.functions import statements

SPACES = " \t\x0b\f\r\u0085       　"


def model_clean(sql):
    out, open_block = [], False
    for raw in sql.lower().split("\n"):
        line = raw.strip(SPACES)
        if not line or line[:2] in ("--", "//"):
            continue
        while open_block or line.startswith("/*"):
            _, found, rest = line.partition("*/")
            open_block = not found
            line = rest.strip(SPACES) if found else ""
            if open_block:
                break
        line = line.split("--")[0].split("//")[0]
        if line:
            out.append(line)
    return " ".join(out)


CASES = {
    "select 1": "select 1",
    "SELECT 1 -- one\nFROM t": "select 1  from t",
    "-- a\n// b\n select 1": "select 1",
    "/* a */ /* b */ select 1": "select 1",
    "/* a\n b\n*/ select /* c */ 1": "select /* c */ 1",
    "/* a\n-- */\n*/ select 1": "select 1",
    "/*/ select 1": "select 1",
    "/* a */ -- b\nselect 1": "select 1",
    "/* open\nselect 1": "",
    "select '--x'": "select '",
    "select 'http://x'": "select 'http:",
    "": "",
    " \n\t\n": "",
    "a\r\n/* b */\r\nc": "a c",
    "a \n　b": "a b",
}


def clean_all(spark, sqls):
    df = spark.createDataFrame(list(enumerate(sqls)), "i int, s string").repartition(2)
    return [r.c for r in df.select("i", statements.clean_statement(F.col("s")).alias("c")).orderBy("i").collect()]


def test_cases(spark):
    assert clean_all(spark, list(CASES)) == list(CASES.values())
    assert [model_clean(sql) for sql in CASES] == list(CASES.values())


PIECES = st.lists(
    st.sampled_from(["--", "//", "/*", "*/", "/", "*", "-", "\n", "\n", " ", "\t", "\r", " ", "a", "B", "é", "😀", "'"]),
    max_size=25,
).map("".join)


@settings(max_examples=12, deadline=None)
@given(st.lists(PIECES, min_size=60, max_size=120))
def test_model(spark, sqls):
    assert clean_all(spark, sqls) == [model_clean(sql) for sql in sqls]


def test_long_texts_take_linear_time(spark):
    texts = [
        "/* x */ " * 50_000 + "select 1",
        " " * 500_000 + "select 1" + " " * 500_000 + "x",
        "/* " * 300_000,
        "-- a\n" * 100_000 + "select 1",
    ]
    assert [len(c) for c in clean_all(spark, texts)] == [8, 500_009, 0, 8]


@pytest.mark.parametrize(
    ("vendor", "sql", "command", "kind"),
    [
        ("postgresql", "insert into t values (1)", "insert", "non-query"),
        ("postgresql", "insert into t values (1) returning id", "insert", "query"),
        ("postgresql", "insert into t values (1) returning", "insert", "non-query"),
        ("mssql", "delete from t output deleted.id where a = 1", "delete", "query"),
        ("mssql", "delete from t where a = 1 returning id", "delete", "non-query"),
        ("mysql", "update t set a = 1 output b", "update", "non-query"),
        ("mysql", "DROP\tTABLE t", "drop", "non-query"),
        ("mysql", "alter table t add c int", "alter", "non-query"),
        ("mysql", "create table returning (a int)", "create", "query"),
        ("mysql", "with q as (select 1) insert into t select * from q", "with", "query"),
        ("mysql", "merge into t using s on 1=1", "merge", "query"),
        ("mysql", "truncate table t", "truncate", "query"),
        ("mysql", "insert;", "insert;", "query"),
        ("mysql", "-- nothing", "", "query"),
    ],
)
def test_classification(spark, vendor, sql, command, kind):
    df = spark.createDataFrame([(sql, vendor)], "s string, v string")
    row = statements.classify_statements(df, "s", "v").first()
    assert (row.stmt_cmd, row.stmt_type) == (command, kind)


def test_identifiers(spark):
    names = {
        "a$1": True, "1a": False, "é_b": True, "a-b": False, "_x": True, "": False, "a" * 63: True, "a" * 64: False,
        "a\n": False, "$a": False, "Ж٣": True, "a b": False,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    found = {r.n: r.v for r in df.select("n", statements.is_valid_identifier(F.col("n")).alias("v")).collect()}
    assert found == names
    assert {n: statements.is_identifier(n) for n in names} == names
