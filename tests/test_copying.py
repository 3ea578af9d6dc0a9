import itertools
import uuid
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rowferry.endpoint import Endpoint
from rowferry.operators.copying import copy, export_name, read_endpoint, well_split, write_endpoint
from rowferry.plans import registry, session
from rowferry.sources import tables


@pytest.fixture
def people(spark):
    name = f"people_{uuid.uuid4().hex[:8]}"
    df = spark.createDataFrame([(1, "Ann", 1.5), (2, "Bób", -2.0), (3, "C", 0.0)], "id int, name string, score double")
    df.createOrReplaceTempView(name)
    return name


def new_name():
    return f"t_{uuid.uuid4().hex[:8]}"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark, people):
    name = new_name()
    copy(spark, Endpoint("table", table=people), Endpoint("table", table=name, new_table=True))
    return name


ORIGINS = ["table", "query", "csv", "json", "jsonTabular", "xlsx"]
DESTINATIONS = ["table", "new table", "csv", "json", "jsonTabular", "xlsx"]


@pytest.mark.parametrize(("origin", "destination"), list(itertools.product(ORIGINS, DESTINATIONS)))
def test_copy_matrix(spark, tmp_path, people, origin, destination):
    """Every origin into every destination; the values arrive, and the counts are right."""
    source = Endpoint("table", table=people)
    if origin == "query":
        source = Endpoint("query", query=f"SELECT * FROM {people} WHERE id > :least", args={"least": 0})
    elif origin != "table":
        write_endpoint(spark.table(people), Endpoint("file", format=origin, path=str(tmp_path / "in")))
        source = Endpoint("file", format=origin, path=str(tmp_path / "in"))
    if destination == "table":
        target = Endpoint("table", table=new_name())
        spark.sql(f"CREATE TABLE {target.table} (score double, id int, name string, extra string) USING parquet")
    elif destination == "new table":
        target = Endpoint("table", table=new_name(), new_table=True)
    else:
        target = Endpoint("file", format=destination, path=str(tmp_path / "out"))
    if destination == "new table" and origin in ("csv", "json", "xlsx"):
        with pytest.raises(ValueError, match="columns and types mismatch or empty"):
            copy(spark, source, target)
        source = Endpoint("file", format=origin, path=source.path, options={"infer": True})
    assert tuple(copy(spark, source, target).first()) == (3, 3)
    back = read_endpoint(spark, target)
    typed = back.select(F.col("id").cast("double").cast("int"), "name", F.col("score").cast("double"))
    assert rows(typed) == rows(spark.table(people))


def test_unknown_endpoints(spark):
    with pytest.raises(ValueError, match="unsupported reader. type: file, format: parquet"):
        read_endpoint(spark, Endpoint("file", format="parquet"))
    with pytest.raises(ValueError, match="unsupported writer. type: query, format: None"):
        write_endpoint(spark.range(1), Endpoint("query", query="select 1"))


def failing(people):
    return Endpoint(
        "query",
        query=f"SELECT id, name, CASE WHEN assert_true(id < 3) IS NULL THEN score END AS score "
        f"FROM (SELECT /*+ REPARTITION(3, id) */ * FROM {people})",
    )


def test_failing_append_leaves_the_table(spark, people, table):
    with pytest.raises(Exception, match="is not true|USER_RAISED"):
        copy(spark, failing(people), Endpoint("table", table=table))
    spark.catalog.refreshTable(table)
    assert rows(spark.table(table)) == rows(spark.table(people))


def test_failing_new_table_is_not_there(spark, people):
    name = new_name()
    with pytest.raises(Exception, match="is not true|USER_RAISED"):
        copy(spark, failing(people), Endpoint("table", table=name, new_table=True))
    assert not spark.catalog.tableExists(name)


@pytest.mark.parametrize("file_format", ["csv", "json", "jsonTabular", "xlsx"])
def test_failing_export_shows_nothing(spark, tmp_path, people, file_format):
    path = tmp_path / "out"
    with pytest.raises(Exception, match="is not true|USER_RAISED"):
        copy(spark, failing(people), Endpoint("file", format=file_format, path=str(path)))
    assert not [p for p in path.glob("**/*") if p.is_file() and not p.name.startswith((".", "_"))]


def test_new_table_must_not_exist(spark, people, table):
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        copy(spark, Endpoint("table", table=people), Endpoint("table", table=table, new_table=True))


def test_append_goes_by_name(spark, people, table):
    part = Endpoint("query", query="SELECT 'D' AS NAME, 4 AS id")
    assert tuple(copy(spark, part, Endpoint("table", table=table)).first()) == (1, 1)
    assert (4, "D", None) in rows(spark.table(table))
    with pytest.raises(ValueError, match="the target has no column nope"):
        copy(spark, Endpoint("query", query="SELECT 1 AS nope"), Endpoint("table", table=table))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        copy(spark, Endpoint("query", query="SELECT 'x' AS id"), Endpoint("table", table=table))


def test_staged_append(spark, people, table):
    assert tables.append_staged(spark.table(people), Endpoint("table", table=table), expected_rows=3) == 3
    assert spark.table(table).count() == 6
    with pytest.raises(ValueError, match="3 rows staged, 4 expected"):
        tables.append_staged(spark.table(people), Endpoint("table", table=table), expected_rows=4)
    assert spark.table(table).count() == 6


@pytest.mark.parametrize("destination", ["csv", "json", "jsonTabular", "xlsx", "table", "new table"])
@pytest.mark.parametrize("empty", ["WHERE false", "WHERE id > 99"])
def test_copy_of_nothing(spark, tmp_path, people, table, destination, empty):
    target = {
        "table": Endpoint("table", table=table),
        "new table": Endpoint("table", table=new_name(), new_table=True),
    }.get(destination, Endpoint("file", format=destination, path=str(tmp_path / "out")))
    origin = Endpoint("query", query=f"SELECT id, name FROM {people} {empty}")
    assert tuple(copy(spark, origin, target).first()) == (0, 0)
    if destination not in ("json", "table"):
        back = read_endpoint(spark, target)
        assert back.columns == ["id", "name"] and back.count() == 0


def test_partitions_set_the_number_of_files(spark, tmp_path, people):
    target = Endpoint("file", format="csv", path=str(tmp_path / "out"), options={"partitions": 2})
    assert tuple(copy(spark, Endpoint("table", table=people), target).first()) == (3, 3)
    assert len(list((tmp_path / "out").glob("part-*"))) == 2


def test_split_tables_are_copied_without_a_shuffle(spark, tmp_path, monkeypatch):
    """A table whose scan deals its rows out is copied as it is split; one that a task would read alone is shuffled."""
    parallel, asked = spark.sparkContext.defaultParallelism, []
    made = registry.copy
    monkeypatch.setattr(registry, "copy", lambda s, origin, to: asked.append(to.options.get("partitions")) or made(s, origin, to))
    rows = spark.range(4000).withColumn("v", F.col("id") * 2)
    for name, parts in (("even", 4 * parallel), ("one", 1)):
        (tmp_path / name).mkdir()
        rows.repartition(parts).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        for file_format in ("json", "csv"):
            back = registry._through_files(spark, f"{tmp_path}/{name}", "lineitem", file_format, typed=file_format == "json")
            assert back.count() == 4000 and back.agg(F.sum("v")).first()[0] == 2 * sum(range(4000))
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert asked == [None, None, shuffled, shuffled]
    assert not well_split(spark.range(0, 100, 1, 1)) or parallel <= 2
    assert not well_split(spark.range(0))


def test_query_in_a_schema(spark, people):
    spark.sql("CREATE DATABASE IF NOT EXISTS aside")
    name = new_name()
    copy(spark, Endpoint("table", table=people), Endpoint("table", schema="aside", table=name, new_table=True))
    found = read_endpoint(spark, Endpoint("query", schema="aside", query=f"SELECT * FROM {name}"))
    assert spark.catalog.currentDatabase() == "default"
    assert rows(found) == rows(spark.table(people))


def test_schema_statements():
    made = {vendor: tables.schema_statement(vendor, "s_1") for vendor in ("mssql", "mysql", "postgresql", "sqlite3", "clickhouse")}
    assert made == {"mssql": "use s_1", "mysql": "", "postgresql": "set schema 's_1'", "sqlite3": "", "clickhouse": "use s_1"}
    for bad in ("a-b", "1a", "", "a" * 64, "x; drop table t"):
        with pytest.raises(ValueError, match="invalid identifier"):
            tables.schema_statement("mssql", bad)


def test_schema_and_odd_names(spark, people):
    assert Endpoint("table", schema="a-b", table="my`table").qualified_table() == "`a-b`.`my``table`"
    spark.sql("CREATE DATABASE IF NOT EXISTS side")
    target = Endpoint("table", schema="side", table=new_name(), new_table=True)
    odd = Endpoint("query", query=f"SELECT id AS `a b`, name AS `c.d`, score AS `e``f` FROM {people}")
    copy(spark, odd, target)
    assert spark.table(target.qualified_table()).columns == ["a b", "c.d", "e`f"]
    assert rows(read_endpoint(spark, target)) == rows(spark.table(people))
    copy(spark, odd, Endpoint("table", schema="side", table=target.table))
    assert read_endpoint(spark, target).count() == 6


def test_positional_insert(spark, people):
    target = spark.createDataFrame([], "a bigint, b string, c decimal(5,1)").schema
    moved = tables.insert_positional(spark.table(people), target)
    assert moved.schema.fieldNames() == ["a", "b", "c"] and moved.dtypes[2][1] == "decimal(5,1)"
    with pytest.raises(ValueError, match="3 columns for the 2"):
        tables.insert_positional(spark.table(people), spark.range(1).selectExpr("id", "id b").schema)


def test_align_to_header(spark, people):
    aligned = tables.align_to_header(spark.table(people), ["score", "gone", "id"])
    assert aligned.columns == ["score", "gone", "id"]
    assert rows(aligned.where("gone is null and id = 1")) == [(1.5, None, 1)]


def test_export_names():
    at = datetime(2024, 1, 2, 3, 4, 5)
    assert export_name("jsonTabular", at) == "export_20240102-030405.json"
    assert export_name("csv", at) == "export_20240102-030405.csv"


def test_publish_statements_of_a_database(spark, people):
    target = Endpoint("table", schema="s", table="t", vendor="postgresql", jdbc={"url": "jdbc:x"})
    made = tables.publish_statements(target, spark.table(people).schema, '"s"."stage"', create=True)
    assert made == [
        'CREATE TABLE "s"."t" ("id" INTEGER,"name" TEXT,"score" DOUBLE PRECISION)',
        'INSERT INTO "s"."t" ("id","name","score") SELECT "id","name","score" FROM "s"."stage"',
    ]
    assert len(tables.publish_statements(target, spark.table(people).schema, "x", create=False)) == 1
    with pytest.raises(ValueError, match="unknown database type"):
        tables.publish_statements(Endpoint("table", table="t", vendor="oracle"), spark.table(people).schema, "x", False)


def test_scratch_lies_in_the_shared_folder(spark):
    assert session.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert Path(session.scratch_path(spark, "x")).name.startswith("x-")


def test_csv_with_nulls_into_a_table(spark, tmp_path):
    name = new_name()
    spark.sql(f"CREATE TABLE {name} (a INT, b DOUBLE, t STRING) USING parquet")
    df = spark.createDataFrame([(1, None, "x"), (None, 2.5, None)], "a int, b double, t string")
    file = Endpoint("file", format="csv", path=str(tmp_path / "in"))
    write_endpoint(df, file)
    report = copy(spark, file, Endpoint("table", table=name)).first()
    assert (report.reads, report.writes) == (2, 2)
    assert rows(spark.table(name)) == rows(spark.createDataFrame([(1, None, "x"), (None, 2.5, "")], df.schema))


def test_csv_with_a_schema_into_a_new_table(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (None, "y,\n")], "a int, t string")
    write_endpoint(df, Endpoint("file", format="csv", path=str(tmp_path / "in")))
    target = Endpoint("table", table=new_name(), new_table=True)
    typed = Endpoint("file", format="csv", path=str(tmp_path / "in"), options={"schema": df.schema, "empty_as": "null"})
    copy(spark, typed, target)
    assert spark.table(target.table).schema == df.schema
    assert rows(spark.table(target.table)) == rows(df)


def test_one_column_of_empty_fields(spark, tmp_path):
    df = spark.createDataFrame([("a",), (None,), ("",), ("b",)], "t string")
    out = Endpoint("file", format="csv", path=str(tmp_path / "one"))
    write_endpoint(df, out)
    assert rows(read_endpoint(spark, out)) == [("",), ("",), ("a",), ("b",)]


def test_workbook_modes(spark, tmp_path, people):
    def write(mode, least=0):
        options = {"mode": mode}
        write_endpoint(spark.table(people).where(f"id > {least}"), Endpoint("file", format="xlsx", path=str(tmp_path / "w"), options=options))

    def count():
        return read_endpoint(spark, Endpoint("file", format="xlsx", path=str(tmp_path / "w"))).count()

    write("overwrite")
    assert count() == 3
    write("overwrite", least=1)
    assert count() == 2
    write("ignore")
    assert count() == 2
    write("append", least=2)
    assert count() == 3
    with pytest.raises(FileExistsError):
        write("errorifexists")
    with pytest.raises(ValueError, match="unknown mode"):
        write("replace")


def test_database_queries_take_no_arguments(spark):
    endpoint = Endpoint("query", query="SELECT 1", args={"a": 1}, jdbc={"url": "jdbc:none:x"})
    with pytest.raises(ValueError, match="no arguments"):
        read_endpoint(spark, endpoint)
