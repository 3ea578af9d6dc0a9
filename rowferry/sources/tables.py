"""Tables of Spark's catalog and of databases, and SQL over them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.endpoint import Endpoint
from rowferry.functions.sqltypes import create_table_statement, quoted
from rowferry.functions.statements import is_identifier
from rowferry.functions.texts import quoted_name
from rowferry.plans.session import scratch_path


# How a session's schema is set, where a vendor has that.
SET_SCHEMA = {"mssql": "use {}", "postgresql": "set schema '{}'", "clickhouse": "use {}"}


def read_table(spark: SparkSession, endpoint: Endpoint) -> DataFrame:
    """All rows of a table.

    A database table is read in parallel if the JDBC options name a partition
    column with its bounds; filters and columns are pushed to the database.
    """
    if endpoint.jdbc is None:
        return spark.table(endpoint.qualified_table())
    return _jdbc(spark, endpoint).option("dbtable", _database_name(endpoint)).load()


def read_query(
    spark: SparkSession, query: str, args: Mapping[str, Any] | None = None, schema: str | None = None
) -> DataFrame:
    """The result of a query over registered tables, with named parameters.

    With ``schema`` its unqualified tables are of that schema. Names are bound
    when the query is analysed, so that the session's own schema is set back at
    once.
    """
    current = spark.catalog.currentDatabase()
    if schema is not None:
        spark.catalog.setCurrentDatabase(schema)
    try:
        return spark.sql(query, args=dict(args)) if args else spark.sql(query)
    finally:
        if schema is not None:
            spark.catalog.setCurrentDatabase(current)


def read_database_query(spark: SparkSession, endpoint: Endpoint) -> DataFrame:
    """The result of a query that the database runs, in the schema that the endpoint names.

    It is read in parallel if the JDBC options name a partition column with its
    bounds. The database gets the query as it is, so it takes no arguments.
    """
    if endpoint.args:
        raise ValueError("a query that a database runs takes no arguments")
    reader = _jdbc(spark, endpoint).option("dbtable", f"({endpoint.query}) q")
    statement = schema_statement(endpoint.vendor, endpoint.schema) if endpoint.schema else ""
    return (reader.option("sessionInitStatement", statement) if statement else reader).load()


def schema_statement(vendor: str, schema: str) -> str:
    """What sets the schema of a database session; '' where the vendor has no such thing."""
    if not is_identifier(schema):
        raise ValueError(f"invalid identifier {schema}")
    return SET_SCHEMA.get(vendor, "").format(schema)


def _jdbc(spark: SparkSession, endpoint: Endpoint):
    return spark.read.format("jdbc").options(**endpoint.jdbc)


def _database_name(endpoint: Endpoint) -> str:
    parts = [part for part in (endpoint.schema, endpoint.table) if part]
    return ".".join(quoted(endpoint.vendor, part) for part in parts)


# ---------------------------------------------------------------- columns


def align_to_header(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in that order; missing ones are null, others dropped."""
    return df.select(
        *[(F.col(quoted_name(n)) if n in df.columns else F.lit(None).cast("string")).alias(n) for n in names]
    )


def insert_positional(df: DataFrame, target: T.StructType) -> DataFrame:
    """The columns by position under the target's names and types.

    Another number of columns is an error, as is a value that does not fit.
    """
    if len(df.columns) != len(target):
        raise ValueError(f"{len(df.columns)} columns for the {len(target)} of the target")
    named = df.toDF(*target.fieldNames())
    return named.select(*[F.col(quoted_name(f.name)).cast(f.dataType).alias(f.name) for f in target])


def fit_to_table(df: DataFrame, target: T.StructType, empty_as_null: bool = False) -> DataFrame:
    """The columns by name in the target's order and types; those the source lacks are null.

    With ``empty_as_null``, for files without types, an empty text is null where the target is no text.
    """
    unknown = [n for n in df.columns if n.lower() not in {t.lower() for t in target.fieldNames()}]
    if unknown:
        raise ValueError(f"the target has no column {', '.join(unknown)}")
    own = {field.name.lower(): field for field in df.schema}

    def value(f: T.StructField) -> Column:
        if f.name.lower() not in own:
            return F.lit(None)
        found = own[f.name.lower()]
        column = F.col(quoted_name(found.name))
        texts = isinstance(found.dataType, T.StringType) and not isinstance(f.dataType, T.StringType)
        return F.nullif(column, F.lit("")) if empty_as_null and texts else column

    return df.select(*[value(f).cast(f.dataType).alias(f.name) for f in target])


# ---------------------------------------------------------------- writing


def create_table(df: DataFrame, endpoint: Endpoint) -> None:
    """Load a new table. The catalog knows it only once all its data is there."""
    if endpoint.jdbc is not None:
        _write_database(df, endpoint, create=True)
        return
    writer = df.write.format(endpoint.options.get("using", "parquet")).mode("errorifexists")
    if "path" in endpoint.options:
        writer = writer.option("path", endpoint.options["path"])
    writer.saveAsTable(endpoint.qualified_table())


def append_to_table(df: DataFrame, endpoint: Endpoint) -> None:
    """Add rows to a table; if a task fails for good, none of them becomes visible."""
    if endpoint.jdbc is not None:
        _write_database(df, endpoint, create=False)
        return
    target = df.sparkSession.table(endpoint.qualified_table())
    fit_to_table(df, target.schema).write.insertInto(endpoint.qualified_table())


def append_staged(df: DataFrame, endpoint: Endpoint, expected_rows: int | None = None) -> int:
    """Stage the rows, check their number, then publish them in one insert.

    All that can fail in computing the rows fails while they are staged. Gives
    the number of rows.
    """
    spark = df.sparkSession
    target = spark.table(endpoint.qualified_table())
    folder = scratch_path(spark, "stage")
    fit_to_table(df, target.schema).write.parquet(folder)
    staged = spark.read.schema(target.schema).parquet(folder)
    rows = staged.count()
    if expected_rows is not None and rows != expected_rows:
        raise ValueError(f"{rows} rows staged, {expected_rows} expected")
    staged.write.insertInto(endpoint.qualified_table())
    return rows


def publish_statements(endpoint: Endpoint, schema: T.StructType, stage: str, create: bool) -> list[str]:
    """What moves a staged table into its target.

    A vendor whose transactions hold DDL runs them as one; MySQL and MariaDB
    commit a CREATE TABLE by itself and ClickHouse each statement, so that
    there a failed insert leaves an empty new table, which is dropped.
    """
    target = _database_name(endpoint)
    columns = ",".join(quoted(endpoint.vendor, name) for name in schema.fieldNames())
    insert = f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {stage}"
    return [create_table_statement(endpoint.vendor, target, schema), insert] if create else [insert]


def _run_in_database(spark: SparkSession, jdbc: Mapping[str, str], statements: list[str]) -> None:
    properties = spark._jvm.java.util.Properties()
    for key, value in jdbc.items():
        properties.setProperty(key, str(value))
    if "driver" in jdbc:
        spark._jvm.java.lang.Class.forName(jdbc["driver"])
    connection = spark._jvm.java.sql.DriverManager.getConnection(jdbc["url"], properties)
    try:
        connection.setAutoCommit(False)
        for statement in statements:
            connection.createStatement().executeUpdate(statement)
        connection.commit()
    finally:
        connection.close()


def _write_database(df: DataFrame, endpoint: Endpoint, create: bool) -> None:
    """Stage into a table of the database, then publish in one transaction there.

    Spark's own append commits every partition by itself; the staging table
    takes those commits, and the target sees a single one.
    """
    spark = df.sparkSession
    stage = _database_name(replace(endpoint, table=f"stage_{uuid.uuid4().hex}"))
    _run_in_database(spark, endpoint.jdbc, [create_table_statement(endpoint.vendor, stage, df.schema)])
    written = Observation()
    try:
        counted = df.observe(written, F.count(F.lit(1)).alias("n"))
        counted.write.format("jdbc").options(**endpoint.jdbc).option("dbtable", stage).mode("append").save()
        staged = _jdbc(spark, endpoint).option("dbtable", f"(SELECT count(*) AS n FROM {stage}) q").load().first()[0]
        if int(staged) != written.get["n"]:  # a task that ran twice loads its rows twice
            raise ValueError(f"{staged} rows staged, {written.get['n']} written")
        try:
            _run_in_database(spark, endpoint.jdbc, publish_statements(endpoint, df.schema, stage, create))
        except Exception:
            if create:
                _run_in_database(spark, endpoint.jdbc, [f"DROP TABLE IF EXISTS {_database_name(endpoint)}"])
            raise
    finally:
        _run_in_database(spark, endpoint.jdbc, [f"DROP TABLE {stage}"])
