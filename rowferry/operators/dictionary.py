"""A data dictionary held as a table of columns.

The table has ``table_schema, table_name, table_type, ordinal, column_name,
data_type, max_length, nullable, default_value``; it may be the extract of many
servers' information schemas, and everything here runs on it as on any table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.texts import quoted_name

COLUMNS = T.StructType(
    [
        T.StructField("table_schema", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("table_type", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("nullable", T.StringType()),
        T.StructField("default_value", T.StringType()),
    ]
)


def order_by_ordinal(df: DataFrame, *ordinals: int) -> DataFrame:
    """Sort by columns counted from 1."""
    return df.orderBy(*[F.col(df.columns[i - 1]) for i in ordinals])


def dict_schemas(columns: DataFrame) -> DataFrame:
    """The schemas but the system's own, sorted."""
    names = columns.where(~F.col("table_schema").startswith("pg_")).select("table_schema").distinct()
    return order_by_ordinal(names, 1)


def distinct_lower(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column in lower case, sorted."""
    return order_by_ordinal(df.select(F.lower(column).alias(column)).distinct(), 1)


def _objects(columns: DataFrame, table_type: str, schema: str | None) -> DataFrame:
    chosen = columns.where(F.col("table_type") == table_type)
    if schema is not None:
        return order_by_ordinal(chosen.where(F.col("table_schema") == schema).select("table_name").distinct(), 1)
    return order_by_ordinal(chosen.select("table_schema", "table_name").distinct(), 1, 2)


def dict_tables(columns: DataFrame, schema: str | None = None) -> DataFrame:
    """The tables of one schema, or of all, sorted."""
    return _objects(columns, "BASE TABLE", schema)


def dict_views(columns: DataFrame, schema: str | None = None) -> DataFrame:
    """The views of one schema, or of all, sorted."""
    return _objects(columns, "VIEW", schema)


def dict_columns(
    columns: DataFrame, keys: DataFrame, schema: str | None = None, table: str | None = None
) -> DataFrame:
    """Columns in their order, with whether each belongs to its table's primary key.

    ``keys`` names the key columns by schema, table and column. The join is on
    all three, so that the columns of a wide table spread over tasks.
    """
    on = ["table_schema", "table_name", "column_name"]
    if schema is not None:
        columns, keys = (t.where(F.col("table_schema") == schema) for t in (columns, keys))
    if table is not None:
        columns, keys = (t.where(F.col("table_name") == table) for t in (columns, keys))
    flagged = keys.select(*on).distinct().withColumn("__key", F.lit(True))
    return (
        columns.join(flagged, on, "left")
        .select(
            "table_schema",
            "table_name",
            "ordinal",
            "column_name",
            "data_type",
            "max_length",
            "nullable",
            "default_value",
            F.when(F.col("__key").isNotNull(), F.lit("YES")).otherwise(F.lit("NO")).alias("is_primary_key"),
        )
        .orderBy("table_schema", "table_name", "ordinal")
    )


def dict_from_spark(spark: SparkSession, database: str | None = None) -> DataFrame:
    """The columns table of a database in Spark's catalog, and of the session's views.

    It reads names and types from the catalog and touches no data.
    """
    rows = []
    for table in spark.catalog.listTables(database):
        name = ".".join(quoted_name(part) for part in [*(table.namespace or []), table.name])
        kind = "VIEW" if table.tableType in ("VIEW", "TEMPORARY") else "BASE TABLE"
        schema = ".".join(table.namespace or [])
        for ordinal, column in enumerate(spark.catalog.listColumns(name), start=1):
            nullable = "YES" if column.nullable else "NO"
            rows.append((schema, table.name, kind, ordinal, column.name, column.dataType, None, nullable, None))
    return spark.createDataFrame(rows, COLUMNS)
