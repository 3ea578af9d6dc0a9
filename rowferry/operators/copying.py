"""Copies between tables, queries and files, with counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowferry.endpoint import Endpoint
from rowferry.sources import csv_files, json_files, json_tabular, tables, workbooks

READERS = {
    "csv": csv_files.read_csv,
    "json": json_files.read_json,
    "jsonTabular": json_tabular.read_json_tabular,
    "xlsx": workbooks.read_workbooks,
}
WRITERS = {
    "csv": csv_files.write_csv,
    "json": json_files.write_json,
    "jsonTabular": json_tabular.write_json_tabular,
    "xlsx": workbooks.write_workbooks,
}

# Formats whose files say nothing of types, and the options that bring types in.
_UNTYPED = ("csv", "json", "xlsx")


def read_endpoint(spark: SparkSession, endpoint: Endpoint) -> DataFrame:
    """The rows that an origin names."""
    if endpoint.type == "table":
        return tables.read_table(spark, endpoint)
    if endpoint.type == "query":
        if endpoint.jdbc is not None:
            return tables.read_database_query(spark, endpoint)
        return tables.read_query(spark, endpoint.query, endpoint.args, endpoint.schema)
    if endpoint.type == "file" and endpoint.format in READERS:
        options = {key: value for key, value in endpoint.options.items() if key != "infer"}
        return READERS[endpoint.format](spark, endpoint.path, **options)
    raise ValueError(f"unsupported reader. type: {endpoint.type}, format: {endpoint.format}")


def spread(df: DataFrame, endpoint: Endpoint) -> DataFrame:
    """The rows in as many partitions, and so files, as the destination asks for."""
    partitions = endpoint.options.get("partitions")
    return df.repartition(partitions) if partitions else df


def well_split(df: DataFrame) -> bool:
    """Whether a table's scan gives no task more than twice a core's share of its rows.

    Then a shuffle before a copy costs its bytes and gains nothing. A pass that
    reads no column counts the rows of each partition.
    """
    counts = df.groupBy(F.spark_partition_id()).count().agg(F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    return counts.rows is not None and counts.most * df.sparkSession.sparkContext.defaultParallelism <= 2 * counts.rows


def write_endpoint(df: DataFrame, endpoint: Endpoint) -> None:
    """Write rows to a destination."""
    _write(spread(df, endpoint), endpoint)


def _write(df: DataFrame, endpoint: Endpoint) -> None:
    if endpoint.type == "table":
        if endpoint.new_table:
            tables.create_table(df, endpoint)
        else:
            tables.append_to_table(df, endpoint)
    elif endpoint.type == "file" and endpoint.format in WRITERS:
        options = {key: value for key, value in endpoint.options.items() if key != "partitions"}
        WRITERS[endpoint.format](df, endpoint.path, **options)
    else:
        raise ValueError(f"unsupported writer. type: {endpoint.type}, format: {endpoint.format}")


def has_types(endpoint: Endpoint) -> bool:
    """Whether an origin gives its columns types that a new table can take."""
    if endpoint.type != "file" or endpoint.format not in _UNTYPED:
        return True
    return bool(endpoint.options.get("infer") or endpoint.options.get("schema"))


def copy(spark: SparkSession, origin: Endpoint, destination: Endpoint) -> DataFrame:
    """Copy all rows, in one pass; give one row with the numbers read and written.

    The counts are taken by the tasks that write. Any shuffle comes before, so
    that a map task that runs again after a loss counts nothing twice. If a task
    fails for good, nothing shows at the destination.
    """
    if destination.type == "table" and destination.new_table and not has_types(origin):
        raise ValueError("columns and types mismatch or empty")
    rows = spread(read_endpoint(spark, origin), destination)
    reads, writes = Observation(), Observation()
    rows = rows.observe(reads, F.count(F.lit(1)).alias("n"))
    if destination.type == "table" and not destination.new_table and destination.jdbc is None:
        target = spark.table(destination.qualified_table()).schema
        rows = tables.fit_to_table(rows, target, empty_as_null=not has_types(origin))
    rows = rows.observe(writes, F.count(F.lit(1)).alias("n"))
    _write(rows, destination)
    return report(spark, reads.get["n"], writes.get["n"])


def report(spark: SparkSession, reads: int, writes: int) -> DataFrame:
    """A copy's counts as a one-row table."""
    return spark.range(0, 1, 1, 1).select(
        F.lit(reads).cast("long").alias("reads"), F.lit(writes).cast("long").alias("writes")
    )


def export_name(file_format: str, at: datetime) -> str:
    """The name of an export, from its time and the first four letters of its format."""
    return f"export_{at:%Y%m%d-%H%M%S}.{file_format[:4]}"
