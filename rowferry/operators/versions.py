"""Changes to a whole catalog table: a new version of its files, published by one change of its location."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from rowferry.sources.tables import fit_to_table


class TableBusy(RuntimeError):
    """Another writer holds the table."""


class TableMoved(RuntimeError):
    """The table changed while a new version of it was computed."""


class _Place(NamedTuple):
    """Where the files of a table lie, in which format."""

    location: str
    provider: str


class _Seen(NamedTuple):
    """What shows that nobody wrote to a version's folder."""

    location: str
    files: int
    size: int


def _place(spark: SparkSession, table: str) -> _Place:
    told = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").collect()  # a row per column and property
    names = [row["col_name"] for row in told]
    if "# Partition Information" in names:
        raise ValueError(f"{table} is partitioned: its partitions have locations of their own")
    found = {row["col_name"]: row["data_type"] for row in told[names.index("# Detailed Table Information") :]}
    if found.get("Provider", "hive").lower() == "hive":
        raise ValueError(f"{table} is no table of a Spark format")
    return _Place(found["Location"].rstrip("/"), found["Provider"])


def location_of(spark: SparkSession, table: str) -> str:
    """The folder of a table's present version."""
    return _place(spark, table).location


def files_at(spark: SparkSession, path: str):
    """A path's file system, and the path as that takes it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _seen(spark: SparkSession, location: str) -> _Seen:
    files, at = files_at(spark, location)
    told = files.getContentSummary(at)
    return _Seen(location, told.getFileCount(), told.getLength())


@contextmanager
def exclusive(spark: SparkSession, table: str) -> Iterator[str]:
    """Hold a table against other writers of this library; gives its location.

    A file beside the location is created, which fails if it is there. A driver
    that is lost leaves it behind; the error names it, so that it can be removed.
    """
    location = _place(spark, table).location
    files, lock = files_at(spark, f"{location}.lock")
    try:
        files.create(lock, False).close()
    except Py4JJavaError as error:
        if files.exists(lock):
            raise TableBusy(f"{table} is being changed by another writer, who holds {lock.toString()}") from error
        raise
    try:
        if _place(spark, table).location != location:
            raise TableMoved(f"{table} has a new version")
        yield location
    finally:
        files.delete(lock, False)


def change_table(spark: SparkSession, table: str, change: Callable[[DataFrame], DataFrame]) -> str:
    """Replace the rows of a catalog table by what ``change`` makes of them; the location of the new version.

    The rows go to a new folder beside the present one. Once all are there and
    the present folder is as it was, the table's location moves, which readers
    see as one change; running queries go on with the old files. A failing task,
    a second writer or rows added meanwhile leave the old version, and the new
    folder is removed. Old versions stay until ``drop_version``.
    """
    with exclusive(spark, table) as location:
        before = _seen(spark, location)
        spark.catalog.refreshTable(table)
        target = spark.table(table)
        parent, _, name = location.rpartition("/")
        fresh = f"{parent if name.startswith('version-') else location + '-versions'}/version-{uuid.uuid4().hex}"
        try:
            rows = fit_to_table(change(target), target.schema)
            rows.write.format(_place(spark, table).provider).mode("errorifexists").save(fresh)
            if _seen(spark, location) != before or _place(spark, table).location != location:
                raise TableMoved(f"rows were added to {table} while its new version was computed")
        except BaseException:
            drop_version(spark, fresh)
            raise
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{fresh}'")
        spark.catalog.refreshTable(table)
    return fresh


def drop_version(spark: SparkSession, location: str) -> None:
    """Remove the files of a version that no query reads any more."""
    files, at = files_at(spark, location)
    files.delete(at, True)
