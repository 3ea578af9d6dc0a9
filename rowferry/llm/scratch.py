"""Intermediate tables in the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.plans.session import scratch_path

#: Drops the shuffle files of a query once it has ended; they would otherwise stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch sent to a Python task: buffers of it lie outside the executor's heap, and rows may be blobs.
_BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


#: A group with more than one in so many of all rows is joined by a broadcast.
HOT_SHARE = 1_000


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for a while."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stored(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows as a table in the shared folder, and its path; an executor that is lost takes none of them along."""
    path = scratch_path(spark, label)
    with settings(spark, {_CLEANUP: "true", **_BATCH_BYTES}):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove tables that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def joined_by_size(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Each row with its group; groups has a row per key and ``size``, the number of its rows of ``total`` at most.

    A group with more than one in HOT_SHARE of the rows is broadcast, and its rows are not shuffled: there are
    fewer than HOT_SHARE of those. Rows without a group are left out.
    """
    hot = F.col("size") > total // HOT_SHARE + 1
    few = F.broadcast(groups.where(hot))
    others = rows.join(few.select(*keys), keys, "left_anti").join(groups.where(~hot), keys)
    return others.unionByName(rows.join(few, keys)).drop("size")


def free_name(stem: str, taken: list[str]) -> str:
    """A column name that none of the given ones equals, however it is written."""
    lowered = {name.lower() for name in taken}
    while stem.lower() in lowered:
        stem += "_"
    return stem
