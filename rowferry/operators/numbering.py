"""Row numbers over a whole table without bringing it to one task.

A window without a partition column sorts the entire table in one task, and a
window over a hot group does so with that group. Here Spark deals the rows out
by ranges of the order, sorts each range and writes it once, each row with its
range and its place there. A row's number is that place plus the rows of all
ranges before, a small table of one row a range. A hot group lies in several
ranges like any other stretch of the order.

As ranges and places are written with the rows, a task that is run again later
finds them as they were. Columns must be of types that Parquet holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.functions.texts import quoted_name
from rowferry.plans.session import scratch_path

RANGE, PLACE, BEFORE = "__range", "__place", "__before"


def columns_of(names: list[str]) -> list[Column]:
    return [F.col(quoted_name(name)) for name in names]


def _written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder, whose size Spark knows when it plans a join."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_ranges(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with their range of the order and their place in it, from 0.

    There are as many ranges as given, else as Spark makes: those of its setting
    for shuffles, small neighbours put together.
    """
    columns = columns_of(keys)
    dealt = df.repartitionByRange(ranges, *columns) if ranges else df.repartitionByRange(*columns)
    # The lower 33 bits count a task's rows.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return _written(dealt.sortWithinPartitions(*columns).withColumns({RANGE: F.spark_partition_id(), PLACE: place}), "ranges")


def with_rows_before(placed: DataFrame) -> DataFrame:
    """Add the rows of all ranges before a row's own.

    The counts are a row of a few bytes a range, which a shuffle of megabytes
    stands behind: so they join as a broadcast.
    """
    counts = placed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(F.broadcast(counts.select(RANGE, F.coalesce(earlier, F.lit(0)).alias(BEFORE))), RANGE)


def number_rows(
    df: DataFrame,
    order_by: list[str],
    group_by: list[str] | None = None,
    name: str = "row_number",
    ranges: int | None = None,
    least: str | None = None,
) -> DataFrame:
    """Number the rows from 1 in an order, over all rows or within each group.

    The group and order columns together must be unique. ``least`` names one
    more column: the least value of the first order column in the row's group.
    The rows are shuffled and written once; the rest reads that.
    """
    group_by = group_by or []
    placed = write_ranges(df, [*group_by, *order_by], ranges)
    if not group_by:
        return with_rows_before(placed).withColumn(name, F.col(PLACE) + F.col(BEFORE) + 1).drop(RANGE, PLACE, BEFORE)
    # A row for each group and range that it lies in: a group has as many as ranges, at most.
    groups = {f"__group{i}": column for i, column in enumerate(columns_of(group_by))}
    heads = placed.groupBy(F.col(RANGE).alias("__in"), *[column.alias(key) for key, column in groups.items()]).agg(
        F.min(PLACE).alias("__first"), F.count(F.lit(1)).alias("n"), F.min(*columns_of(order_by[:1])).alias("__least")
    )
    whole = Window.partitionBy(*groups)
    earlier = F.sum("n").over(whole.orderBy("__in").rowsBetween(Window.unboundedPreceding, -1))
    # What a place has to have added: 1, and the group's rows in earlier ranges, less the place of its first row in this one.
    shift = F.coalesce(earlier, F.lit(0)) - F.col("__first") + 1
    heads = _written(heads.select("__in", *groups, shift.alias("__shift"), F.min("__least").over(whole).alias("__least")), "group-starts")
    same = F.col(RANGE) == F.col("__in")
    for key, column in groups.items():
        same = same & column.eqNullSafe(F.col(key))
    found = placed.join(heads, same).withColumn(name, F.col(PLACE) + F.col("__shift"))
    if least:
        found = found.withColumn(least, F.col("__least"))
    return found.drop(RANGE, PLACE, "__in", "__shift", "__least", *groups)
