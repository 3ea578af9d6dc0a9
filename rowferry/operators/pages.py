"""Pages of a table by a stored index of its order.

The index has a row for each stretch of the order: the key that it begins
with, and the rows before it. It is built once for a version of a table. A
page is then one lookup, whose bounds the index's scan skips by, and one read
of the table between two keys.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.texts import quoted_name
from rowferry.operators.numbering import BEFORE, PLACE, columns_of, number_rows, with_rows_before, write_ranges
from rowferry.operators.versions import files_at, location_of
from rowferry.plans.session import scratch_path, shared_folder

#: Rows of a stretch at most, which one top-k may hold.
STRETCH = 5_000

# Without these, times are written to the millisecond.
_EXACT = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _struct(names: list[str]) -> Column:
    return F.struct(*[column.alias(name) for column, name in zip(columns_of(names), names, strict=True)])


@dataclass(frozen=True)
class PageIndex:
    """Where the index of an order lies: rows_before, and key as a JSON text, which a plan carries as one constant."""

    path: str
    order_by: list[str]
    stretch: int

    def _bounds(self, spark: SparkSession, start: int, end: int) -> T.Row:
        """The last stretch that begins at or before one place, and the first that does so at or after another."""
        rows, key = F.col("rows_before"), F.col("key")
        index = spark.read.schema("rows_before long, key string").parquet(self.path)
        near = index.where(rows.between(start - self.stretch, start) | rows.between(end, end + self.stretch))
        return near.agg(
            F.max(F.when(rows <= start, rows)).alias("before"),
            F.max_by(key, F.when(rows <= start, rows)).alias("low"),
            F.min_by(key, F.when(rows >= end, rows)).alias("high"),
        ).first()

    def page(self, df: DataFrame, number: int, size: int) -> DataFrame:
        """One page, counted from 0, of the table that the index was built from."""
        start, columns = number * size, columns_of(self.order_by)
        found = self._bounds(df.sparkSession, start, start + size)
        if found.before is None:  # beyond the last row
            return df.limit(0)
        schema = T.StructType([T.StructField(name, df.schema[name].dataType) for name in self.order_by])
        low, high = (None if text is None else F.from_json(F.lit(text), schema, _EXACT) for text in (found.low, found.high))
        # Bounds on the leading column alone reach the scan; nulls sort first.
        leading, first = columns[0], self.order_by[0]
        near = df.where(low[first].isNull() | (leading >= low[first])).where(low <= _struct(self.order_by))
        if high is not None:
            near = near.where(leading.isNull() | (leading <= high[first])).where(_struct(self.order_by) < high)
        if size <= self.stretch:
            return near.orderBy(*columns).offset(start - found.before).limit(size)
        numbered = number_rows(near, self.order_by, name="__number")
        place = F.col("__number") + found.before
        return numbered.where(place.between(start + 1, start + size)).drop("__number").orderBy(*columns)


def build_index(
    df: DataFrame, order_by: list[str], path: str | None = None, stretch: int = STRETCH, ranges: int | None = None
) -> PageIndex:
    """Write the index of an order whose columns are unique together. Only these columns are read."""
    path = path or scratch_path(df.sparkSession, "page-index")
    placed = with_rows_before(write_ranges(df.select(*columns_of(order_by)), order_by, ranges))
    begins = placed.where(F.col(PLACE) % stretch == 0)
    index = begins.select((F.col(PLACE) + F.col(BEFORE)).alias("rows_before"), F.to_json(_struct(order_by), _EXACT).alias("key"))
    # Neighbours together, so that a lookup skips all other files and blocks.
    index.repartitionByRange("rows_before").sortWithinPartitions("rows_before").write.parquet(path)
    return PageIndex(path, order_by, stretch)


def table_index(spark: SparkSession, table: str, order_by: list[str], stretch: int = STRETCH) -> PageIndex:
    """The stored index of a catalog table's present files; built if there is none yet.

    Its name tells the files' names, which writers never give twice, and their
    whole size. It is moved to that name when it is complete; of two sessions
    that build it at once, one finds the other's.
    """
    spark.catalog.refreshTable(table)
    files, at = files_at(spark, location_of(spark, table))
    names = sorted(spark.table(table).inputFiles())
    told = repr((names, files.getContentSummary(at).getLength(), order_by, stretch))
    path = f"{shared_folder(spark)}/page-index-{hashlib.sha256(told.encode()).hexdigest()}"
    files, at = files_at(spark, path)
    if not files.exists(at):
        built = build_index(spark.table(table), order_by, stretch=stretch)
        _, made = files_at(spark, built.path)
        # A folder that is already there takes no second one, or takes it inside, where no reader of its files looks.
        if files.exists(at) or not files.rename(made, at):
            return built
    return PageIndex(path, order_by, stretch)


def page_of_table(spark: SparkSession, table: str, order_by: list[str], number: int, size: int) -> DataFrame:
    """One page of a catalog table by its stored index."""
    return table_index(spark, table, order_by).page(spark.table(table), number, size)
