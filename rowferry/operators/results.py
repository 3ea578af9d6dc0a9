"""Bounded results, paging, header samples and column widths."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.statements import clean_statement, statement_command, statement_type
from rowferry.functions.texts import cell_text, field_column, json_value, quoted_name, shown_length
from rowferry.operators.numbering import number_rows
from rowferry.operators.pages import STRETCH, build_index
from rowferry.sources import tables

# The default cap of a result, the rows of a page, the sample's rows and the widths' measures.
DEFAULT_CAP = 500
PAGE_SIZE = 15
SAMPLE_ROWS = 10
CHAR_WIDTH = 6.5
CELL_PADDING = 12.0

_NESTED = (T.ArrayType, T.MapType, T.StructType)


# ---------------------------------------------------------------- bounded results


@dataclass(frozen=True)
class BoundedResult:
    """At most ``cap`` rows of a result.

    ``flagged`` holds the rows with a column ``truncated``; ``envelope`` is one
    row with the columns' names and types, the number of rows returned, the
    flag, the rows a statement wrote (null for a query or where Spark does not
    count them), and the kind of statement. A query runs when one of these
    tables is used; a statement that writes has run by then, once.
    """

    rows: DataFrame
    flagged: DataFrame
    cap: int
    statement: str = ""
    vendor: str = ""
    rows_affected: int | None = None

    def envelope(self) -> DataFrame:
        cleaned = clean_statement(F.lit(self.statement))
        fields = self.rows.schema.fields
        counted = self.flagged.agg(
            F.count(F.lit(1)).alias("rows_returned"),
            F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"),
        )
        return counted.select(
            F.array(*[F.lit(f.name) for f in fields]).alias("cols"),
            F.array(*[F.lit(f.dataType.simpleString()) for f in fields]).alias("column_types"),
            "rows_returned",
            "truncated",
            F.lit(self.rows_affected).cast("long").alias("rows_affected"),
            statement_command(cleaned).alias("stmt_cmd"),
            statement_type(cleaned, self.vendor).alias("stmt_type"),
        )


def bounded(df: DataFrame, cap: int = DEFAULT_CAP, statement: str = "", vendor: str = "") -> BoundedResult:
    """The first ``cap`` rows and whether there were more; zero or less is no cap.

    One row more than the cap is asked for, in the same job, so that each task
    stops early and a sorted result is a top-k.
    """
    if cap <= 0:
        return BoundedResult(df, df.withColumn("truncated", F.lit(False)), cap, statement, vendor)
    fetched = df.limit(cap + 1).withColumn("__place", F.monotonically_increasing_id())
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flagged = (
        fetched.withColumn("truncated", F.count(F.lit(1)).over(everything) > cap)
        .where(F.col("__place") < cap)
        .drop("__place")
    )
    return BoundedResult(flagged.drop("truncated"), flagged, cap, statement, vendor)


def run_sql(
    spark: SparkSession,
    sql: str,
    cap: int = DEFAULT_CAP,
    args: Mapping[str, Any] | None = None,
    schema: str | None = None,
    vendor: str = "",
) -> BoundedResult:
    """Run SQL over the registered tables, of ``schema`` where they name none, and bound its result."""
    df = tables.read_query(spark, sql, args, schema)
    return replace(bounded(df, cap, sql, vendor), rows_affected=rows_written(df))


def rows_written(df: DataFrame) -> int | None:
    """The rows that the statement behind a result wrote; None for a query."""
    ran = df._jdf.queryExecution().commandExecuted()
    if ran.getClass().getSimpleName() != "CommandResult":
        return None
    written = ran.commandPhysicalPlan().metrics().get("numOutputRows")
    return written.get().value() if written.isDefined() else None


# ---------------------------------------------------------------- paging


def page_count(rows: Column, size: int = PAGE_SIZE) -> Column:
    return F.ceil(rows / F.lit(size))


def page(df: DataFrame, order_by: list[str], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page, counted from 0, of a table in an order whose columns are unique together.

    An early page is a top-k. For a late one an index of the order is built
    from its columns; ``pages.table_index`` keeps that for further pages.
    """
    if (number + 1) * size <= STRETCH:
        return df.orderBy(*[F.col(quoted_name(name)) for name in order_by]).offset(number * size).limit(size)
    return build_index(df, order_by).page(df, number, size)


def page_index(df: DataFrame, order_by: list[str], size: int = PAGE_SIZE, ranges: int | None = None) -> DataFrame:
    """Every row with its page, counted from 0, and its place on the page, from 1."""
    numbered = number_rows(df, order_by, name="__number", ranges=ranges)
    place = F.col("__number") - 1
    return numbered.select(
        *[field_column(f) for f in df.schema],
        F.floor(place / F.lit(size)).alias("page"),
        (place % size + 1).alias("place"),
    )


# ---------------------------------------------------------------- samples and widths


def header_sample(df: DataFrame, order_by: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows as cells, then the column names as one more row, numbered by ``place``."""
    first = df.orderBy(*order_by).limit(rows).withColumn("place", F.monotonically_increasing_id() + 1)
    cells = [cell_text(field_column(f), f.dataType).alias(f.name) for f in df.schema]
    names = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(rows + 1).cast("long").alias("place"), *[F.lit(f.name).alias(f.name) for f in df.schema]
    )
    return first.select("place", *cells).unionByName(names)


def _longest(field: T.StructField) -> Column:
    """The aggregate of a column that gives its longest shown text."""
    column, kind = field_column(field), field.dataType
    if isinstance(kind, (T.IntegralType, T.DecimalType)):
        # Of whole numbers, or ones of the same scale, the least or the greatest is longest.
        ends = [F.length(end(column).cast("string")) for end in (F.min, F.max)]
        return F.greatest(*ends, F.when(F.count_if(column.isNull()) > 0, F.lit(4)))
    text = json_value(column, kind) if isinstance(kind, _NESTED) else cell_text(column, kind)
    length = shown_length(text) if isinstance(kind, (T.StringType, *_NESTED)) else F.length(text)
    return F.max(F.when(column.isNull(), F.lit(4)).otherwise(length))


def display_profile(df: DataFrame) -> DataFrame:
    """The longest shown text of every column, its name included: one row a column.

    One pass with one aggregate a column, and no row leaves its task unless
    aggregated.
    """
    fields = df.schema.fields
    longest = df.agg(*[F.greatest(F.lit(2), _longest(f)).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.greatest(
                    F.coalesce(F.col(f"c{i}"), F.lit(2)), F.lit(max(2, len(f.name.encode("utf-16-be")) // 2))
                ).alias("max_length"),
            )
            for i, f in enumerate(fields)
        ]
    )
    return longest.select(F.inline(rows))


def with_widths(
    profile: DataFrame, available: float, char_width: float = CHAR_WIDTH, padding: float = CELL_PADDING
) -> DataFrame:
    """A display profile with the whole width that each column gets of the available one.

    With the columns by rising need, those up to the first that needs more than
    an even share of what is left get what they need. The others divide the
    rest evenly, the later ones taking the units that do not divide. If all get
    what they need, each is widened alike, by a fifth of their sum at most.

    The windows are over the profile, which has one row a column of the table.
    """
    need = F.col("max_length") * F.lit(char_width) + F.lit(padding)
    all_rows = Window.partitionBy(F.lit(0))
    rising = all_rows.orderBy("need", "position")
    earlier = F.coalesce(F.sum("need").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    waiting = F.count("*").over(all_rows) - F.row_number().over(rising) + 1
    sized = profile.withColumn("need", need).withColumn("alone", F.col("need") <= F.floor((F.lit(available) - earlier) / waiting))
    sized = sized.withColumn("fits", F.bool_and("alone").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(available) - F.coalesce(F.sum(F.when(F.col("fits"), F.col("need"))).over(all_rows), F.lit(0.0))
    sized = sized.select(
        "*", left.alias("left"), F.count("*").over(all_rows).alias("n"), F.count_if(~F.col("fits")).over(all_rows).alias("shared_by"),
        F.row_number().over(Window.partitionBy("fits").orderBy("position")).alias("turn"),
    )
    units = F.floor("left")
    even = F.floor(units / F.col("shared_by")) + (F.col("turn") > F.col("shared_by") - F.pmod(units, F.col("shared_by"))).cast("int")
    spare = F.when(
        (F.col("shared_by") == 0) & (F.col("left") > F.col("n")),
        F.floor(F.least("left", (F.lit(available) - F.col("left")) * 0.2) / F.col("n")),
    ).otherwise(0)
    width = F.when(F.col("fits"), F.floor(F.col("need") + spare)).otherwise(even)
    return sized.select(*profile.columns, width.cast("int").alias("width"))
