"""Options under their groups, and texts put together from ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.sqltypes import quote_identifier
from rowferry.operators.numbering import number_rows


def group_options(
    df: DataFrame, group: str, value: str, label: str, order: str, ranges: int | None = None
) -> DataFrame:
    """Options in their order within their group; null and '' are the group ''.

    Every option keeps a row of its own, with its group, the group's first
    place in the order, and the option's place in the group, so that a group of
    any size stays spread over tasks.
    """
    options = df.select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("group"),
        F.col(order).alias("source_order"),
        F.col(value).alias("value"),
        F.col(label).alias("label"),
    )
    numbered = number_rows(options, ["source_order"], ["group"], "place", ranges, least="group_order")
    return numbered.select("group", "group_order", "place", "value", "label")


def concat_lines(df: DataFrame, key: list[str], order: str, text: str, separator: str = "") -> DataFrame:
    """The lines of each key as one text, in order; a null line counts as empty.

    ``order`` numbers the lines of a key, from any number on. A text is one
    value of one row, so it is bounded by what Spark lets a value hold (2 GB).
    """
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), F.coalesce(text, F.lit("")).alias("t"))))
    return (
        df.groupBy(*key)
        .agg(lines.alias("lines"))
        .select(*key, F.array_join(F.transform("lines", lambda line: line.t), separator).alias("text"))
    )


def definition_text(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """The definition in a dictionary's reply: several lines, or the ``create...`` column of one row.

    A reply of one column gives its lines joined. One of several columns gives
    the first whose name starts with ``create``, else the first, from its first
    row.
    """
    if len(columns) == 1:
        return concat_lines(df, key, order, columns[0])
    chosen = next((name for name in columns if name.lower().startswith("create")), columns[0])
    single = F.count(F.lit(1)) == 1
    shown = F.when(single, F.min_by(chosen, order)).otherwise(F.min_by(columns[0], order))
    first = F.min_by(columns[0], order)
    return df.groupBy(*key).agg(F.coalesce(F.when(shown != "", shown), first).alias("text"))


def create_table_ddl(
    columns: DataFrame,
    key: list[str],
    order: str,
    table: Column,
    column_name: Column,
    column_type: Column,
    vendor: Column | str,
) -> DataFrame:
    """``CREATE TABLE`` statements from a table of columns, one a key."""
    prepared = columns.select(
        *key,
        F.col(order).alias("__order"),
        quote_identifier(vendor, table).alias("__table"),
        F.concat(quote_identifier(vendor, column_name), F.lit(" "), column_type).alias("__column"),
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col("__order").alias("n"), F.col("__column").alias("t"))))
    listed = F.array_join(F.transform("entries", lambda entry: entry.t), ",")
    return (
        prepared.groupBy(*key)
        .agg(F.min("__table").alias("__table"), entries.alias("entries"))
        .select(*key, F.concat(F.lit("CREATE TABLE "), F.col("__table"), F.lit(" ("), listed, F.lit(")")).alias("text"))
    )
