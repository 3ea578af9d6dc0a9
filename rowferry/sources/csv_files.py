"""Folders of delimited files: a header line, commas, doubled quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.texts import field_column, flat_text
from rowferry.plans.session import ship_package
from rowferry.sources.csv_splits import find_breaks, read_split_records

_QUOTED_EMPTY = '""'


def read_csv(
    spark: SparkSession,
    path: str,
    empty_as: str = "empty",
    multiline: bool | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Every column as text under the names of the header, or with ``schema`` under its names and types.

    A record with too few or too many fields, or a file whose header differs,
    fails the query. An empty field is '' or, with ``empty_as="null"``, null; in
    a column that ``schema`` makes no text it is null, and a value that does not
    fit the type fails. A blank line is no record, but a line of ``""`` is one,
    with one empty field.

    By default a first scan counts quotes, and fields with line breaks are read
    in parallel splits as all others are; a quote within a field that is not
    quoted then fails if its line has an odd number of quotes. ``multiline=False``
    leaves the scan out where no field holds a line break, and with
    ``multiline=True`` each file is one task, without a scan.
    """
    if empty_as not in ("empty", "null"):
        raise ValueError(f"empty_as must be 'empty' or 'null', not {empty_as!r}")
    breaks = find_breaks(spark, path) if multiline is None else None
    broken = breaks.broken if breaks else multiline
    fields = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df = spark.read.options(header=True, inferSchema=False, enforceSchema=False, multiLine=broken, mode="FAILFAST", **fields).csv(path)
    if breaks and broken and df.columns:
        ship_package(spark)
        df = read_split_records(spark, path, breaks.crossed, df.columns, fields)
    if schema is None:
        return df.na.fill("") if empty_as == "empty" else df.select(*[F.nullif(field_column(f), F.lit("")).alias(f.name) for f in df.schema])
    if len(schema) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns in the files, {len(schema)} in the schema")

    def typed(own: T.StructField, wanted: T.StructField) -> Column:
        text = field_column(own)
        if isinstance(wanted.dataType, (T.StringType, T.CharType, T.VarcharType)) and empty_as == "empty":
            return F.coalesce(text, F.lit("")).alias(wanted.name)
        return F.nullif(text, F.lit("")).cast(wanted.dataType).alias(wanted.name)

    return df.select(*[typed(own, wanted) for own, wanted in zip(df.schema, schema)])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Part files with a header each; null and '' both become an empty field.

    The only field of a row is written as ``""`` when it is empty, as a blank line would be no record.
    """
    empty = _QUOTED_EMPTY if len(df.columns) == 1 else ""
    texts = df.select(*[flat_text(field_column(f), f.dataType).alias(f.name) for f in df.schema])
    if empty:
        texts = texts.na.fill("")
    texts.write.mode(mode).options(
        header=True,
        escape='"',
        emptyValue=empty,
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)
