"""Folders of line-delimited JSON objects."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.texts import field_column, json_ready

# Types that JSON carries as text.
_AS_TEXT = (T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


# What becomes of keys and cells that the header does not name.
EXTRA = ("drop", "fail", "widen")
# Other keys that become columns, and that an error names, at most.
WIDEST, NAMED = 10_000, 20


def first_file(spark: SparkSession, path: str, pattern: str | None = None) -> str:
    """The first file of a folder by name. Only the listing is read."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    first = reader.load(path).where("length > 0").agg(F.min("path")).first()[0]
    if first is None:
        raise ValueError(f"no data in {path}")
    return first


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The keys of the first object of the first file, in their order."""
    lines = spark.read.text(first_file(spark, path)).where(F.trim("value") != "")
    line = lines.first()
    pairs = json.loads(line[0], object_pairs_hook=lambda items: items) if line else None
    if not isinstance(pairs, list) or not line[0].lstrip().startswith("{"):
        raise ValueError("expected JSON object")
    return list(dict.fromkeys(key for key, _ in pairs))


def from_text(value: str | F.Column, data_type: T.DataType):
    """A column read as text, as the type that JSON carries that way."""
    return F.unbase64(value) if isinstance(data_type, T.BinaryType) else value.cast(data_type)


def keys_beyond(spark: SparkSession, path: str, header: list[str], most: int) -> list[str]:
    """Keys that any object of any file has and the header does not name, sorted; any ``most`` of them if there are more."""
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("key"))
    known = F.array_contains(F.array(*[F.lit(name) for name in header]).cast("array<string>"), F.col("key"))
    return sorted(row.key for row in keys.where(~known).distinct().limit(most).collect())


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, extra: str = "drop") -> DataFrame:
    """The keys of the first object, or of ``schema``, as columns; missing ones are null.

    Other keys are dropped; with ``extra="fail"`` they fail the call, with "widen" they
    become columns after the others, by name. Both take a pass over the files for the keys.
    Objects used as maps, with more than WIDEST other keys, are refused; no more than that
    come to the driver. Read them as a map, or without their other keys.

    Without ``schema`` the column types come from one more pass over the files.
    A line that is no JSON, or does not fit its column's type, fails the query.
    """
    if extra not in EXTRA:
        raise ValueError(f"unknown extra {extra}")
    header = read_header(spark, path) if schema is None else schema.names
    others = keys_beyond(spark, path, header, NAMED if extra == "fail" else WIDEST + 1) if extra != "drop" else []
    if others and extra == "fail":
        raise ValueError(f"keys beyond the header {header}: {others}")
    if len(others) > WIDEST:
        raise ValueError(f"more than {WIDEST} keys beyond the header {header}: {others[:NAMED]}")
    if schema is None or others:
        found = {f.name: f.dataType for f in spark.read.option("mode", "FAILFAST").json(path).schema}
        given = [] if schema is None else schema.fields
        added = [*(header if schema is None else []), *others]
        schema = T.StructType([*given, *[T.StructField(name, found.get(name, T.StringType())) for name in added]])
    carried = T.StructType(
        [T.StructField(f.name, T.StringType() if isinstance(f.dataType, _AS_TEXT) else f.dataType) for f in schema]
    )
    df = spark.read.schema(carried).option("mode", "FAILFAST").json(path)
    return df.select(
        *[
            (from_text(field_column(f), f.dataType) if isinstance(f.dataType, _AS_TEXT) else field_column(f)).alias(
                f.name
            )
            for f in schema
        ]
    )


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, every column present, nulls included."""
    ready = df.select(*[json_ready(field_column(f), f.dataType).alias(f.name) for f in df.schema])
    ready.write.mode(mode).option("ignoreNullFields", False).json(path)
