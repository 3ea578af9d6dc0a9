"""Folders of tabular JSON documents: ``{"fields": [], "types": [], "rows": [[]]}``."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.sqltypes import canonical_of, spark_type_of
from rowferry.functions.texts import json_list
from rowferry.sources.json_files import first_file, from_text

# A document of another's making is read by one task as one text, so that a writer keeps it within these many rows and bytes.
ROWS_PER_DOCUMENT = 100_000
BYTES_PER_DOCUMENT = 64 << 20

_HEAD = "fields array<string>, types array<string>"
_DOCUMENT = f"{_HEAD}, rows array<array<string>>"

#: The lines of this library's own documents: the first, the last, the first row's, the other rows', blank ones; and any other line.
_FIRST, _LAST, _ROW, _NEXT_ROW, _BLANK, _OTHER = range(6)
_ROWS_FOLLOW = '"rows":['


def _parsed(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def _document_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per document. It is parsed from its text, as the JSON file source
    would go back to the file for each number that is to become text."""
    return spark.read.text(path, wholetext=True).where(F.length("value") > 0)


def read_header(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """The names and type names of the first document: from its first line, if both end there, else from its text."""
    first = first_file(spark, path)
    line = spark.read.text(first).where(F.trim("value") != "").first()
    if line is not None and line.value.endswith(_ROWS_FOLLOW):
        try:
            head = json.loads(line.value + "]}")
        except ValueError:
            head = {}
        if head.keys() == {"fields", "types", "rows"} and all(type(v) is str for v in [*head["fields"], *head["types"]]):
            return head["fields"], head["types"]
    texts = _document_texts(spark, first)
    head = texts.select(_parsed(texts.value, _HEAD).alias("d")).first()
    if head is None or head.d is None or head.d.fields is None:
        raise ValueError(f"no tabular JSON document in {path}")
    return head.d.fields, head.d.types or []


def _split_size(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _line_kind() -> Column:
    value = F.col("value")
    return (
        F.when(value == "", _BLANK).when(value == "]}", _LAST)
        .when(value.startswith("[") & value.endswith("]"), _ROW)
        .when(value.startswith(",[") & value.endswith("]"), _NEXT_ROW)
        .when(value.startswith("{") & value.endswith(_ROWS_FOLLOW), _FIRST).otherwise(_OTHER)
    )


def _not_by_lines(lines: DataFrame) -> list[str]:
    """The files among these that are not laid out as this library does: one first line, rows and blank lines, one last line.

    One scan that looks at the ends of lines and parses nothing. All that
    reaches the driver is the paths of such files, each longer than a split,
    which the driver has listed to read them.
    """
    at = F.col("_metadata")
    # A split's lines are neighbours in one task, so the two numbers give a file's lines their order.
    place = F.struct(at.file_block_start.alias("split"), F.monotonically_increasing_id().alias("line"))
    kinds = lines.select(at.file_path.alias("file"), _line_kind().alias("kind"), place.alias("place")).where(F.col("kind") != _BLANK)
    each = kinds.groupBy("file").agg(
        F.min_by("kind", "place").alias("first"), F.max_by("kind", "place").alias("last"),
        F.count_if(F.col("kind").isin(_FIRST, _LAST, _OTHER)).alias("n_frame"),
        F.count_if(F.col("kind") == _ROW).alias("n_row"),
        F.max(F.when(F.col("kind") == _ROW, F.col("place"))).alias("row"),
        F.min(F.when(F.col("kind") == _NEXT_ROW, F.col("place"))).alias("next"),
    )
    framed = (F.col("first") == _FIRST) & (F.col("last") == _LAST) & (F.col("n_frame") == 2)
    own = framed & (F.col("n_row") <= 1) & F.coalesce(F.col("row") < F.col("next"), F.col("next").isNull())
    return [row.file for row in each.where(~own).select("file").collect()]


def read_json_tabular(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All rows of all documents, under the first document's names and types.

    ``schema`` gives the column types instead, for instance a decimal's exact
    precision. A document with another header, a row of another width or a
    value that does not fit its type fails the query.

    A document within a split of the scan is parsed as one text. A longer one
    that has a row a line, as this library writes it, is read by its lines in
    as many tasks as it has splits. Any other is one text, whatever its length.
    """
    fields, types = read_header(spark, path)
    if schema is None:
        if len(types) != len(fields):
            raise ValueError("columns and types mismatch or empty")
        pairs = zip(fields, types, strict=True)
        schema = T.StructType([T.StructField(name, spark_type_of(kind, name)) for name, kind in pairs])
    elif len(schema) != len(fields):
        raise ValueError(f"{len(fields)} columns in the documents, {len(schema)} in the schema")

    def agrees(document: Column) -> Column:
        return document.fields.eqNullSafe(_texts(fields)) & F.coalesce(document.types, _texts([])).eqNullSafe(
            _texts(types)
        )

    def checked_rows(document: Column) -> Column:
        wrong = F.raise_error("documents with different fields or types").cast("array<array<string>>")
        return F.when(agrees(document), document.rows).otherwise(wrong)

    # The size is a condition on the listing: no file is opened for it.
    long = F.col("_metadata.file_size") > _split_size(spark)
    by_lines, texts = None, _document_texts(spark, path)
    if not spark.read.format("binaryFile").load(path).where(F.col("length") > _split_size(spark)).isEmpty():
        lines = spark.read.text(path).where(long)
        others = _not_by_lines(lines)
        other = F.col("_metadata.file_path").isin(others) if others else F.lit(False)
        texts, by_lines = texts.where(~long | other), lines.where(~other)
    # A lambda's argument is evaluated once, so that a document is parsed once.
    parsed = F.get(F.transform(F.array(_parsed(texts.value, _DOCUMENT)), checked_rows), F.lit(0))
    rows = texts.select(F.posexplode_outer(parsed).alias("place", "r")).where("place IS NOT NULL")
    if by_lines is not None:
        rows = rows.unionByName(_rows_of_lines(by_lines, agrees))
    # Spark may evaluate the conditions in either order, so that this one holds without the other.
    fits = F.col("place").isNull() | F.coalesce(F.size("r") == len(fields), F.lit(False))
    rows = rows.where(F.assert_true(fits, f"a row does not have {len(fields)} values").isNull())
    return rows.select(*[from_text(F.get("r", F.lit(i)), f.dataType).alias(f.name) for i, f in enumerate(schema)])


def _rows_of_lines(lines: DataFrame, agrees: Callable[[Column], Column]) -> DataFrame:
    """place, r: the rows of documents that have one a line. Their first lines are checked, their last ones left out."""
    kind, value = _line_kind(), F.col("value")
    head = _parsed(F.when(kind == _FIRST, F.concat("value", F.lit("]}"))), _HEAD)
    wrong = F.raise_error("documents with different fields or types").cast("boolean")
    skipped = F.when(kind == _FIRST, F.when(agrees(head), F.lit(False)).otherwise(wrong))
    kept = lines.where(F.coalesce(skipped, kind.isin(_ROW, _NEXT_ROW)))
    # Within the object that it stands in, so that a line which closes the list of rows shows other keys or rows.
    wrapped = F.concat(F.lit("{" + _ROWS_FOLLOW), F.ltrim(value, F.lit(",")), F.lit("]}"))

    def only_row(found: Column) -> Column:
        listed = F.map_values(found)
        several = F.raise_error("a line of a tabular document holds more than a row").cast("array<string>")
        return F.when((F.size(listed) == 1) & (F.size(F.get(listed, F.lit(0))) == 1), F.get(F.get(listed, F.lit(0)), F.lit(0))).otherwise(several)

    row = F.get(F.transform(F.array(_parsed(wrapped, "map<string, array<array<string>>>")), only_row), F.lit(0))
    return kept.select(F.lit(0).alias("place"), row.alias("r"))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def _documents(head: str, rows_per_document: int, bytes_per_document: int):
    """Wrap the row texts of a partition into documents, one line each for head, row and tail.

    A document that is full of bytes before it is of rows gets blank lines, so
    that all but the last have as many lines.
    """

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines(*values: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], ["value"])

        filled, size, seen = None, 0, False
        for batch in batches:
            texts, start = batch.column(0), 0
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            while start < len(texts):
                seen = True
                before = int(ends[start - 1]) if start else 0
                if filled is None:
                    yield lines(head)
                    yield pa.RecordBatch.from_arrays([texts.slice(start, 1)], ["value"])
                    filled, size, start = 1, int(ends[start]) - before, start + 1
                    continue
                room = int(np.searchsorted(ends, before + bytes_per_document - size, "right")) - start
                part = texts.slice(start, max(0, min(room, rows_per_document - filled)))
                if len(part):
                    yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise("", part, ",")], ["value"])
                    filled, start = filled + len(part), start + len(part)
                    size += int(ends[start - 1]) - before
                if filled == rows_per_document or start < len(texts):
                    yield lines(*[""] * (rows_per_document - filled), "]}")
                    filled = None
        if filled is not None:
            yield lines("]}")
        elif not seen and TaskContext.get().partitionId() == 0:
            # The text writer makes a file for the first partition even if it is empty.
            yield lines(head, "]}")

    return wrap


def write_json_tabular(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    rows_per_document: int = ROWS_PER_DOCUMENT,
    bytes_per_document: int = BYTES_PER_DOCUMENT,
) -> None:
    """Documents of at most so many rows and bytes (or of one row), each a file of its own.

    A file holds its document's first line, one line a row, and its last line;
    that makes ``maxRecordsPerFile`` cut the files exactly between documents.
    """
    header = {"fields": df.columns, "types": [canonical_of(f.dataType) for f in df.schema]}
    head = json.dumps(header, ensure_ascii=False, separators=(",", ":"))[:-1] + ',"rows":['
    counted = Observation()
    texts = df.select(json_list(df).alias("value")).observe(counted, F.count(F.lit(1)).alias("rows"))
    lines = texts.mapInArrow(_documents(head, rows_per_document, bytes_per_document), "value string")
    writer = lines.write.mode(mode).option("maxRecordsPerFile", rows_per_document + 2)
    writer.text(path)
    if counted.get["rows"] == 0:
        one = df.sparkSession.range(0, 1, 1, 1).select(F.lit(head + "]}").alias("value"))
        one.write.mode("append" if mode == "append" else "overwrite").text(path)
