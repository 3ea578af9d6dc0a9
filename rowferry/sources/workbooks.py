"""Folders of workbooks as one table: the first sheet of each, its first row the header."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.texts import field_column, flat_text
from rowferry.sources import sheet_xml
from rowferry.sources.json_files import EXTRA, first_file
from rowferry.sources.workbook_sink import WorkbookSource

PATTERN = "*.xlsx"
_CELLS = "path string, row long, kinds string, cells array<string>"
_CELLS_ARROW = pa.schema(
    [("path", pa.string()), ("row", pa.int64()), ("kinds", pa.string()), ("cells", pa.list_(pa.string()))]
)


# ---------------------------------------------------------------- reading


def _workbooks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).load(path).select("path", "content")


def _header_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            rows = sheet_xml.read_rows(io.BytesIO(content.as_py()))
            names = [text for _, text in next(rows, [])]
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], ["names"])


def read_header(spark: SparkSession, path: str) -> list[str]:
    """The first row of the first workbook."""
    first = _workbooks(spark, first_file(spark, path, PATTERN))
    return first.mapInArrow(_header_of, "names array<string>").first().names


def _cells_of(header: list[str], extra: str):
    width = len(header)
    kept = width if extra == "drop" else None

    def check(path: str, found: list[str]) -> None:
        if found != header:
            raise ValueError(f"{path} has the header {found}, not {header}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                header_there, start = False, 1
                # Python objects are made of no cell but the header's; the content is not copied.
                for kinds, cells in sheet_xml.read_parts(pa.BufferReader(content.as_buffer())):
                    if not header_there:
                        check(path, cells[0].as_py() if len(cells) else [])
                        header_there, kinds, cells = True, kinds[1:], cells[1:]
                    if not len(cells):
                        continue
                    longest = pc.max(pc.binary_length(kinds)).as_py()
                    if extra == "fail" and longest > width and pc.any(pc.match_substring_regex(pc.utf8_slice_codeunits(kinds, width), f"[^{sheet_xml.EMPTY}]")).as_py():
                        raise ValueError(f"{path} has cells beyond the header {header}")
                    if kept is not None and longest > kept:
                        kinds, cells = pc.utf8_slice_codeunits(kinds, 0, kept), pc.list_slice(cells, 0, kept, return_fixed_size_list=False)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(cells), pa.string()), pa.array(range(start, start + len(cells)), pa.int64()), kinds, cells],
                        schema=_CELLS_ARROW,
                    )
                    start += len(cells)
                if not header_there:
                    check(path, [])

    return read


def infer_types(cells: DataFrame, header: list[str]) -> T.StructType:
    """Numbers or flags where a column holds nothing else, text elsewhere."""
    seen = cells.agg(
        *[
            F.max(F.substring("kinds", i + 1, 1) == F.lit(kind)).alias(f"{kind}{i}")
            for i in range(len(header))
            for kind in (sheet_xml.NUMBER, sheet_xml.FLAG, sheet_xml.TEXT)
        ]
    ).first()

    def type_of(i: int) -> T.DataType:
        number, flag, text = (seen[f"{kind}{i}"] for kind in (sheet_xml.NUMBER, sheet_xml.FLAG, sheet_xml.TEXT))
        if number and not flag and not text:
            return T.DoubleType()
        return T.BooleanType() if flag and not number and not text else T.StringType()

    return T.StructType([T.StructField(name, type_of(i)) for i, name in enumerate(header)])


def read_workbooks(
    spark: SparkSession, path: str, schema: T.StructType | None = None, origin_columns: bool = False, extra: str = "drop"
) -> DataFrame:
    """The rows of every workbook in a folder; all must have the same header.

    Numbers become doubles, flags booleans and all else text. A short row ends
    in nulls, a long one is cut at the header's width; with ``extra="fail"`` filled
    cells beyond it fail the query, with "widen" they become columns ``_c5`` and so
    on, by their place from 0, after one more pass. An empty cell is '' in a
    text column and null in others. Without ``schema`` one more pass over the
    workbooks finds the column types. ``origin_columns`` adds the workbook and
    the row number as ``_workbook`` and ``_row``.
    """
    if extra not in EXTRA:
        raise ValueError(f"unknown extra {extra}")
    header = read_header(spark, path)
    cells = _workbooks(spark, path).mapInArrow(_cells_of(header, extra), _CELLS)
    if schema is not None and len(schema) != len(header):
        raise ValueError(f"{len(header)} columns in the workbooks, {len(schema)} in the schema")
    names = list(header)
    if extra == "widen":
        filled = F.rtrim(F.col("kinds"), F.lit(sheet_xml.EMPTY))
        widest = cells.agg(F.max(F.length(filled))).first()[0] or 0
        for i in range(len(header), widest):
            name = f"_c{i}"
            while name in names:
                name = f"_{name}"
            names.append(name)
    if schema is None:
        schema = infer_types(cells.select("kinds"), names)
    elif len(names) > len(header):
        schema = T.StructType([*schema.fields, *infer_types(cells.select("kinds"), names).fields[len(header) :]])

    def value(i: int, data_type: T.DataType):
        text = F.get("cells", F.lit(i))
        if isinstance(data_type, T.StringType):
            return text
        filled = F.when(text != "", text)
        if isinstance(data_type, T.BinaryType):
            return F.unbase64(F.when(F.substring("kinds", i + 1, 1) != sheet_xml.EMPTY, text))
        if isinstance(data_type, T.IntegralType):
            return filled.cast(T.DecimalType(38, 0)).cast(data_type)
        return filled.cast(data_type)

    columns = [value(i, f.dataType).alias(f.name) for i, f in enumerate(schema)]
    if origin_columns:
        columns = [F.col("path").alias("_workbook"), F.col("row").alias("_row"), *columns]
    return cells.select(*columns)


# ---------------------------------------------------------------- writing


def write_workbooks(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    rows_per_workbook: int = sheet_xml.MAX_SHEET_ROWS - 1,
) -> None:
    """A workbook per partition: numbers and flags as such, null as an empty cell, all else as text.

    ``mode`` is one of Spark's four. With "overwrite" the workbooks that were
    there go once the new ones are written.
    """
    spark = df.sparkSession
    if mode not in ("append", "overwrite", "ignore", "error", "errorifexists"):
        raise ValueError(f"unknown mode {mode}")
    path = qualified(spark, path)
    if mode in ("error", "errorifexists", "ignore") and path_exists(spark, path):
        if mode == "ignore":
            return
        raise FileExistsError(path)
    spark.dataSource.register(WorkbookSource)
    native = (T.IntegralType, T.FractionalType, T.BooleanType)
    cells = df.select(
        *[
            (
                field_column(f)
                if isinstance(f.dataType, native) and not isinstance(f.dataType, T.DecimalType)
                else flat_text(field_column(f), f.dataType)
            ).alias(f.name)
            for f in df.schema
        ]
    )
    writer = cells.write.format("workbook").option("path", path).option("rowsPerWorkbook", rows_per_workbook)
    writer.mode("overwrite" if mode == "overwrite" else "append").save()


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark resolves it by, so that every task means the same one."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of that name exists, on any file system Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
