"""The sink that writes one workbook per partition, as a Spark data source."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from rowferry.sources import sheet_xml


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Pieces:
    """Cuts a stream of batches into runs of so many rows."""

    def __init__(self, batches: Iterator[pa.RecordBatch], rows: int):
        self.batches, self.rows = batches, rows
        self.pending: pa.RecordBatch | None = None

    def any_left(self) -> bool:
        while self.pending is None or len(self.pending) == 0:
            self.pending = next(self.batches, None)
            if self.pending is None:
                return False
        return True

    def next_workbook(self) -> Iterator[pa.RecordBatch]:
        room = self.rows
        while room and self.any_left():
            part = self.pending.slice(0, room)
            self.pending = self.pending.slice(len(part))
            room -= len(part)
            yield part


class WorkbookWriter(DataSourceArrowWriter):
    """Writes each partition as one workbook, or several if a sheet overflows.

    Attempts write into a hidden folder under names of their own; the commit
    moves those of the successful attempts into place, so that a retried or
    speculative attempt leaves nothing behind and a failed job shows nothing.
    The moves are one a file: a driver that dies among them leaves some of the
    workbooks in place, next to the hidden folder with the others.
    """

    def __init__(self, path: str, schema: StructType, rows_per_workbook: int, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite
        self.job = uuid.uuid4().hex
        self.header = schema.fieldNames()
        self.rows_per_workbook = min(rows_per_workbook, sheet_xml.MAX_SHEET_ROWS - 1)

    def _folder(self) -> tuple[pyarrow.fs.FileSystem, str]:
        if "://" not in self.path:
            raise ValueError(f"{self.path} names no file system; a task cannot know whose disk is meant")
        return pyarrow.fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = self._folder()
        staging = f"{folder}/_temporary-{self.job}"
        files.create_dir(staging, recursive=True)
        partition = TaskContext.get().partitionId()
        names: list[str] = []
        pieces = _Pieces(iterator, self.rows_per_workbook)
        # The first partition writes even if it is empty, so that the header is never lost.
        while pieces.any_left() or (partition == 0 and not names):
            name = f"part-{partition:05d}-{len(names):03d}-{uuid.uuid4().hex}.xlsx"
            with files.open_output_stream(f"{staging}/{name}") as stream:
                sheet_xml.write_rows(stream, self.header, pieces.next_workbook())
            names.append(name)
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = self._folder()
        names = [name for message in messages if message for name in message.names]
        earlier = []
        if self.overwrite:
            listed = files.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
            earlier = [info.path for info in listed if info.is_file and info.path.endswith(".xlsx")]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda name: files.move(f"{folder}/_temporary-{self.job}/{name}", f"{folder}/{name}"), names))
            list(pool.map(files.delete_file, earlier))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = self._folder()
        staging = f"{folder}/_temporary-{self.job}"
        if files.get_file_info(staging).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(staging)


class WorkbookSource(DataSource):
    """``df.write.format("workbook").option("path", folder)``: one sheet with typed cells."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        limit = int(self.options.get("rowsPerWorkbook", sheet_xml.MAX_SHEET_ROWS - 1))
        return WorkbookWriter(self.options["path"].rstrip("/"), schema, limit, overwrite)
