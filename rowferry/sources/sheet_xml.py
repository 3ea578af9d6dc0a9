"""One workbook's first sheet as rows of cells, and Arrow batches as a one-sheet workbook.

Small helpers for the tasks that read and write workbooks. Both directions
stream the sheet, so that a task holds a batch of rows and not the sheet.
"""

from __future__ import annotations

import itertools
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The most rows a sheet holds, and the names of the format.
MAX_SHEET_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = {
    "[Content_Types].xml": (
        '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType='
        '"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType='
        '"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>'
    ),
    "_rels/.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Target="xl/workbook.xml" Type='
        '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"/></Relationships>'
    ),
    "xl/workbook.xml": (
        '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
        '<sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>'
    ),
    "xl/_rels/workbook.xml.rels": (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Target="worksheets/sheet1.xml" Type='
        '"http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/></Relationships>'
    ),
}

_VALUE, _INLINE = _MAIN + "v", _MAIN + "is"

# How this library writes a sheet, and the bytes that stand for its tags while they are told apart.
_OPENING, _CLOSING = f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode(), b"</sheetData></worksheet>"
_OPEN_TEXT, _OPEN_FLAG, _OPEN_NUMBER = '<c t="inlineStr"><is><t xml:space="preserve">', '<c t="b"><v>', "<c><v>"
_CLOSE_TEXT, _CLOSE_VALUE, _EMPTY_CELL = "</t></is></c>", "</v></c>", "<c/>"
_TAGS = ("", _OPEN_TEXT, _OPEN_FLAG, _OPEN_NUMBER, _EMPTY_CELL, _CLOSE_TEXT, _CLOSE_VALUE, "</row>", "<row>")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
_OTHER_ENTITY = re.compile(rb"&(?!lt;|gt;|quot;|apos;|amp;)")
#: Bytes of a sheet that are read, and rows of a parsed one that are handed on, at a time.
_CHUNK, _PART_ROWS = 1 << 21, 5_000

# Kinds of cells.
NUMBER, FLAG, TEXT, EMPTY = "n", "b", "s", "e"

# Characters that XML cannot hold, and texts that look like their escape.
_UNSAFE = re.compile(r"_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f￾￿]")
_UNSAFE_RE2 = r"_x[0-9A-Fa-f]{4}_|[\x00-\x08\x0b-\x1f\x{FFFE}\x{FFFF}]"
_ESCAPED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _protect(text: str) -> str:
    return escape(_UNSAFE.sub(lambda found: f"_x{ord(found[0]):04X}_", text))


def _restore(text: str) -> str:
    if "_x" not in text:
        return text
    return _ESCAPED.sub(lambda found: chr(int(found[1], 16)), text)


def _text_of(node: ElementTree.Element) -> str:
    """The text of a rich or plain string, without its phonetic hints."""
    if len(node) == 1 and node[0].tag == _MAIN + "t":
        return _restore(node[0].text or "")
    parts = []
    for child in node:
        if child.tag == _MAIN + "t":
            parts.append(child.text or "")
        elif child.tag == _MAIN + "r":
            parts.extend(part.text or "" for part in child.iter(_MAIN + "t"))
    return _restore("".join(parts))


def _first_sheet(package: zipfile.ZipFile) -> str:
    book = ElementTree.fromstring(package.read("xl/workbook.xml"))
    sheet = book.find(f"{_MAIN}sheets/{_MAIN}sheet")
    if sheet is None:
        raise ValueError("no sheets found in workbook")
    for relation in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels")):
        if relation.get("Id") == sheet.get(_RELATION):
            target = relation.get("Target")
            return target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    raise ValueError("the first sheet of the workbook is missing")


def _shared_texts(package: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in package.namelist():
        return []
    texts = []
    with package.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == _MAIN + "si":
                texts.append(_text_of(node))
                node.clear()
    return texts


def _column_index(reference: str) -> int:
    index = 0
    for letter in reference.rstrip("0123456789").upper():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _cell(node: ElementTree.Element, shared: list[str]) -> tuple[str, str]:
    kind = node.get("t", NUMBER)
    child = node[0] if len(node) == 1 else node.find(_INLINE if kind == "inlineStr" else _VALUE)
    if child is None:
        return EMPTY, ""
    if kind == "inlineStr":
        return TEXT, _text_of(child)
    text = child.text if child.tag == _VALUE else None
    if not text:
        return EMPTY, ""
    if kind == NUMBER:
        try:
            float(text)
            return NUMBER, text
        except ValueError:
            return TEXT, text
    if kind == "s":
        return TEXT, shared[int(text)]
    if kind == "b":
        return FLAG, "true" if text == "1" else "false"
    return TEXT, _restore(text)


def _row(node: ElementTree.Element, shared: list[str], positions: dict[str, int]) -> list[tuple[str, str]]:
    cells: list[tuple[str, str]] = []
    for child in node:
        reference = child.get("r")
        if reference:
            letters = reference.rstrip("0123456789")
            position = positions.get(letters)
            if position is None:
                position = positions[letters] = _column_index(letters)
            while len(cells) < position:
                cells.append((EMPTY, ""))
        cells.append(_cell(child, shared))
    return cells


def read_rows(file: BinaryIO) -> Iterator[list[tuple[str, str]]]:
    """Rows of (kind, text) cells. Gaps before a row's last cell are empty cells.

    The sheet's tree grows with each chunk, and the rows that a chunk completes
    are taken off it again.
    """
    with zipfile.ZipFile(file) as package:
        shared, positions = _shared_texts(package), {}
        builder = ElementTree.TreeBuilder()
        top = builder.start("top", {})
        parser = ElementTree.XMLParser(target=builder)
        with package.open(_first_sheet(package)) as stream:
            more = True
            while more:
                chunk = stream.read(1 << 18)
                more = bool(chunk)
                parser.feed(chunk)
                data = top.find(f"*/{_MAIN}sheetData")
                if data is None:
                    continue
                # The last row may still be open unless the sheet has ended.
                done = len(data) - 1 if more else len(data)
                for node in data[: max(done, 0)]:
                    yield _row(node, shared, positions)
                del data[: max(done, 0)]


def _own_rows(data: bytes) -> tuple[pa.Array, pa.Array] | None:
    """Whole rows as ``read_parts`` gives them, if they are written as this library does; else None.

    Each tag becomes one byte that XML does not hold. If no other tag is left and
    these bytes are in order, what lies between them are the texts of the cells.
    """
    raw = np.frombuffer(data, np.uint8)
    low = raw[raw < 32]
    if not np.isin(low, (9, 10)).all() or any(x in data for x in (b"]]>", b"\xef\xbf\xbe", b"\xef\xbf\xbf")):
        return None
    entities = b"&" in data
    if entities and _OTHER_ENTITY.search(data):
        return None
    for mark, tag in enumerate(_TAGS[1:], 1):
        data = data.replace(tag.encode(), bytes([mark]))
    try:
        data.decode()
    except UnicodeDecodeError:
        return None
    if b"<" in data:
        return None
    raw = np.frombuffer(data, np.uint8)
    marked = raw < 9
    at = np.flatnonzero(marked)
    marks, after = raw[at], np.append(raw[at][1:], 8)
    opens = marks <= 3
    ended = np.where(marks == 1, after == 5, after == 6)
    # A cell's text is ended by its own tag; other tags follow each other directly, a row's end by a row's start only.
    follows = np.where(marks == 7, after == 8, (after <= 4) | (after == 7)) & (np.append(at[1:], len(raw)) == at + 1)
    if raw[0] != 8 or marks[-1] != 7 or not np.where(opens, ended, follows).all():
        return None
    cells = marks <= 4
    marks_of = marks[cells]
    lengths = np.where(opens, np.append(at[1:], len(raw)) - at - 1, 0)[cells]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    texts = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(raw[~marked]))
    if entities:
        for entity, plain in _ENTITIES:
            texts = pc.replace_substring(texts, entity, plain)
    kinds = np.frombuffer(f"-{TEXT}{FLAG}{NUMBER}{EMPTY}".encode(), np.uint8)[marks_of]
    kinds[(lengths == 0) & (marks_of != 1)] = ord(EMPTY)
    numbers = np.flatnonzero(kinds == ord(NUMBER))
    usual = pc.match_substring_regex(texts.take(pa.array(numbers)), r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    for i in numbers[~usual.to_numpy(zero_copy_only=False)].tolist():
        try:
            float(texts[i].as_py())
        except ValueError:
            kinds[i] = ord(TEXT)
    flags = kinds == ord(FLAG)
    if flags.any():
        told = pc.if_else(pc.equal(texts.filter(pa.array(flags)), "1"), "true", "false")
        texts = pc.replace_with_mask(texts, pa.array(flags), told)
    if b"_x" in data:
        escaped = pc.and_(pa.array(marks_of == 1), pc.match_substring_regex(texts, _ESCAPED.pattern))
        told = pa.array([_restore(text) for text in texts.filter(escaped).to_pylist()], pa.string())
        texts = pc.replace_with_mask(texts, escaped, told)
    ends = np.cumsum(cells)[marks == 7]
    rows = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(rows), pa.py_buffer(kinds)), pa.ListArray.from_arrays(pa.array(rows), texts)


def _own_parts(file: BinaryIO) -> Iterator[tuple[pa.Array, pa.Array] | None]:
    """The rows of a sheet by chunks; None, and no more, where it is not written as this library does."""
    with zipfile.ZipFile(file) as package, package.open(_first_sheet(package)) as stream:
        if stream.read(len(_OPENING)) != _OPENING:
            yield None
            return
        data = b""
        while chunk := stream.read(_CHUNK):
            data += chunk
            cut = data.rfind(b"</row>") + 6
            if cut > 5:
                part = _own_rows(data[:cut])
                yield part
                if part is None:
                    return
                data = data[cut:]
        if data != _CLOSING:
            yield None


def read_parts(file: BinaryIO) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The rows that ``read_rows`` gives, many at a time: a text of their cells' kinds and a list of their cells' texts.

    A sheet that this library wrote is taken apart as a whole, chunk by chunk. What
    follows the first row that is written in another way comes from ``read_rows``.
    """
    done = 0
    for part in _own_parts(file) if zipfile.is_zipfile(file) else (None,):
        if part is None:
            break
        done += len(part[0])
        yield part
    else:
        return
    rows = itertools.islice(read_rows(file), done, None)
    while part := list(itertools.islice(rows, _PART_ROWS)):
        kinds = ["".join(kind for kind, _ in row) for row in part]
        yield pa.array(kinds, pa.string()), pa.array([[text for _, text in row] for row in part], pa.list_(pa.string()))


def _joined(*parts) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _escaped(texts: pa.Array) -> pa.Array:
    """Texts as XML holds them."""
    if pc.any(pc.match_substring_regex(texts, _UNSAFE_RE2)).as_py():
        return pa.array([None if text is None else _protect(text) for text in texts.to_pylist()], pa.string())
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        texts = pc.replace_substring(texts, plain, entity)
    return texts


def _cells_xml(column: pa.Array) -> tuple:
    """A column as cells, in parts to be joined: numbers and flags as such, texts inline, nulls empty."""
    if pa.types.is_boolean(column.type):
        parts = (_OPEN_FLAG, pc.if_else(column, "1", "0"), _CLOSE_VALUE)
    elif pa.types.is_floating(column.type):
        texts = column.cast(pa.float64()).cast(pa.string())
        parts = (_OPEN_NUMBER, texts, _CLOSE_VALUE)
        finite = pc.is_finite(column)
        if pc.any(pc.invert(finite)).as_py():
            parts = (pc.if_else(finite, _joined(*parts), _joined(_OPEN_TEXT, _escaped(texts), _CLOSE_TEXT)),)
    elif pa.types.is_integer(column.type):
        parts = (_OPEN_NUMBER, column.cast(pa.string()), _CLOSE_VALUE)
    else:
        parts = (_OPEN_TEXT, _escaped(column.cast(pa.string())), _CLOSE_TEXT)
    return (pc.fill_null(_joined(*parts), _EMPTY_CELL),) if column.null_count else parts


def _rows_xml(batch: pa.RecordBatch) -> memoryview | bytes:
    parts: list = ["<row>"]
    for part in (part for column in batch.columns for part in (*_cells_xml(column), "")):
        if isinstance(part, str) and isinstance(parts[-1], str):
            parts[-1] += part
        else:
            parts.append(part)
    rows = _joined(*parts[:-1], f"{parts[-1]}</row>")
    if not isinstance(rows, pa.Array):  # no columns
        return b"<row></row>" * len(batch)
    _, offsets, data = rows.buffers()
    ends = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1]
    return memoryview(data)[ends[0] : ends[-1]] if len(rows) else b""


def write_rows(target: BinaryIO, header: list[str], batches: Iterable[pa.RecordBatch]) -> None:
    """Write a workbook with one sheet: the header, then the rows of the batches."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as package:
        for name, text in _PACKAGE.items():
            package.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
        with package.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(_OPENING)
            names = pa.RecordBatch.from_arrays([pa.array([n], pa.string()) for n in header], [f"{i}" for i in range(len(header))])
            for batch in itertools.chain((names,), batches):
                sheet.write(_rows_xml(batch))
            sheet.write(_CLOSING)
