"""WARC records in ZIP archives: written with an index, read back by range.

An archive holds three stored (not compressed) members: ``archive/data.warc.gz``,
each record a gzip member of its own; ``indexes/index.cdxj``, a line per record
with its place in that member; and ``datapackage.json``, which names both. A
reader finds the members by the central directory at the archive's end, with
its ZIP64 form where sizes ask for it, and then fetches records by their ranges.
It takes archives of others too: any ``archive/*.warc.gz`` (or ``.warc``) and
``indexes/*.cdx*`` members, CDXJ and CDX lines, any record types and identifiers.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.files import create, fresh_name, opened, shared_uri
from rowferry.llm.scratch import stored
from rowferry.plans.session import ship_package

#: Payload bytes meant for one writing task, and WARC bytes after which it starts a new archive.
TASK_BYTES, ARCHIVE_BYTES = 64 << 20, 64 << 20
#: Records of one archive whose ranges are read by one task at a time, and bytes fetched at once.
FETCH_ROWS, FETCH_BYTES = 2_000, 8 << 20

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"

# Signatures of the ZIP format.
_LOCAL, _CENTRAL, _END = 0x04034B50, 0x02014B50, 0x06054B50
_END64, _LOCATOR64 = 0x06064B50, 0x07064B50
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_DEFLATED = 8
_DOS_DATE = 0x21  # 1980-01-01
_LOCAL_HEAD, _CENTRAL_HEAD, _END_HEAD = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")
_END64_HEAD, _LOCATOR_HEAD = struct.Struct("<IQHHIIQQQQ"), struct.Struct("<IIQI")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- ZIP


class ZipWriter:
    """Stored members, one after another; sizes follow from a member's bytes, so each is given as parts."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.offset, self.entries, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.offset += len(data)

    def member(self, name: str, parts: list[bytes]) -> None:
        crc, size = 0, sum(map(len, parts))
        for part in parts:
            crc = zlib.crc32(part, crc)
        wide = self.zip64 or size >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        short = _FULL32 if wide else size
        self.entries.append((name.encode(), crc, size, self.offset))
        self._put(_LOCAL_HEAD.pack(_LOCAL, 45 if wide else 20, 0x800, 0, 0, _DOS_DATE, crc, short, short, len(name.encode()), len(extra)) + name.encode() + extra)
        for part in parts:
            self._put(part)

    def close(self) -> None:
        start = self.offset
        for name, crc, size, offset in self.entries:
            wide = self.zip64 or size >= _FULL32 or offset >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            short, place = (_FULL32, _FULL32) if wide else (size, offset)
            version = 45 if wide else 20
            self._put(_CENTRAL_HEAD.pack(_CENTRAL, version, version, 0x800, 0, 0, _DOS_DATE, crc, short, short, len(name), len(extra), 0, 0, 0, 0, place) + name + extra)
        size, count = self.offset - start, len(self.entries)
        if self.zip64 or start >= _FULL32 or size >= _FULL32 or count >= _FULL16:
            at = self.offset
            self._put(_END64_HEAD.pack(_END64, _END64_HEAD.size - 12, 45, 45, 0, 0, count, count, size, start))
            self._put(_LOCATOR_HEAD.pack(_LOCATOR64, 0, at, 1))
            start, size, count = _FULL32, _FULL32, _FULL16
        self._put(_END_HEAD.pack(_END, 0, 0, count, count, size, start, 0))
        self.out.close()


@dataclass(frozen=True)
class Member:
    offset: int  # of the first byte of data
    size: int
    crc: int
    stored: bool
    method: int = 0


def directory(file) -> dict[str, Member]:
    """The members of an archive, from the directories at its end; file has size() and read_at()."""
    total = file.size()
    tail_at = max(0, total - (1 << 16) - _END_HEAD.size)
    tail = file.read_at(total - tail_at, tail_at)
    end = len(tail) - _END_HEAD.size
    while end >= 0:  # the comment after the record may hold its signature too
        end = tail.rfind(struct.pack("<I", _END), 0, end + 4)
        if end < 0 or end + _END_HEAD.size + _END_HEAD.unpack_from(tail, end)[-1] == len(tail):
            break
        end -= 1
    if end < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    *_, count, size, start, _ = _END_HEAD.unpack_from(tail, end)
    if _FULL32 in (size, start) or count == _FULL16:
        signature, _, at, _ = _LOCATOR_HEAD.unpack(file.read_at(_LOCATOR_HEAD.size, tail_at + end - _LOCATOR_HEAD.size))
        if signature == _LOCATOR64:
            signature, *_, count, size, start = _END64_HEAD.unpack(file.read_at(_END64_HEAD.size, at))
            if signature != _END64:
                raise ValueError("damaged ZIP64 end of central directory")
    listing, at, members = file.read_at(size, start), 0, {}
    for _ in range(count):
        signature, _, _, _, method, _, _, crc, packed, plain, n_name, n_extra, n_comment, _, _, _, place = _CENTRAL_HEAD.unpack_from(listing, at)
        if signature != _CENTRAL:
            raise ValueError("damaged central directory")
        at += _CENTRAL_HEAD.size
        name, extra = listing[at : at + n_name].decode(), listing[at + n_name : at + n_name + n_extra]
        at += n_name + n_extra + n_comment
        plain, packed, place = _widened(extra, plain, packed, place)
        head = _LOCAL_HEAD.unpack(file.read_at(_LOCAL_HEAD.size, place))
        if head[0] != _LOCAL:
            raise ValueError(f"no local header for {name}")
        members[name] = Member(place + _LOCAL_HEAD.size + head[-2] + head[-1], packed, crc, method == 0, method)
    return members


def _widened(extra: bytes, *values: int) -> list[int]:
    """Size, packed size and offset, each from the ZIP64 field where its short form is full."""
    wide: list[int] = []
    while len(extra) >= 4:
        kind, size = struct.unpack_from("<HH", extra)
        if kind == 1:
            wide = list(struct.unpack_from(f"<{size // 8}Q", extra, 4))
        extra = extra[4 + size :]
    return [wide.pop(0) if value == _FULL32 and wide else value for value in values]


# ---------------------------------------------------------------- records


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a resource's response, or a revisit that names the page with the same payload."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + (b"" if revisit else payload)
    clean = (url or "").translate({10: None, 13: None})
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1980-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    whole = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def _agrees(digest: str, data: bytes) -> bool:
    """Whether a labelled digest, base32 or hexadecimal, is that of the data; one of an unknown kind counts as such."""
    kind, _, value = digest.strip().partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"):
        return True
    found = hashlib.new(kind, data).digest()
    return value.upper().rstrip("=") in (base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def _page(identifier: str | None) -> int | None:
    found = re.fullmatch("<urn:page:(-?[0-9]+)>", identifier or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def parse(data: bytes) -> dict:
    """The fields of a record and its payload (of a revisit: none), checked against its lengths and digests as far as it has them.

    Identifiers are texts; ``page_id`` is the number of those that name a page. The payload of a
    record that is no HTTP message is its whole block.
    """
    whole = zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # a folded line
            fields[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.removeprefix(" ")
    identifier = fields.get("warc-record-id", "").strip()
    length = fields.get("content-length")
    body = rest.removesuffix(b"\r\n\r\n") if length is None else rest[: int(length)]
    if length is not None and len(body) != int(length):
        raise ValueError(f"damaged block of {identifier}")
    kind = fields.get("warc-type", "").strip()
    http, payload = b"", body
    if fields.get("content-type", "").strip().lower().startswith("application/http"):
        http, _, payload = body.partition(b"\r\n\r\n")
    digest, size = fields.get("warc-payload-digest"), fields.get("warc-payload-length")
    if "warc-block-digest" in fields and not _agrees(fields["warc-block-digest"], body):
        raise ValueError(f"damaged block of {identifier}")
    if kind != "revisit":
        # Archives differ in whether the digest of a payload sent in chunks is that of the chunks: it is not checked.
        chunked = b"\r\ntransfer-encoding:" in http.lower()
        if not chunked and (size is not None and len(payload) != int(size) or digest is not None and not _agrees(digest, payload)):
            raise ValueError(f"damaged payload of {identifier}")
        size = len(payload) if size is None else size
    refers_to = fields.get("warc-refers-to", "").strip()
    return {
        "page_id": _page(identifier), "url": fields.get("warc-target-uri"), "payload_bytes": None if size is None else int(size),
        "payload_digest": None if digest is None else digest.strip().removeprefix("sha1:"), "record_type": kind, "refers_to": _page(refers_to),
        "record_id": identifier or None, "refers_to_id": refers_to or None, "payload": None if kind == "revisit" else payload,
    }


def _archives(rows: Iterator[tuple], folder: str) -> Iterator[tuple[str, int]]:
    """Write the rows (page_id, url, html, refers_to) as archives; their names and numbers of records."""
    parts: list[bytes] = []
    index: list[str] = []
    size = 0

    def made():
        uri = fresh_name(folder, ".wacz")
        out = ZipWriter(create(uri))
        out.member(DATA, parts)
        out.member(INDEX, ["".join(index).encode()])
        out.member(PACKAGE, [json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode()])
        out.close()
        return uri, len(parts)

    for page_id, url, html, refers_to in rows:
        data = record(page_id, url, (html or "").encode(), refers_to)
        index.append(json.dumps({"page": page_id, "offset": size, "length": len(data)}) + "\n")
        parts.append(data)
        size += len(data)
        if size >= ARCHIVE_BYTES:
            yield made()
            parts, index, size = [], [], 0
    if parts:
        yield made()


def write(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a record per row of pages; return the manifest: archive, n_records.

    Of rows with equal payloads of at least ``least`` bytes the one with the
    smallest page_id is a response, all others are revisits of it. Rows that
    repeat that page_id and its payload are responses too. Null html is an
    empty payload. A row without page_id is a revisit of an equal payload that
    has one; a group without any page_id stays responses. Other columns than
    page_id, url and html are not read.
    """
    ship_package(spark)
    folder = shared_uri(spark, "archives")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint"), "url", html.alias("html"))
    firsts = rows.where(F.octet_length("html") >= least).groupBy(F.sha2("html", 256).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts, _ = stored(spark, firsts.where("n > 1"), "equal-payloads")
    total = rows.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    # Rows go to tasks by page and text, so that no payload's copies meet in one.
    marked = (
        rows.withColumn("digest", F.sha2("html", 256)).join(firsts, "digest", "left")
        .select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
        .repartition(max(1, -(-total // TASK_BYTES)), "page_id")
    )

    def run(batches):
        rows = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns]))
        for uri, count in _archives(rows, folder):
            yield pa.RecordBatch.from_pylist([{"archive": uri, "n_records": count}])

    return stored(spark, marked.mapInArrow(run, "archive string, n_records bigint"), "archive-list")[0]


def _index_text(file, name: str, member: Member) -> str:
    data = file.read_at(member.size, member.offset)
    if not member.stored:
        if member.method != _DEFLATED:
            raise ValueError(f"{name} is packed by the unknown method {member.method}")
        data = zlib.decompress(data, -15)
    if zlib.crc32(data) != member.crc:
        raise ValueError(f"damaged index {name}")
    if name.endswith(".gz"):  # of one or more gzip members
        data = gzip.decompress(data)
    return data.decode()


def _entries(text: str) -> Iterator[tuple[str | None, int, int]]:
    """File name, offset and length of each line: CDXJ (key, timestamp, JSON), JSON alone, or CDX with its head line."""
    letters: list[str] = []
    for line in text.split("\n"):
        if line.lstrip().startswith("CDX "):
            letters = line.split()[1:]
        elif line.strip() and not line.startswith("!"):
            if letters:
                found = dict(zip(letters, line.split()))
                name, offset, length = found["g"], found["V"], found["S"]
            else:
                found = json.loads(line[line.index("{") :])
                name, offset, length = found.get("filename"), found["offset"], found["length"]
            yield name, int(offset), int(length)


def places(file) -> list[tuple[int, int]]:
    """Offset in the archive and length of every record that its indexes name, each once, in ascending order."""
    members = directory(file)
    data = {name: member for name, member in members.items() if re.fullmatch(r"archive/.+\.warc(\.gz)?", name)}
    indexes = [name for name in members if re.fullmatch(r"indexes/.+\.cdxj?(\.gz)?", name)]
    if not indexes:
        raise ValueError("no index in the archive")
    found = set()
    for index in indexes:
        for name, offset, length in _entries(_index_text(file, index, members[index])):
            if name is None and len(data) != 1:
                raise ValueError(f"{index} names no file, of {len(data)}")
            member = next(iter(data.values())) if name is None else data.get(name) or data.get(f"archive/{name}")
            if member is None:
                raise ValueError(f"{index} names {name}, which is not in the archive")
            if not member.stored:
                raise ValueError(f"compressed member {name}")
            if offset < 0 or offset + length > member.size:
                raise ValueError(f"{index} names a place beyond the end of {name}")
            found.add((member.offset + offset, length))
    return sorted(found)


def index_of(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Where the records are: archive, group, offset (in the archive), length. Only directories and indexes are read."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                with opened(uri) as file:
                    entries = places(file)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([uri] * len(entries)), pa.array([i // FETCH_ROWS for i in range(len(entries))], pa.int64()),
                        pa.array([offset for offset, _ in entries], pa.int64()), pa.array([length for _, length in entries], pa.int64()),
                    ],
                    names=["archive", "group", "offset", "length"],
                )

    n = max(1, spark.sparkContext.defaultParallelism)
    return manifest.select("archive").repartition(n, "archive").mapInArrow(run, "archive string, group bigint, offset bigint, length bigint")


def fetch(spark: SparkSession, places: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at the given places, fetched by range and checked; neighbours are fetched together."""
    ship_package(spark)
    fields = ["page_id bigint", "url string", "payload_bytes bigint", "payload_digest string", "record_type string", "refers_to bigint", "record_id string", "refers_to_id string", *["payload binary"] * payloads]
    names = [field.split()[0] for field in fields]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            places, at = sorted(zip(*[batch.column(i).to_pylist() for i in range(3)])), 0
            while at < len(places):
                uri, start, _ = places[at]
                upto = at
                while upto < len(places) and places[upto][0] == uri and places[upto][1] + places[upto][2] - start <= max(FETCH_BYTES, places[at][2]):
                    upto += 1
                with opened(uri) as file:
                    last = places[upto - 1]
                    data = file.read_at(last[1] + last[2] - start, start)
                found = [parse(data[offset - start : offset - start + length]) for _, offset, length in places[at:upto]]
                yield pa.RecordBatch.from_arrays([pa.array([row[name] for row in found], kind) for name, kind in zip(names, types)], names=names)
                at = upto

    # One group of an archive after the other: groups spread over all tasks.
    n = max(1, spark.sparkContext.defaultParallelism)
    spread = places.repartition(n, "archive", "group").sortWithinPartitions("archive", "offset")
    return spread.select("archive", "offset", "length").mapInArrow(run, ", ".join(fields))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return fetch(spark, index_of(spark, manifest), payloads=False).drop("url", "record_id", "refers_to_id")
