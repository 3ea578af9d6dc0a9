import io
import zipfile

import pyarrow.parquet as pq
import pytest
from conftest_llm import SMALL

from rowferry.llm import warc


class Bytes:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


class Kept(io.BytesIO):
    def close(self):
        pass


def expected(rows):
    found = []
    for i, _, html in rows:
        ids = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        first = min(ids, default=None)
        data = (html or "").encode()
        revisit = first is not None and first != i
        found.append((i, len(data), warc.base32_sha1(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(found, key=repr)


ROWS = [
    (3, "u", "x"), (1, None, "x"), (2, "a\r\nb", "é\r\n\r\n"), (4, "", None), (5, "v", ""), (None, "w", "x"), (None, "w", "only here"), (6, "y", "y" * 300_000), (6, "y", "y" * 300_000),
    (7, "http://x/ü?q#f", "y" * 300_000),
]


@pytest.mark.parametrize("size", [64 << 20, 50])
def test_archives(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "TASK_BYTES", max(size, 100_000))
    pages = spark.createDataFrame([(*row, "c") for row in ROWS], "page_id long, url string, html string, digest string")
    manifest = warc.write(spark, pages)
    read = warc.fetch(spark, warc.index_of(spark, manifest)).collect()
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([tuple(r[c] for c in columns) for r in read], key=repr) == expected(ROWS)
    for row in read:
        assert (row.payload is None) == (row.record_type == "revisit")
        assert row.payload is None or warc.base32_sha1(row.payload) == row.payload_digest
    for row in manifest.collect():
        with zipfile.ZipFile(row.archive.removeprefix("file://")) as archive:
            assert archive.testzip() is None
            assert {i.compress_type for i in archive.infolist()} == {zipfile.ZIP_STORED}


def test_no_rows(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.fetch(spark, warc.index_of(spark, warc.write(spark, pages))).collect() == []


@pytest.mark.parametrize("zip64", [False, True])
def test_directories(zip64):
    out = Kept()
    writer = warc.ZipWriter(out, zip64)
    writer.member("a", [b"12", b"3"])
    writer.member("bé/c", [])
    writer.close()
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        assert archive.read("a") == b"123" and archive.read("bé/c") == b""
    members = warc.directory(Bytes(data))
    assert data[members["a"].offset :][: members["a"].size] == b"123" and members["bé/c"].size == 0


def test_archives_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.comment = b"PK\x05\x06 is no end" + b"!" * 40
        with archive.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as file:
            file.write(b"hello")
        archive.writestr(zipfile.ZipInfo("packed"), b"z" * 99, zipfile.ZIP_DEFLATED)
    members = warc.directory(Bytes(out.getvalue()))
    assert out.getvalue()[members["big"].offset :][:5] == b"hello"
    assert members["big"].stored and not members["packed"].stored
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.directory(Bytes(b"nothing"))


UUID = "<urn:uuid:0d8b6c1e-7a34-4c55-9d3c-1f6f0f4b7a11>"


def foreign(kind, block, *fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {UUID}", *fields, f"content-length:{len(block)}"]
    return warc.gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


HTTP = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"


@pytest.mark.parametrize("form", ["cdxj", "cdx", "cdxj.gz"])
def test_members_and_indexes_of_others(spark, tmp_path, form):
    first = [foreign("warcinfo", b"software: x"), foreign("response", HTTP, "WARC-Target-URI: http://a/", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{warc.base32_sha1(b'hello')}")]
    second = [foreign("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Target-URI: http://b/", "Content-Type: application/http", f"WARC-Refers-To: {UUID}"), foreign("resource", b"raw", "Content-Type: text/plain")]
    members = {"one.warc.gz": first, "two.warc.gz": second}
    lines = []
    for name, parts in members.items():
        offset = 0
        for part in parts:
            json_part = warc.json.dumps({"url": "http://a/", "filename": name, "offset": str(offset), "length": str(len(part))})
            lines.append(f"com,a)/ 20240102030405 http://a/ text/html 200 X - - {len(part)} {offset} {name}" if form == "cdx" else f"com,a)/ 20240102030405 {json_part}")
            offset += len(part)
    text = "\n".join([" CDX N b a m s k r M S V g"] * (form == "cdx") + lines[::-1]).encode()
    path = tmp_path / "other.wacz"
    with zipfile.ZipFile(path, "w") as archive:
        for name, parts in members.items():
            archive.writestr(f"archive/{name}", b"".join(parts))
        archive.writestr(f"indexes/main.{form}", warc.gzip.compress(text) if form.endswith("gz") else text, zipfile.ZIP_DEFLATED)
    manifest = spark.createDataFrame([(path.as_uri(), 4)], "archive string, n_records long")
    rows = warc.fetch(spark, warc.index_of(spark, manifest)).collect()
    found = sorted(((r.record_type, r.record_id, r.page_id, r.url, r.payload_bytes, r.refers_to_id, r.payload) for r in rows), key=repr)
    assert found == [
        ("resource", UUID, None, None, 3, None, b"raw"), ("response", UUID, None, "http://a/", 5, None, b"hello"),
        ("revisit", UUID, None, "http://b/", None, UUID, None), ("warcinfo", UUID, None, None, 11, None, b"software: x"),
    ]


def test_damage_of_others_is_found():
    with pytest.raises(ValueError, match="damaged payload"):
        warc.parse(foreign("response", HTTP, "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{warc.base32_sha1(b'other')}"))
    with pytest.raises(ValueError, match="damaged block"):
        warc.parse(foreign("resource", b"raw", f"WARC-Block-Digest: sha256:{'0' * 64}"))


def test_damage_is_found():
    data = warc.record(1, "u", b"payload", None)
    assert warc.parse(data)["payload"] == b"payload"
    head = warc.zlib.decompress(data, 31).replace(b"payload\r\n", b"playoad\r\n")
    packer = warc.zlib.compressobj(6, warc.zlib.DEFLATED, 31)
    with pytest.raises(ValueError, match="damaged payload"):
        warc.parse(packer.compress(head) + packer.flush())


def test_query(spark):
    table = pq.read_table(f"{SMALL}/pages.parquet").to_pydict()
    rows = list(zip(table["page_id"], table["url"], table["html"]))
    assert sorted(map(tuple, warc.op2_warc(spark, SMALL).collect()), key=repr) == expected(rows)
