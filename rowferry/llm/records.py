"""Token ids as length-delimited binary records with masked checksums and an offset index.

A record file is a run of frames, as little-endian numbers::

    length u64 | masked crc32 of the length u32 | payload | masked crc32 of the payload u32

A payload is a flag byte (bit 0: ids of four bytes instead of two; bit 1: the
document has no identifier), the document's identifier as i64 and the ids. The
index beside it holds one u64 pair per record: its offset, and the number of
ids before it in the file, so that records can be read in any order.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import attrgetter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowferry.llm.files import create, fresh_name, opened, shared_uri
from rowferry.llm.recent import Recent
from rowferry.llm.scratch import stored
from rowferry.plans.session import ship_package

#: Text bytes meant for one writing task, and bytes after which a task starts a new file.
TASK_BYTES, FILE_BYTES = 32 << 20, 64 << 20
#: Pieces of text in a generation of a worker's memory, and bytes whose pieces are looked up together.
CACHED_PIECES, BATCH_BYTES = 250_000, 4 << 20

_TOKEN_ID = attrgetter("id")

_HEAD, _CRC, _META, _ENTRY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq"), struct.Struct("<QQ")

MANIFEST = "task int, part int, data string, index string, n_docs bigint, n_ids bigint"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    payload = _META.pack(wide | (doc_id is None) << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + _CRC.pack(masked_crc(length)) + payload + _CRC.pack(masked_crc(payload))


def unframe(data: memoryview, offset: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record at offset and where the next one begins; ValueError if a checksum is wrong."""
    length, crc = _HEAD.unpack_from(data, offset)
    if crc != masked_crc(data[offset : offset + 8]):
        raise ValueError(f"damaged length at {offset}")
    start = offset + _HEAD.size
    payload = data[start : start + length]
    if len(payload) != length or _CRC.unpack_from(data, start + length)[0] != masked_crc(payload):
        raise ValueError(f"damaged record at {offset}")
    flags, doc_id = _META.unpack_from(payload)
    ids = np.frombuffer(payload[_META.size :], "<u4" if flags & 1 else "<u2").astype("<u4")
    return None if flags & 2 else doc_id, ids, start + length + _CRC.size


class LibraryEncoder:
    """Ids by the tokenizers library. Its file drops white space and ends a run of letters before
    any other character, so a text is encoded piece by piece between spaces and line breaks and
    from a letter or digit to punctuation, and pieces seen lately are remembered as bytes of ids.
    Each different piece of a batch is looked at once. As the file also lower-cases, after composing
    characters, they are looked up in lower case. Special tokens are matched before that, so
    pieces that may hold one keep their case, and no piece ends at a character that one has."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        special = {token.content: number for number, token in added.items() if token.special}
        self.between, self.between_id = next(iter(special.items()), (None, None))
        # Whether the file leaves small letters as they are and merges each word by itself.
        words, merge = ["of", "plain", "words"], self.tokenizer.model.tokenize
        whole = self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        self.direct = self.tokenizer.pre_tokenizer is not None and whole == [token.id for word in words for token in merge(word)]
        self.kinds = _byte_kinds("".join(token.content for token in added.values()))
        self.recent = Recent(CACHED_PIECES, self._find)

    def _find(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of small letters go straight to the library's merges, by the symbols that its file cuts from them;
        others through all of its steps, many at a time with a special token between; those that may hold one, alone."""
        words = [piece for piece in pieces if piece.isalpha() and piece.islower() and (piece.isascii() or max(piece) < "\u0250")] if self.direct else []
        others = set(pieces).difference(words)
        alone = [piece for piece in others if "<" in piece or self.between is None]
        others = list(others.difference(alone))
        for at in range(0, len(words), 2_000):
            part, merge, cut = words[at : at + 2_000], self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
            foreign = [word for word in part if not word.isascii()]
            symbols = {word: cuts[0] for word, cuts in zip(foreign, cut(" ".join(foreign)), strict=True)}
            tokens = [merge(symbols.get(word, word)) for word in part]
            data = np.fromiter(map(_TOKEN_ID, chain.from_iterable(tokens)), np.uint32).tobytes()
            ends = [4 * n for n in accumulate(map(len, tokens))]
            yield from ((piece, data[start:end]) for piece, start, end in zip(part, [0, *ends], ends))
        for at in range(0, len(others), 2_000):
            part = others[at : at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([self.between.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.between_id)
            if len(cuts) + 1 != len(part):
                raise ValueError("pieces and ids do not match")
            data = ids.tobytes()
            yield from ((piece, data[start:end]) for piece, start, end in zip(part, [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)]))
        for at in range(0, len(alone), 2_000):
            part = alone[at : at + 2_000]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            yield from ((piece, np.array(one.ids, np.uint32).tobytes()) for piece, one in zip(part, found))

    def encode_batch(self, texts: pa.Array | list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text; null counts as empty."""
        texts = texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = texts.fill_null("") if texts.null_count else texts
        if not len(texts):
            return
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(texts):
            upto = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + BATCH_BYTES, "right")) - 1)
            yield from self._encode(data[ends[start] : ends[upto]], ends[start : upto + 1] - ends[start])
            start = upto

    def _encode(self, data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of the texts between these ends."""
        pieces, upto = self._pieces(data, ends)
        coded = pieces.dictionary_encode()
        different = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        joined = pc.binary_join(different, " ")[0].as_py()  # no piece holds a space, and none is empty
        keys = [_key(*both) for both in zip(joined.split(" "), joined.lower().split(" "), strict=True)] if joined else []
        found = self.recent.values(keys)
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32))), pa.array(np.frombuffer(b"".join(found), np.uint32)))
        taken = lists.take(coded.indices)
        ids, places = taken.values.to_numpy(), taken.offsets.to_numpy()[upto]
        for start, end in zip(places[:-1].tolist(), places[1:].tolist()):
            yield ids[start:end]

    def _pieces(self, data: np.ndarray, ends: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """All pieces of the texts, and the number of them before each text and after the last."""
        kinds = self.kinds[data]
        kept = (kinds & _SPACE) == 0
        begins = np.zeros(len(data) + 1, bool)
        begins[ends] = True
        begins = begins[:-1]
        begins[1:] |= ~kept[:-1]
        closes = (kinds & _LETTER) != 0
        # The second byte of another Latin letter.
        closes[1:] |= ((kinds[:-1] & _LEAD) != 0) & ((kinds[1:] & _SIGN) == 0)
        begins[1:] |= closes[:-1] & ((kinds[1:] & _STOP) != 0)
        begins &= kept
        upto = np.searchsorted(np.flatnonzero(begins), ends)
        letters = data[kept]
        places = np.append(np.flatnonzero(begins[kept]), len(letters)).astype(np.int32)
        return pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(letters)), upto


#: Kinds of bytes: between pieces; ASCII letters and digits; a sign that ends their run; the first of two bytes up to U+023F, all
#: letters but two; the second byte of those two, the signs for times and divided by, and of a letter whose lower case ends in a mark.
_SPACE, _LETTER, _STOP, _LEAD, _SIGN = 1, 2, 4, 8, 16


def _byte_kinds(special: str) -> np.ndarray:
    """The kinds of each byte; what special tokens have ends no run."""
    kinds = np.zeros(256, np.uint8)
    kinds[[ord(c) for c in " \n"]] = _SPACE
    kinds[[ord(c) for c in string.ascii_letters + string.digits]] = _LETTER
    kinds[[ord(c) for c in string.punctuation if c not in special]] = _STOP
    kinds[0xC3:0xC9] = _LEAD
    kinds[[0x97, 0xB7, 0xB0]] = _SIGN
    return kinds


def _key(piece: str, lowered: str) -> str:
    """The piece as it is looked up: in lower case, if that leaves the library's ids as they are."""
    if piece == lowered or "<" in piece:
        return piece  # lowering must not make a special token of it
    # A final sigma has a lower case of its own in Python only; and composing must come to nothing either way.
    return lowered if piece.isascii() or "Σ" not in piece and is_normalized("NFC", piece) and is_normalized("NFC", lowered) else piece


@lru_cache(maxsize=4)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


class _Writer:
    """One record file and its index."""

    def __init__(self, folder: str):
        self.data_uri = fresh_name(folder, ".rec")
        self.index_uri = self.data_uri + ".idx"
        self.data, self.index = create(self.data_uri), create(self.index_uri)
        self.offset = self.n_docs = self.n_ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        record = frame(doc_id, ids)
        self.data.write(record)
        self.index.write(_ENTRY.pack(self.offset, self.n_ids))
        self.offset, self.n_docs, self.n_ids = self.offset + len(record), self.n_docs + 1, self.n_ids + len(ids)

    def close(self, task: int, part: int) -> tuple:
        self.data.close()
        self.index.close()
        return task, part, self.data_uri, self.index_uri, self.n_docs, self.n_ids


def write(spark: SparkSession, docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all documents in ascending doc_id order; return the manifest with each file's ``start``.

    Null texts are encoded as empty; null identifiers come first. Rows with
    equal identifiers are ordered by text. Other columns are not read. The
    manifest is a table in the shared folder: MANIFEST and start, the number of
    ids in all files before.
    """
    ship_package(spark)
    folder = shared_uri(spark, "records")
    texts = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = texts.repartitionByRange(max(1, -(-total // TASK_BYTES)), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        encoder, task, done, writer = library_encoder(path), TaskContext.get().partitionId(), [], None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_batch(batch.column(1))):
                writer = writer or _Writer(folder)
                writer.add(doc_id, np.concatenate([ids, end]))
                if writer.offset >= FILE_BYTES:
                    done.append(writer.close(task, len(done)))
                    writer = None
        if writer:
            done.append(writer.close(task, len(done)))
        schema = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("data", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in done], schema=schema)

    files, _ = stored(spark, ordered.mapInArrow(run, MANIFEST), "record-files")
    # A row per file, not per document.
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All records by file, checksums checked: doc_id, start, ids."""
    ship_package(spark)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["data"]) as file:
                    data = memoryview(file.read())
                offset, start, rows, size = 0, row["start"], [], 0
                while offset < len(data):
                    doc_id, ids, offset = unframe(data, offset)
                    rows.append((doc_id, start, ids))
                    start, size = start + len(ids), size + len(ids)
                    if size > 1_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = manifest.select("data", "start").repartition(max(1, spark.sparkContext.defaultParallelism), "data")
    return files.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def read_shuffled(spark: SparkSession, manifest: DataFrame, seed: int) -> DataFrame:
    """All records in an order drawn by seed, each read by its range: doc_id, start, ids.

    The order is that of a hash of file, place and seed, over all files.
    """
    ship_package(spark)

    def entries(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["index"]) as file:
                    pairs = np.frombuffer(file.read(), "<u8").reshape(-1, 2)
                with opened(row["data"]) as file:
                    ends = np.append(pairs[1:, 0], file.size())[: len(pairs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["data"]] * len(pairs)), pa.array(pairs[:, 0].astype(np.int64)), pa.array(ends.astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64) + row["start"])],
                    names=["data", "offset", "end", "start"],
                )

    def fetch(batches):
        for batch in batches:
            files: dict = {}
            rows, size = [], 0
            for row in batch.to_pylist():
                file = files.get(row["data"])
                if file is None:
                    if len(files) >= 64:
                        files.popitem()[1].close()
                    file = files[row["data"]] = opened(row["data"])
                doc_id, ids, _ = unframe(memoryview(file.read_at(row["end"] - row["offset"], row["offset"])))
                rows.append((doc_id, row["start"], ids))
                size += len(ids)
                if size > 1_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)
            for file in files.values():
                file.close()

    index = manifest.select("data", "index", "start").mapInArrow(entries, "data string, offset bigint, end bigint, start bigint")
    drawn = F.xxhash64("data", "offset", F.lit(seed))
    n = max(1, spark.sparkContext.defaultParallelism)
    return index.withColumn("_drawn", drawn).repartitionByRange(n, "_drawn").sortWithinPartitions("_drawn").drop("_drawn").mapInArrow(
        fetch, "doc_id bigint, start bigint, ids binary"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].tobytes() for r in rows], pa.binary())],
        names=["doc_id", "start", "ids"],
    )


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write(spark, docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read(spark, manifest).select(
        "doc_id", "start", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
