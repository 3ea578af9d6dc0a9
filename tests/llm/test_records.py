import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest_llm import SMALL
from tokenizers import Tokenizer

from rowferry.llm import bpe, records
from rowferry.llm.recent import Recent

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(rows):
    found, start = [], 0
    for i, text in sorted(rows, key=lambda row: (row[0] is not None, row[0] or 0, (row[1] or "").encode())):
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]
        found.append((i, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return found


ROWS = [(3, "Hello, World"), (1, None), (2, ""), (None, "no id"), (5, "b"), (5, "a"), (5, "a"), (9, "it's <|endoftext|> é <b>\t x y " * 3000), (7, "z" * 5000)]


@pytest.mark.parametrize("size", [64 << 20, 100])
def test_round_trip(spark, documents, monkeypatch, size):
    monkeypatch.setattr(records, "TASK_BYTES", size)
    manifest = records.write(spark, documents(ROWS).repartition(4), PATH, end_id=1)
    by_start = lambda rows: sorted(map(tuple, rows), key=lambda row: row[1])
    assert by_start(records.read(spark, manifest).collect()) == expected(ROWS)
    drawn = records.read_shuffled(spark, manifest, seed=5).collect()
    assert by_start(drawn) == expected(ROWS)
    assert drawn == records.read_shuffled(spark, manifest, seed=5).collect()


def test_special_tokens_are_matched_in_the_raw_text(spark, documents):
    spelled = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|StartOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>"]
    texts = [*spelled, *[f"Hello{word}World, É <B>X.Y {word}. {word}\n{word.replace('>', ' >')}" for word in spelled], " ".join(spelled), "Σ É <|EndOfText|> e\u0301", "<|Endo.ftext|> <|END,OFTEXT|>"]
    rows = list(enumerate(texts))
    assert sorted(map(tuple, records.read(spark, records.write(spark, documents(rows), PATH, end_id=1)).collect())) == expected(rows)
    encoded = bpe.vocabulary(PATH).encode_batch(texts)
    assert [ids.tolist() for ids in records.library_encoder(PATH).encode_batch(texts)] == [ids.tolist() for ids in encoded]


def test_each_word_is_encoded_once():
    """Whatever its case and the sign behind it; texts with a sign each were looked up one by one."""
    words, signs = ["plain", "größe", "été", "x9"], list("!\"#$%&'()*+,-./:;=?@[]^_`{}~")
    texts = [f"{form}{sign}" for word in words for sign in signs for form in (word, word.upper().replace("SS", "ẞ"), word.title())]
    encoder = records.LibraryEncoder(PATH)
    assert [ids.tolist() for ids in encoder.encode_batch(texts)] == [LIBRARY.encode(text, add_special_tokens=False).ids for text in texts]
    assert len(encoder.recent.held) <= len(words) + len(signs)


@pytest.mark.parametrize("size", [1, 300, 4 << 20])
def test_pieces_end_where_the_library_ends_them(monkeypatch, size):
    """Every code point of two bytes and some of more, before and behind letters, signs, marks and white space."""
    monkeypatch.setattr(records, "BATCH_BYTES", size)
    points = [*map(chr, range(1, 0x800)), *"\u1e96\u1e9e\u2028\u2126\u212a\u212b\u226e\u3000\u4e2d\uac00\ufb03\ufeff\U0001f642"]
    texts = [f"x{c}, {c}'s.\n{c}\u0338=<{c}>A{c}-\u0301\tÉ{c}É(1{c}{c}! <|endoftext|>{c}. <|EndOfText|>{c}?" for c in points] + [None, "", " \n "]
    wanted = [LIBRARY.encode(text or "", add_special_tokens=False).ids for text in texts]
    for given in (texts, pa.array(["left", "out", *texts, "and this"]).slice(2, len(texts)), pa.array(texts, pa.large_string())):
        assert [ids.tolist() for ids in records.LibraryEncoder(PATH).encode_batch(given)] == wanted


def test_without_direct_merges_the_ids_are_the_same():
    texts = ["Hello, wide World. größe", "It's <|endoftext|> É!"]
    encoder = records.LibraryEncoder(PATH)
    assert encoder.direct
    encoder.direct = False
    assert [ids.tolist() for ids in encoder.encode_batch(texts)] == [LIBRARY.encode(text, add_special_tokens=False).ids for text in texts]


def test_no_rows(spark, documents):
    assert records.read(spark, records.write(spark, documents([]), PATH, end_id=1)).collect() == []


def test_damage_is_found():
    data = records.frame(7, np.array([1, 70_000], np.uint32)) + records.frame(None, np.array([5], np.uint32))
    doc, ids, end = records.unframe(memoryview(data))
    assert (doc, ids.tolist()) == (7, [1, 70_000])
    assert records.unframe(memoryview(data), end)[:2] == (None, np.array([5]))
    for at in (0, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            records.unframe(memoryview(bytes(bad)), records.unframe(memoryview(bytes(bad)))[2])


def test_masked_checksum():
    crc = zlib.crc32(b"abc")
    assert records.masked_crc(b"abc") == (((crc >> 15 | crc << 17) & 0xFFFFFFFF) + 0xA282EAD8) % 2**32


def test_memory_of_two_generations():
    asked = []

    def find(keys):
        asked.extend(keys)
        return ((k, k * 2) for k in keys)

    recent = Recent(3, find)
    for keys in ([1, 2, 3, 4], [1, 5], [1, 6, 7], [5, 2], [2, 8, 9, 10], [1]):
        known = recent.know(keys)
        assert [known[k] for k in keys] == [2 * k for k in keys]
        assert len(recent.held) + len(recent._old) <= 12
    assert len(asked) < 16


def test_values_ask_once():
    asked = []

    def find(keys):
        asked.extend(keys)
        return ((k, k * 2) for k in keys)

    recent = Recent(3, find)
    for keys in ([1, 2, 3, 4], [4, 1, 5, 5], [6, 1, 7, 1], []):
        assert recent.values(keys) == [2 * k for k in keys]
    assert sorted(asked) == [1, 2, 3, 4, 5, 6, 7]


def test_query(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    wanted = [(i, start, len(ids) // 4, zlib.crc32(ids)) for i, start, ids in expected(list(zip(table["doc_id"], table["text"])))]
    assert sorted(map(tuple, records.op8_token_records(spark, SMALL).collect())) == wanted
