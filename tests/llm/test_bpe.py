import random

import pyarrow.parquet as pq
import public_tokenizers
import pytest
from conftest_llm import SMALL, sha256
from tokenizers import Tokenizer

from rowferry.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def by_library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def random_texts():
    draw = random.Random(5)
    letters = "aeiou thnqz'S.,!0 \n\tÉßñжΣ日😀"
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(120))) for _ in range(400)]


ODD = [
    "", None, "a" * 3000, "x" * 70 + "y" * 64, "<|endoftext|> a<|startoftext|>b <|endoftext|", "ΑΣ Σ ΣΑΣ.", "İstanbul'S 're 12 ½", "é é", "'s 'S it's!!", "the " * 5000,
    "  　\x85 a b",
]


def test_same_as_the_library():
    vocab = bpe.Vocabulary(PATH)
    for text, ids in zip(ODD + random_texts(), vocab.encode_batch(ODD + random_texts()), strict=True):
        wanted, decoded = by_library(text)
        assert ids.tolist() == wanted, text
        assert vocab.decode(ids.tolist()) == decoded


def test_every_code_point():
    """Between letters, numbers, spaces and marks; the library's Unicode tables are later than Python's."""
    vocab = bpe.Vocabulary(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b {chr(c)}1{chr(c)} {chr(c)}." for c in points[at : at + 20_000]]
        wanted = LIBRARY.encode_batch(texts, add_special_tokens=False)
        assert not [text for text, ids, other in zip(texts, vocab.encode_batch(texts), wanted, strict=True) if ids.tolist() != other.ids]


def test_long_words_are_not_remembered():
    vocab = bpe.Vocabulary(PATH)
    texts = ["w" * 300 + " short " + "w" * 300, "w" * 300]
    assert [ids.tolist() for ids in vocab.encode_batch(texts)] == [by_library(text)[0] for text in texts]
    assert max(map(len, vocab.recent.held)) <= bpe.WIDEST


def test_long_texts_go_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_CHARS", 50)
    vocab = bpe.Vocabulary(PATH)
    texts = ["some words " * 30 + "<|endoftext|>" + "and more " * 9, "short", "", "w" * 300]
    assert [ids.tolist() for ids in vocab.encode_batch(texts)] == [by_library(text)[0] for text in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    monkeypatch.setattr(bpe, "BATCH_CHARS", 200)
    vocab = bpe.Vocabulary(PATH)
    texts = random_texts()
    assert [ids.tolist() for ids in vocab.encode_batch(texts)] == [by_library(text)[0] for text in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 65, 200])
def test_both_ways_of_merging_agree(n):
    vocab = bpe.Vocabulary(PATH)
    draw = random.Random(n)
    word = "".join(draw.choice("thean") for _ in range(n))
    symbols = [int(vocab.inner[b]) for b in word.encode()]
    symbols[-1] = int(vocab.last[word.encode()[-1]])
    import numpy as np

    leaves = 1 << (n - 1).bit_length()
    row = np.array([symbols + [0] * (leaves - n)])
    assert vocab.merge_rows(row, np.array([n]))[0] == vocab.merge_long(list(symbols)) == np.array(by_library(word)[0], np.int32).tobytes()


def test_tables(spark, documents):
    rows = list(enumerate(ODD)) + [(None, "x"), (0, ""), (0, "")]
    back = bpe.decode(spark, bpe.encode(spark, documents(rows), PATH, ("doc_id", "digest")), PATH)
    assert back.columns == ["doc_id", "digest", "ids", "decoded"]
    wanted = sorted([(i, *by_library(text)) for i, text in rows], key=repr)
    assert sorted([(r.doc_id, r.ids, r.decoded) for r in back.collect()], key=repr) == wanted
    assert bpe.decode(spark, bpe.encode(spark, documents([]), PATH), PATH).count() == 0
    both = bpe.encode(spark, documents(rows), PATH, ("doc_id", "digest"), decoded=True)
    assert both.columns == back.columns and sorted(map(repr, both.collect())) == sorted(map(repr, back.collect()))


def test_query(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    wanted = []
    for i, text in zip(table["doc_id"], table["text"]):
        ids, decoded = by_library(text)
        wanted.append((i, len(ids), sha256(" ".join(map(str, ids))), sha256(decoded)))
    assert sorted(map(tuple, bpe.op3_bpe(spark, SMALL).collect())) == sorted(wanted)
