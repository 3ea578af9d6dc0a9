import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest_llm import SMALL, sha256
from pyspark.sql import functions as F

from rowferry.llm import suffix_dedup


def expected(rows):
    rows = [(i, (text or "").encode()) for i, text in rows]
    rank = lambda i: -(2**63) if i is None else i
    first = {}
    for i, data in rows:
        for at in range(len(data) - 99):
            string = data[at : at + 100]
            first[string] = min(first.get(string, (rank(i), at)), (rank(i), at))
    found = []
    for i, data in rows:
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            if first[data[at : at + 100]] < (rank(i), at):
                gone[at : at + 100] = b"\1" * 100
        spans = sum(1 for at in range(len(data)) if gone[at] and not (at and gone[at - 1]))
        found.append((i, len(data), sum(gone), spans, sha256(bytes(b for b, g in zip(data, gone) if not g))))
    return sorted(found, key=repr)


def copied_texts(seed=3):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcdefgh é") for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(100):
        text = ""
        for _ in range(draw.randrange(5)):
            at = draw.randrange(300)
            text += draw.choice(base)[at : at + draw.randrange(60, 300)] + "".join(draw.choice("xyz ") for _ in range(draw.randrange(30)))
        rows.append((i * 7 % 100, text))
    return rows


ROWS = copied_texts() + [
    (200, "a" * 99), (201, "a" * 100), (202, "a" * 101), (203, "a" * 350), (204, "ab" * 120), (205, "abcde " * 60 + "q" + "abcde " * 30), (206, None), (207, ""), (207, ""),
    (None, "q" * 50 + copied_texts()[3][1]), (208, copied_texts()[3][1]), (208, copied_texts()[3][1]), (208, "!" + copied_texts()[4][1]),
]


def removed(df):
    found = df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize(("size", "hot"), [(1 << 23, 200), (2_000, 200), (2_000, 3)])
def test_removal(spark, documents, monkeypatch, size, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", size)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", size)
    assert removed(suffix_dedup.without_repeats(spark, documents(ROWS))) == expected(ROWS)


def test_no_rows(spark, documents):
    assert removed(suffix_dedup.without_repeats(spark, documents([]))) == []


def test_long_texts_go_in_parts(monkeypatch):
    texts = [b"abc" * 10, bytes(random.Random(1).choices(b"abcd", k=2_000)), b"", b"z" * 700, b"short"]
    whole = [np.concatenate(c) for c in zip(*suffix_dedup._block_runs(texts))]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    parts = [np.concatenate(c) for c in zip(*suffix_dedup._block_runs(texts))]

    def strings(runs):
        return {(int(t), int(s) + k, int(p)) for p, t, s, c, _ in zip(*runs) for k in range(int(c))}

    assert strings(whole) == strings(parts)
    assert len(strings(whole)) == sum(max(0, len(t) - 99) for t in texts)


@pytest.mark.parametrize("length", [4, 5, 37, 100])
def test_buckets_are_equal_strings(length):
    data = random.Random(length).choices(b"ab", k=60) * 9 + list(b"x" * 130)
    buckets = suffix_dedup.string_buckets(np.array(data, np.uint8), length)
    n = len(data) - length + 1
    strings = [bytes(data[i : i + length]) for i in range(n)]
    assert len(set(zip(strings, buckets[:n].tolist()))) == len(set(strings)) == len(set(buckets[:n].tolist()))


def test_query(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert sorted(map(tuple, suffix_dedup.op4_suffix_dedup(spark, SMALL).collect()), key=repr) == expected(list(zip(table["doc_id"], table["text"])))
