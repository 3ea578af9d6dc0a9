import re

import duckdb
import pytest
from conftest_llm import SMALL

from rowferry.llm import decontamination

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)] if n else []
    found = []
    for doc, text in docs:
        w = words(text)
        hit, matched = set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    matched.add(str(item))
        found.append((doc, len(w), len(hit), sorted(matched), bool(hit)))
    return sorted(found, key=repr)


ALPHABET = [f"w{i}" for i in range(40)]
LONG = " ".join(ALPHABET[:25])
ITEMS = [
    (1, LONG), (2, LONG.upper()), (3, "one two three"), (4, "seven words are in this short item"), (10, None), (11, " ... "), (12, "la " * 15),
    (13, "Só é"), (14, "nine words that stand in one row of text"),
]
DOCS = [
    (1, LONG), (2, "x " + " ".join(ALPHABET[3:13]) + " y"), (3, " ".join(ALPHABET[3:12]) + " y"), (4, "One, two; THREE! four"), (5, None), (6, ""), (7, "la " * 40),
    (8, "só é"), (9, "so e"), (None, "one two three"), (4, "other text of one number"), (1, LONG), (20, "nine words that stand in one row of text " * 3),
    (21, "seven words are in this short item " + " ".join(ALPHABET[10:25])), (22, "pre " * 3000 + " ".join(ALPHABET[5:16]) + " post" * 3000),
    (23, "".join(map(chr, range(1, 128))) + "one\u0000two\u0000three \u0080\u00a0\u2003x"),
]


def found(df):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()], key=repr)


def bench(spark, items):
    return spark.createDataFrame([(i, text, "w") for i, text in items], "item_id long, text string, words string")


@pytest.mark.parametrize("size", [1 << 25, 0], ids=["broadcast", "shuffled"])
def test_hits(spark, documents, monkeypatch, size):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", size)
    assert found(decontamination.contamination(spark, documents(DOCS), bench(spark, ITEMS))) == expected(DOCS, ITEMS)


def test_items_without_id_hit_but_have_no_name(spark, documents):
    rows = found(decontamination.contamination(spark, documents([(1, "one two three"), (2, "two"), (3, "four five")]), bench(spark, [(None, "two"), (7, "four five")])))
    assert rows == [(1, 3, 1, [], True), (2, 1, 1, [], True), (3, 2, 2, ["7"], True)]


def test_empty_tables(spark, documents):
    assert found(decontamination.contamination(spark, documents([]), bench(spark, ITEMS))) == []
    assert found(decontamination.contamination(spark, documents(DOCS), bench(spark, []))) == expected(DOCS, [])


def test_clean_documents_stay(spark, documents):
    kept = decontamination.without_benchmark(spark, documents(DOCS), bench(spark, ITEMS))
    assert kept.columns == documents([]).columns
    clean = [doc for doc, *_, hit in expected(DOCS, ITEMS) if not hit]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_query(spark):
    df = decontamination.op1_benchmark_decontamination(spark, SMALL)
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    wanted = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({decontamination.ORACLE})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(wanted)
