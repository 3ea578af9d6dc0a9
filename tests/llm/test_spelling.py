import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import SMALL
from pyspark.sql import functions as F

from rowferry.llm import spelling
from rowferry.llm.fm_index import WordIndex, sorted_rotations


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {word: n for word, n in found.items() if len(word) >= 7 and n >= 2}


def expected(rows):
    words = counted(rows)
    spread = {}
    for word in words:  # words one edit apart share one of these
        for key in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
            spread.setdefault(key, []).append(word)
    beside = {word: set() for word in words}
    for group in spread.values():
        for a in group:
            beside[a].update(b for b in group if a != b and near(a, b))
    forms = {}
    for word, others in beside.items():
        best = min(others, key=lambda b: (-words[b], b), default=None)
        if best and words[best] >= 10 * words[word]:
            forms[word] = best

    def last(word):
        return last(forms[word]) if word in forms else word

    return sorted((w, forms.get(w), last(w), n, len(beside[w]), words.get(forms.get(w))) for w, n in words.items())


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()))


def made_words(rng, letters, count):
    return {"".join(rng.choice(letters) for _ in range(rng.choice([7, 8, 9, 11]))) for _ in range(count)}


def odd_rows():
    rng = random.Random(5)
    rows = [(None, "Spelling Spelling spelling"), (None, None), (1, None), (2, ""), (2, "x" * 3_000 + " " + "x" * 2_999), (3, "x" * 3_000 + " " + "x" * 2_999 + " - " * 300_000)]
    rows += [(i, " ".join(rng.choices(sorted(made_words(rng, "abé", 9)), k=30))) for i in range(4, 30)]
    rows += [(30, "variant " * 3 + "variants " * 40 + "variantes " * 500), (30, "variant " * 3), (31, "×÷Àßÿabc, ×÷Àßÿabc Ābcdefgh Ābcdefgh")]
    rows += [(i, "colouring coloring the_colouring l'accessoire ACCESSOIRE 4colouring") for i in range(40, 60)]
    return rows


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgé"])
def test_searches(letters):
    rng = random.Random(1)
    index = WordIndex([w.encode("latin-1") for w in made_words(rng, letters, 200)])
    every = np.arange(len(index.words))
    found = [{(index.words[i], index.words[j]) for i, j in zip(*index.one_edit(every, suffix))} for suffix in (False, True)]
    assert found[0] | found[1] == {(a, b) for a in index.words for b in index.words if a != b and near(a, b)}


def test_rotations():
    text = np.frombuffer(b"\0abracad\0abrac\0abra\0abracadabra", np.uint8)
    doubled = bytes(text) * 2
    assert sorted_rotations(text).tolist() == sorted(range(len(text)), key=lambda i: doubled[i : i + len(text)])


@pytest.mark.parametrize("most", [spelling.BUCKET, 2])
def test_pairs_in_split_buckets(spark, most):
    words = sorted(made_words(random.Random(2), "ab", 120) | {"counterpart" + "abcdef"[i % 6] * 2 + "xyz"[i % 3] + "suffix" for i in range(18)})
    vocabulary = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, n long")
    pairs = {(r.word, r.n, r.near, r.near_n) for r in spelling.near_words(spark, vocabulary, most).collect()}
    at = {w: i + 2 for i, w in enumerate(words)}
    assert pairs == {(a, at[a], b, at[b]) for a in words for b in words if a != b and near(a, b)}


def test_buckets_are_bounded(spark):
    words = ["interna" + a + b + c + "tional" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"]
    rows = spelling.buckets(spark, spark.createDataFrame([(w, 2) for w in words], "word string, n long"), most=12)
    assert rows.groupBy("bucket").count().agg(F.max("count")).first()[0] <= 6 + 6 * 6  # a letter or two at one place


def test_odd_texts(spark, documents):
    rows = odd_rows()
    assert got(spelling.variants(spark, documents(rows))) == expected(rows)


def test_no_rows(spark, documents):
    assert got(spelling.variants(spark, documents([]))) == []


def test_ways_to_the_root(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("a", "w8")], "word string, form string")
    assert {(r.word, r.root) for r in spelling.roots(spark, forms).collect()} == {(f"w{i}", "w9") for i in range(9)} | {("a", "w9")}


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spelling.op12_spelling_variants(spark, SMALL)) == expected(rows)
