import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest_llm import SMALL
from pyspark.sql import functions as F

from rowferry.llm import components as comp
from rowferry.llm import ngram_join, signature_trees
from rowferry.llm.scratch import stored
from rowferry.llm.words import shingles, word_lists

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def expected(rows):
    sets = [shingle_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min((d for d in (least.get(find(i)), doc) if d is not None), default=None)
    return sorted([(doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows)], key=repr)


def near_copies(seed=4):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    bases = [[draw.choice(words) for _ in range(draw.choice([6, 12, 60, 200]))] for _ in range(8)]
    rows = []
    for i in range(150):
        text = list(draw.choice(bases[:4] if i % 3 else bases))
        for _ in range(draw.randrange(5)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((1000 - i, " ".join(text)))
    return rows


ROWS = near_copies() + [
    (1, "a b c"), (2, "A  b\nc"), (3, "a b c d"), (4, None), (5, ""), (6, " \n"), (7, "one"), (7, "one"), (None, "one"), (8, "the " * 9000), (9, "the " * 50),
    (10, " x y"), (11, " X Y"), (12, "É a b c d e f"), (13, "é a b c d e f"), (None, "alone here"),
]


def joined(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("pieces", [100, 7])
def test_components(spark, documents, monkeypatch, pieces):
    monkeypatch.setattr(ngram_join, "PIECE_SETS", pieces)
    monkeypatch.setattr(ngram_join, "RANGE_SHINGLES", 1_000)
    assert joined(ngram_join.join(spark, documents(ROWS).repartition(5))) == expected(ROWS)


def test_sets_without_links_are_not_sent_to_all_pieces(spark, documents, monkeypatch):
    n, seen = 5_000, {}
    tiles, across = ngram_join._tiles, ngram_join._links_across

    def count_tiles(outside, roots):
        seen["tiles"] = tiles(outside, roots).count()
        return tiles(outside, roots)

    def count_across(rows):
        seen["across"] = rows.count()
        return across(rows)

    monkeypatch.setattr(ngram_join, "_tiles", count_tiles)
    monkeypatch.setattr(ngram_join, "_links_across", count_across)
    rows = [(i, f"all have these six words here x{i} y{i}") for i in range(n)]
    rows += [(n + i, f"all have these six words here x{7 * i} y{7 * i} z") for i in range(5)]  # four of five shingles
    found = {r[0]: r[2] for r in joined(ngram_join.join(spark, documents(rows)))}
    assert found == {**{i: i for i in range(n)}, **{n + i: 7 * i for i in range(5)}}
    assert 0 < seen["tiles"] < 3 * n and 0 < seen["across"] < 3 * n


def test_sets_without_identifiers(spark, documents):
    rows = [(None if i % 2 else 5, text) for i, (_, text) in enumerate(near_copies(9))]
    assert joined(ngram_join.join(spark, documents(rows).repartition(3))) == expected(rows)


def test_no_rows(spark, documents):
    assert joined(ngram_join.join(spark, documents([]))) == []
    assert joined(ngram_join.join(spark, documents([(1, None), (2, "")]))) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each_group_stays(spark, documents):
    rows = [row for row in ROWS if row[0] is not None and row != (7, "one")] + [(7, "one")]
    kept = ngram_join.one_of_each(spark, documents(rows))
    assert kept.columns == documents([]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in expected(rows)})


def test_trees_lose_no_link():
    draw = np.random.default_rng(2)
    base = [np.unique(draw.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3, 20, 50)]
    sets = []
    for _ in range(70):
        chosen = base[draw.integers(4)]
        part = chosen[draw.random(len(chosen)) > draw.random() * 0.3]
        sets.append(np.unique(np.concatenate([part, draw.integers(0, 2**63, 1 + draw.integers(3), dtype=np.uint64)])))
    near = {(i, j) for i in range(70) for j in range(i) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
    tree = signature_trees.Tree(sets, signature_trees.bits_for(sets))
    found = {(max(a, b), min(a, b)) for i, j, _ in signature_trees.candidates(tree, None, 75) for a, b in zip(i.tolist(), j.tolist())}
    assert near <= found and len(found) < 70 * 69 / 2


def test_words_in_parts_hash_alike(monkeypatch):
    from rowferry.llm import words

    text = "Some words, é 日本 and more " * 40
    whole = list(word_lists([text]))[0]
    monkeypatch.setattr(words, "CHUNK", 64)
    assert (list(word_lists(["x", text, None, text]))[3] == whole).all()
    assert len(shingles(whole[:3], 5)) == 1 and len(shingles(whole[:0], 5)) == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(comp.components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert comp.components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    assert joined(ngram_join.op5_ngram_join(spark, SMALL)) == expected(list(zip(table["doc_id"], table["text"])))


def test_only_texts_of_wanted_documents_are_shuffled(spark):
    rows = spark.range(0, 20_000).selectExpr("IF(id = 7, NULL, id) AS doc_id", "concat('t', id) AS text")
    wanted = spark.createDataFrame([(3,), (None,), (19_999,), (3,)], "_doc bigint")
    passed = ngram_join._maybe_wanted(rows, wanted)
    assert passed.columns == ["doc_id", "text"]
    found = sorted(row.text for row in passed.collect())
    assert {"t3", "t7", "t19999"} <= set(found) and len(found) == len(set(found)) < 20
    assert ngram_join._maybe_wanted(rows, wanted.limit(0)).isEmpty()
    assert "BroadcastHashJoin" in passed._jdf.queryExecution().executedPlan().toString()


def test_tasks_get_batches_of_few_bytes(spark):
    """A scratch table's Python tasks get long rows in batches of bounded size, one by one or by group."""
    rows = spark.range(0, 3000, 1, 1).withColumn("text", F.repeat(F.lit("x"), 10_000))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)], "bytes": [batch.nbytes]})

    def grouped(table):
        return pa.table({"n": [len(table)], "bytes": [max(batch.nbytes for batch in table.to_batches())]})

    for made in (rows.mapInArrow(sizes, "n bigint, bytes bigint"), rows.groupBy(F.col("id") % 1).applyInArrow(grouped, "n bigint, bytes bigint")):
        found = stored(spark, made, "batch-sizes")[0].agg(F.sum("n").alias("n"), F.max("bytes").alias("most")).first()
        assert found.n == 3000 and found.most < 6_000_000


def test_values_of_many_blobs():
    draw = np.random.default_rng(3)
    blobs, expected_parts = [], []
    for wide in (0, 1, 0):
        values = np.sort(draw.integers(0, 1 << (47 if wide else 20), 500).astype(np.uint64))
        ids, n, which = draw.integers(-(1 << 62), 1 << 62, 40), draw.integers(1, 900, 40), draw.integers(0, 40, 500)
        blobs.append(pa.py_buffer(ngram_join._packed(ids, n, values, which)))
        expected_parts.append((ids[which], n[which], values))
    for found, parts in zip(ngram_join._all_unpacked(blobs), zip(*expected_parts)):
        assert (found == np.concatenate(parts)).all()
