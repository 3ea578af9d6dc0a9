import re

import public_tokenizers
import pyarrow.parquet as pq
from conftest_llm import SMALL, sha256
from test_decontamination import words
from test_ngram_join import shingle_set
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from rowferry.llm import quality, registry


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]


def test_registered():
    queries = __spark_entry__.queries()
    assert set(registry.QUERIES) | {"pipeline"} <= set(queries)
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in registry.QUERIES) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_rows_against_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{table}.parquet") for table in ("documents", "labels"))
    scores = dict(tuple(r) for r in quality.score(spark, docs, quality.train(spark, docs, labels)).collect())
    table = pq.read_table(f"{SMALL}/documents.parquet").to_pydict()
    rows = {i: text for i, text in zip(table["doc_id"], table["text"]) if scores[i] >= quality.THRESHOLD}
    last = {text: i for i, text in sorted(rows.items())}
    rows = {i: text for i, text in rows.items() if last[text] == i}
    sets = {i: shingle_set(text) for i, text in rows.items()}
    least = {i: i for i in rows}

    def find(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])):
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = find(a), find(b)
                    least[max(x, y)] = min(x, y)
    rows = {i: text for i, text in rows.items() if find(i) == i}
    windows = set()
    for text in pq.read_table(f"{SMALL}/benchmark.parquet").to_pydict()["text"]:
        w = words(text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    lengths = {len(w) for w in windows}
    clean = {}
    for i, text in rows.items():
        w = words(text)
        if not any(tuple(w[at : at + n]) in windows for n in lengths for at in range(len(w) - n + 1)):
            clean[i] = text
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = []
    for i, text in clean.items():
        ids = library.encode(text, add_special_tokens=False).ids
        wanted.append((i, len(ids), ids, sha256(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(wanted)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SMALL).columns == docs.columns, name
        assert stage(spark, docs.where("doc_id < 0"), SMALL).count() == 0, name
