import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest_llm import SMALL

from rowferry.llm import folds, quality, toxicity
from rowferry.llm.words import NO_WORD, word_lists

LARGER = "/root/testdata/sf0.1"


def outcomes(df, label):
    """(label, predicted) of the held-out rows that have a label, and all scores."""
    truth = pq.read_table(f"{LARGER}/labels.parquet").to_pydict()
    truth = dict(zip(truth["doc_id"], truth[label]))
    rows = df.collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    return [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]


def test_quality_on_held_out_rows(spark):
    found = outcomes(quality.op9_quality(spark, LARGER), "quality")
    good = [p for t, p in found if t == 1]
    junk = [p for t, p in found if t == 0]
    assert np.mean(good) >= 0.98 and np.mean(junk) <= 0.1


def test_toxicity_on_held_out_rows(spark):
    found = outcomes(toxicity.op10_toxicity(spark, LARGER), "toxic")
    assert np.mean([p for t, p in found if t == 1]) >= 0.75
    assert np.mean([p for t, p in found if t == 0]) <= 0.01


def test_prior_is_estimated():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(0, 1, (6_000, 4)), draw.normal(4, 1, (6_000, 4))
    for prior in (0.3, 0.8):
        n = int(4_000 * prior)
        unlabelled = np.concatenate([good[2_000 : 2_000 + n], bad[: 4_000 - n]])
        assert quality.estimate_prior(good[:2_000], unlabelled) == pytest.approx(prior, abs=0.06)
        net = quality.fit(good[:2_000], unlabelled, prior)
        assert (net.scores(good[5_500:]) >= 0.7).mean() > 0.95 and (net.scores(bad[5_500:]) < 0.7).mean() > 0.95


ROWS = [(1, None), (2, ""), (3, " "), (4, "word"), (4, "word"), (None, "x"), (5, "long text " * 20_000), (6, "É 日")]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows_are_scored(spark, documents):
    given = labels(spark, [(1, 1, 0), (4, 1, 1), (4, 1, 1), (5, None, 7), (None, 1, 1), (99, 1, 1), (3, 0, 0)])
    for scored in (
        quality.score(spark, documents(ROWS), quality.train(spark, documents(ROWS), given)),
        toxicity.score(spark, documents(ROWS), toxicity.train(spark, documents(ROWS), given)),
    ):
        rows = [tuple(r) for r in scored.collect()]
        assert sorted((r[0] for r in rows), key=repr) == sorted((i for i, _ in ROWS), key=repr)
        assert all(0 <= r[1] <= 1 for r in rows)


def test_nothing_to_learn(spark, documents):
    none = labels(spark, [])
    assert quality.train(spark, documents(ROWS), none) is None
    assert quality.accepted(spark, documents(ROWS), none).count() == len(ROWS)
    assert {r.score for r in toxicity.score(spark, documents(ROWS), toxicity.train(spark, documents(ROWS), none)).collect()} == {0.5}
    assert quality.accepted(spark, documents([]), none).count() == 0


def test_rejected_rows_go(spark):
    docs, given = (spark.read.parquet(f"{SMALL}/{table}.parquet") for table in ("documents", "labels"))
    net = quality.train(spark, docs, given)
    scores = dict(tuple(r) for r in quality.score(spark, docs, net).collect())
    kept = quality.accepted(spark, docs, given)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s >= quality.THRESHOLD}


def test_measures_in_parts(monkeypatch):
    text = ("Some words, 12 and more!\n" * 100).encode()
    whole = quality.measure(text)
    monkeypatch.setattr(quality, "PART", 25)
    parts = quality.measure(text)
    assert parts == pytest.approx(whole)
    assert len(whole) == quality.FEATURES and np.isfinite(quality.measure(b"")).all()


def test_ngrams_and_skip_grams():
    words = next(word_lists(["a b c d"], NO_WORD))
    assert len(toxicity.features(words)) == 4 + 3 + 2 + 1
    assert len(toxicity.features(words[:0])) == 0
    swapped = next(word_lists(["b a c d"], NO_WORD))
    assert set(toxicity.features(words)) != set(toxicity.features(swapped))


def test_weights_are_sparse():
    draw = np.random.default_rng(1)
    docs = [np.unique(draw.integers(0, 1 << 20, 60)) for _ in range(600)]
    truth = np.arange(600) % 4 == 0
    docs = [np.append(d, 77) if t else d for d, t in zip(docs, truth)]
    weights, bias = toxicity.fit(docs, truth.astype(float), np.ones(600))
    assert weights[77] > 2 and (weights != 0).sum() < 2_000 and bias < 0


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for row in rows.select("doc_id", folds.held_out(rows.doc_id).alias("out")).collect():
        assert row.out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
    some = [r.doc_id for r in folds.sampled_ids(rows, 7, 1).collect()]
    assert len(some) == 7 and some == [r.doc_id for r in folds.sampled_ids(rows.repartition(9), 7, 1).collect()]
