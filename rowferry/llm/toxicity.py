"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.folds import held_out, sampled_ids
from rowferry.llm.words import NO_WORD, mixed, powers, slices, word_lists
from rowferry.plans.session import ship_package

#: Slots that features are hashed to: the dense weights take four megabytes at most.
BITS = 20
#: Labelled rows of each class that are learned from, at most.
TRAINING_ROWS = 8_000
PASSES, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 6.0, 0.0
THRESHOLD = 0.3


def features(words: np.ndarray) -> np.ndarray:
    """Slots of all words, word pairs and pairs with one or two words between, with repeats."""
    factors, _ = powers(8)
    found = [words]
    for distance in (1, 2, 3):
        if len(words) > distance:
            found.append(mixed(words[:-distance] * factors[2 * distance] + words[distance:] * factors[1]))
    return (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates; the weights by slot, most of them zero, and the bias.

    docs are distinct slots of a document each; a document counts ``weights`` times.
    """
    slots = (1 << BITS) + 1  # the last is the bias, which is not shrunk
    z, n = np.zeros(slots), np.zeros(slots)
    shrink = np.full(slots, L1)
    shrink[-1] = 0.0
    draw = np.random.default_rng(seed)

    def weight(at):
        return np.where(np.abs(z[at]) <= shrink[at], 0.0, (np.sign(z[at]) * shrink[at] - z[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for i in draw.permutation(len(docs)):
            at = np.append(docs[i], slots - 1)
            w = weight(at)
            slope = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]) * weights[i]
            squared = n[at] + slope * slope
            z[at] += slope - (np.sqrt(squared) - np.sqrt(n[at])) / ALPHA * w
            n[at] = squared
    made = weight(np.arange(slots))
    return made[:-1].astype(np.float32), float(made[-1])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and bias from at most TRAINING_ROWS labelled documents of each class.

    Held-out rows, labels other than 0 and 1 and labels without a document are
    not used. Features are made where the documents are; one task fits, and only
    the non-zero weights come to the driver. Without rows the score is 0.5.
    """
    ship_package(spark)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.where("toxic IN (0, 1)")
    counts = {row.toxic: row["count"] for row in usable.groupBy("toxic").count().collect()}
    parts = [  # sampled rows stand for the rest of their class
        sampled_ids(usable.where(F.col("toxic") == value), TRAINING_ROWS, 10).withColumn("weight", F.lit(max(1.0, counts.get(value, 0) / TRAINING_ROWS)))
        for value in (0, 1)
    ]
    chosen = parts[0].unionByName(parts[1])

    def featurise(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            slots = [np.unique(features(words)).astype(np.int32).tobytes() for words in word_lists(batch.column(0).to_pylist(), NO_WORD)]
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.binary()), batch.column(1), batch.column(2), batch.column(3)], names=["slots", "toxic", "weight", "doc_id"])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", kind="stable")
        made, bias = fit([np.frombuffer(x, np.int32) for x in rows.slots], rows.toxic.to_numpy(), rows.weight.to_numpy())
        at = np.flatnonzero(made)
        return pd.DataFrame({"slot": np.append(at, 1 << BITS), "weight": np.append(made[at].astype(float), bias)})

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight", "doc_id")
    rows = texts.mapInArrow(featurise, "slots binary, toxic int, weight double, doc_id bigint")
    found = rows.groupBy().applyInPandas(learn, "slot long, weight double").toPandas()
    dense = np.zeros((1 << BITS) + 1, np.float32)
    dense[found.slot.to_numpy(np.int64)] = found.weight
    return dense[:-1], float(dense[-1])


def score(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score for every row: nulls and empty texts get the score of a text without features."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model[0])  # of fixed size
    bias = model[1]

    def run(batches):
        weights = shared.value
        for batch in (part for whole in batches for part in slices(whole)):
            scores = []
            for words in word_lists(batch.column(1).to_pylist(), NO_WORD):
                slots = features(words)
                slots = np.unique(slots[weights[slots] != 0])
                scores.append(1 / (1 + np.exp(-np.clip(weights[slots].sum(dtype=np.float64) + bias, -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("documents", "labels"))
    scored = score(spark, docs, train(spark, docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
