"""Quality classifier learned from trusted positives and unlabelled web text.

A small network minimises the non-negative unbiased risk: with class prior p,
positives P and unlabelled rows U it is

    p * loss(P as positive) + max(0, loss(U as negative) - p * loss(P as negative))

Rows labelled 0 are never learned from. The prior is estimated from the same
two samples: a classifier tells P from U, and over its scores the least ratio
of U's share to P's share above a threshold bounds p from above.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.folds import held_out, sampled_ids
from rowferry.llm.scratch import free_name
from rowferry.llm.words import SPACES, give_back, hash_words, powers, slices
from rowferry.plans.session import ship_package

#: Positives and unlabelled rows that are learned from, at most.
POSITIVES, UNLABELLED = 6_000, 12_000
HIDDEN, STEPS, RATE, DECAY = 16, 300, 0.02, 1e-3
#: Share of P that must lie above a threshold for it to bound the prior.
LEAST_SHARE = 0.5
THRESHOLD = 0.7

#: Bytes measured at a time; a longer text is measured in parts, whose sums are added.
PART = 1 << 20

_MARKS = [ord(c) for c in "!|#$%&*<>{}[]=/\\@_~^"]
FEATURES = 11 + len(_MARKS) + 6


def measure(data: bytes) -> np.ndarray:
    """The features of one text, over all of its bytes and words."""
    counts = np.zeros(256, np.int64)
    words, lengths = [], []
    start = 0
    while start < len(data) or not start:
        part = np.frombuffer(data[start : start + PART], np.uint8)
        counts += np.bincount(part, minlength=256)
        if len(part):
            hashes, begins, ends = hash_words(part, SPACES)
            words.append(hashes)
            lengths.append(ends - begins)
        start += PART
    n = max(1, len(data))
    made = np.zeros(FEATURES)
    made[0] = np.log1p(len(data))
    made[1] = counts[65:91].sum() / n
    made[2] = counts[97:123].sum() / n
    made[3] = counts[48:58].sum() / n
    made[4] = counts[128:].sum() / n
    made[5] = counts[32] / n
    made[6] = counts[10] / n
    made[7] = counts[[44, 46, 59, 58]].sum() / n
    share = counts[counts > 0] / n
    made[8] = -(share * np.log(share)).sum()
    made[9] = counts[[39, 45]].sum() / n
    made[10] = not len(data)
    made[11 : 11 + len(_MARKS)] = np.sqrt(counts[_MARKS] / n)
    hashes = np.concatenate(words) if words else np.empty(0, np.uint64)
    if len(hashes):
        sizes = np.concatenate(lengths)
        at = 11 + len(_MARKS)
        made[at] = sizes.mean() / 10
        made[at + 1] = sizes.std() / 10
        made[at + 2] = (sizes > 12).mean()
        # Repetition, on a scale that does not depend on the text's length.
        made[at + 3] = (hashes[1:] == hashes[:-1]).mean() if len(hashes) > 1 else 0
        pairs = hashes[1:] * powers(3)[0][2] + hashes[:-1]
        made[at + 4] = 1 - len(np.unique(pairs)) / len(pairs) if len(pairs) else 0
        made[at + 5] = np.log(len(np.unique(hashes))) / np.log(len(hashes) + 1)
    return made


@dataclass(frozen=True)
class Network:
    """One hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]

    def logits(self, x: np.ndarray) -> np.ndarray:
        first, bias, second, last = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ first + bias) @ second + last

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def _descend(x: np.ndarray, slopes, seed: int = 9) -> Network:
    """Adam over all rows; slopes(logits) are the risk's derivatives by logit."""
    draw = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    weights = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        hidden = np.tanh(z @ weights[0] + weights[1])
        slope = slopes(hidden @ weights[2] + weights[3])
        back = np.outer(slope, weights[2]) * (1 - hidden * hidden)
        grads = [z.T @ back + DECAY * weights[0], back.sum(0), hidden.T @ slope + DECAY * weights[2], slope.sum(keepdims=True)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, tuple(weights))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows.

    Each half of the rows is judged by a classifier that learned from the
    other half, so that what it remembers of single rows does not count.
    """
    of_p, of_u = np.empty(len(positive)), np.empty(len(unlabelled))
    for half in (0, 1):
        p, u = positive[half::2], unlabelled[half::2]
        if not len(p) or not len(u):
            return 0.5
        target = np.concatenate([np.ones(len(p)), np.zeros(len(u))])
        each = np.concatenate([np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))])
        net = _descend(np.concatenate([p, u]), lambda v, target=target, each=each: (_sigmoid(v) - target) * each)
        of_p[1 - half :: 2] = net.logits(positive[1 - half :: 2])
        of_u[1 - half :: 2] = net.logits(unlabelled[1 - half :: 2])
    of_p, of_u = np.sort(of_p), np.sort(of_u)
    cuts = np.quantile(of_p, np.linspace(0, 1 - LEAST_SHARE, 200))
    above_p = 1 - np.searchsorted(of_p, cuts, "left") / len(of_p)
    above_u = 1 - np.searchsorted(of_u, cuts, "left") / len(of_u)
    # One standard error above the ratio, so that the luck of few rows does not decide.
    error = np.sqrt((1 - above_u) / (np.maximum(above_u, 1e-9) * len(of_u)) + (1 - above_p) / (np.maximum(above_p, 1e-9) * len(of_p)))
    return float(np.clip((above_u / above_p * (1 + error)).min(), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Network:
    """Minimise the non-negative risk with logistic loss."""
    p, u = len(positive), len(unlabelled)

    def slopes(v):
        of_p, of_u = v[:p], v[p:]
        as_negative = np.logaddexp(0, of_u).mean() - prior * np.logaddexp(0, of_p).mean()
        up_p, up_u = _sigmoid(of_p), _sigmoid(of_u)
        made = np.concatenate([prior * (up_p - 1) / p, np.zeros(u)])
        # Where the estimated risk of negatives is below zero it is driven up again instead.
        sign = 1.0 if as_negative >= 0 else -1.0
        made[:p] -= sign * prior * up_p / p
        made[p:] += sign * up_u / u
        return made

    return _descend(np.concatenate([positive, unlabelled]), slopes)


def measured(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and its features; null counts as empty."""
    ship_package(spark)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            flat = np.concatenate([measure((text or "").encode()) for text in batch.column(1).to_pylist()] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(flat), FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "features"])
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, features array<double>")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Network | None:
    """Learn from at most POSITIVES and UNLABELLED rows; None without any of either.

    Positives are documents labelled 1 outside the held-out fold; unlabelled
    rows are drawn from all documents outside it, whatever their label. Only
    the bounded samples' features come to the driver.
    """
    fold = ~held_out(F.col("doc_id"))
    trusted = labels.where((F.col("quality") == 1) & fold).select("doc_id").distinct()
    samples = []
    for ids, most, seed in ((trusted, POSITIVES, 1), (docs.where(fold).select("doc_id").distinct(), UNLABELLED, 2)):
        chosen = sampled_ids(ids, most, seed)
        rows = measured(spark, docs.join(F.broadcast(chosen), "doc_id", "left_semi")).orderBy("doc_id").limit(most).toPandas()
        samples.append(np.stack(rows.features.to_list()) if len(rows) else np.empty((0, FEATURES)))
    positive, unlabelled = samples
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(spark: SparkSession, docs: DataFrame, net: Network | None, columns: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The given columns of docs and the score under ``name``; 1 everywhere without a model, so that nothing is rejected untaught."""
    ship_package(spark)
    chosen = docs.select(*[docs[c] for c in columns], docs["text"].alias("_text_to_score"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(len(columns)).to_pylist()
            x = np.stack([measure((text or "").encode()) for text in texts]) if texts else np.empty((0, FEATURES))
            scores = np.ones(len(texts)) if net is None else net.scores(x)
            kept = batch.select(range(len(columns)))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores, pa.float64())], names=[*kept.schema.names, name])
        give_back()

    fields = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]], f"`{name}` double"]
    return chosen.mapInArrow(run, ", ".join(fields))


def accepted(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that score at least THRESHOLD."""
    name = free_name("score", docs.columns)
    scored = score(spark, docs, train(spark, docs, labels), tuple(docs.columns), name)
    return scored.where(F.col(name) >= THRESHOLD).drop(name)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("documents", "labels"))
    scored = score(spark, docs, train(spark, docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
