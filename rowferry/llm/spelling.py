"""Spelling variants: words one edit apart, found by FM-index search schemes, grouped under the frequent form."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.fm_index import WordIndex
from rowferry.llm.scratch import discard, stored
from rowferry.llm.words import slices
from rowferry.plans.session import ship_package

#: Least code points and occurrences of a word; how many times as frequent a form is.
LETTERS, TIMES, RATIO = 7, 2, 10

#: One of so many runs loses a code point.
DAMAGE = 31

#: Words of a bucket at most, while it can be split; rows and letters of an index.
BUCKET, INDEX_ROWS, INDEX_LETTERS = 8192, 16384, 1 << 18

#: Bytes of counted words that a task holds.
COUNTED = 1 << 24

#: Latin-1 bytes: letters, A-Z as a-z; all others become blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def _runs(text: str) -> Iterator[bytes]:
    """Runs of letters that may be words, lower-cased, as Latin-1."""
    return (run for run in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(run) >= LETTERS)


def _damaged(doc_id: object, run: bytes) -> bytes:
    """The run, without one code point if the checksum of document and run says so."""
    name = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(name, doc_id)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def occurrences(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts with their numbers of occurrences, whatever these are."""

    def flush(counted: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in counted], "n": list(counted.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter = Counter()
        held = 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for run, n in Counter(_runs(text or "")).items():
                        word = _damaged(seed, run)
                        if len(word) < LETTERS:
                            continue
                        if word not in counted:
                            held += len(word) + 100
                        counted[word] += n
                    if held > COUNTED:
                        yield flush(counted)
                        counted, held = Counter(), 0
        yield flush(counted)

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _split(rows: DataFrame) -> DataFrame:
    """Each row twice: one word of a pair shares the front half of the region that may differ, or the back half, with the other."""
    region = F.col("shorter") - F.col("front") - F.col("back")
    half = F.floor(region / 2).cast("int")
    ways = F.array(
        F.struct((F.col("front") + half).alias("front"), F.col("back").alias("back")),
        F.struct(F.col("front").alias("front"), (F.col("back") + region - half).alias("back")),
    )
    return rows.select("word", "n", "shorter", "suffix", F.explode(ways).alias("way")).select("word", "n", "shorter", "suffix", "way.*").transform(_keyed)


def _keyed(rows: DataFrame) -> DataFrame:
    front = F.expr("substring(word, 1, front)")
    back = F.expr("right(word, back)")
    return rows.withColumn("bucket", F.xxhash64("shorter", "front", "back", "suffix", front, back))


def buckets(spark: SparkSession, vocabulary: DataFrame, most: int = BUCKET) -> DataFrame:
    """word, n, suffix, bucket: words with one edit between them share a bucket of one of the two kinds.

    A pair is known by the length of its shorter word. Both have equal front
    halves, or equal back halves (suffix). A bucket that holds more words than
    it should is split by halves of what is left, again and again; what can't be
    split is one letter, so such a bucket has as many words as there are letters
    and pairs of letters.
    """
    length = F.char_length("word")
    shorter = F.array(length, length - 1)
    rows = vocabulary.select("word", "n", F.explode(shorter).alias("shorter"), F.lit(0).alias("front"), F.lit(0).alias("back"))
    rows = _split(rows.withColumn("suffix", F.lit(False))).withColumn("suffix", F.col("back") > 0)
    rows, path = stored(spark, _keyed(rows), "variant-buckets")
    paths, found = [path], None
    while True:
        sizes = rows.groupBy("bucket", "shorter", "front", "back").agg(F.count("*").alias("size"))
        crowded = sizes.where((F.col("size") > most) & (F.col("shorter") - F.col("front") - F.col("back") > 1)).select("bucket")
        crowded, path = stored(spark, crowded, "crowded-buckets")
        paths.append(path)
        if crowded.isEmpty():
            return rows if found is None else found.unionByName(rows)
        settled = rows.join(crowded, "bucket", "left_anti").select(rows.columns)
        found = settled if found is None else found.unionByName(settled)
        rows, path = stored(spark, _split(rows.join(crowded, "bucket", "left_semi")), "variant-buckets")
        paths.append(path)


def near_words(spark: SparkSession, vocabulary: DataFrame, most: int = BUCKET) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words with exactly one code point inserted, deleted or replaced.

    The vocabulary has distinct words of Latin-1 code points. Words go by their buckets to indexes of bounded size; each
    index searches for its own words, with the half that the bucket stands for taken exactly and one error in the other.
    """
    ship_package(spark)
    rows = buckets(spark, vocabulary, most).select("word", "n", "suffix", "bucket")
    total, letters = rows.agg(F.count("*"), F.sum(F.char_length("word"))).first()
    indexes = max(1, -(-total // INDEX_ROWS), -(-(letters or 0) // INDEX_LETTERS))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["word", "suffix"])
        counts = dict(zip(frame["word"], frame["n"], strict=True))
        index = WordIndex([w.encode("latin-1") for w in counts])
        names = np.array([w.decode("latin-1") for w in index.words], dtype=object)
        places = {w: i for i, w in enumerate(names)}
        n = np.array([counts[w] for w in names])
        found = []
        for suffix in (False, True):
            asked = np.array([places[w] for w in frame["word"][frame["suffix"] == suffix]], dtype=np.int64)
            found.append(index.one_edit(asked, suffix))
        word, near = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"word": names[word], "n": n[word], "near": names[near], "near_n": n[near]})

    dealt = rows.withColumn("index", F.pmod("bucket", F.lit(indexes)))
    pairs = dealt.groupBy("index").applyInPandas(search, "word string, n long, near string, near_n long")
    return pairs.repartition("word").groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """word, root: the last form that is reached from a word. A form is at least RATIO times as frequent, so there is no circle.

    Every round doubles the steps that are taken, so there are as many as the logarithm of the longest way.
    """
    now, path = stored(spark, forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further, further_path = stored(
            spark, now.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots"
        )
        discard(spark, path)
        now, path = further.select("word", "root"), further_path
        if further.where("moved").isEmpty():
            return now


def variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word, which is a distinct run of letters.

    Texts are taken whole; a null or empty one has no words, and a null doc_id
    counts as an empty one in the checksum. Rows that repeat count again. Of near
    words with the largest n the first by code points is the form. Without
    rows there are no words. Other columns are not read.
    """
    ship_package(spark)
    vocabulary, _ = stored(spark, occurrences(docs).where(F.col("n") >= TIMES), "vocabulary")
    pairs = near_words(spark, vocabulary)
    # The largest n, then the smallest word: min_by over the negative count.
    best: Column = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    grouped = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= RATIO * F.col("n")
    grouped = grouped.select(
        "word", "n_near", F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")
    )
    grouped, _ = stored(spark, grouped, "variant-forms")
    last = roots(spark, grouped.where("form IS NOT NULL"))
    return vocabulary.join(grouped, "word", "left").join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
