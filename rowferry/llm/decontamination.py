"""Benchmark decontamination by winnowed fingerprints of word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.scratch import stored

#: Words of a window, and of the k-grams that are hashed: every window holds WINDOW - GRAM + 1 of them.
WINDOW, GRAM = 10, 6

#: Up to so many bytes of benchmark fingerprints or windows are broadcast; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 1 << 25

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Lower-cased words of a text, runs without an ASCII character that is no letter or digit; none for null.

    A blank for each such character and a split at blanks take a seventh of the time of a regular expression.
    """
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER + _APART, _LOWER + " " * len(_APART))
    return F.array_remove(F.split(lowered, " "), "")


def _places(count: Column) -> Column:
    """0 to count - 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def winnowed(rows: DataFrame, window: int) -> DataFrame:
    """Rows with a column words become one row for each fingerprint: fingerprint and place are added.

    The fingerprint of a window is the least hash among its k-grams. Windows
    at place, place + 1, ... share it; a row is made where it changes, and at
    every multiple of the number of k-grams, so that each window starts less
    than that number of words behind a row with its fingerprint.
    """
    gram = min(GRAM, window)
    grams = window - gram + 1
    rows = rows.withColumn("_h", F.transform("words", lambda word: F.xxhash64(word)))
    rows = rows.withColumn(
        "_g", F.transform(_places(F.size("_h") - gram + 1), lambda i: F.xxhash64(*[F.get("_h", i + at) for at in range(gram)]))
    )
    if grams > 1:
        least = F.transform(_places(F.size("_g") - grams + 1), lambda i: F.least(*[F.get("_g", i + at) for at in range(grams)]))
        rows = rows.withColumn("_m", least)
    else:
        rows = rows.withColumn("_m", F.col("_g"))
    changes = lambda i: (i % grams == 0) | (F.get("_m", i) != F.get("_m", i - 1))
    rows = rows.withColumn("place", F.explode(F.filter(_places(F.size("_m")), changes)))
    return rows.withColumn("fingerprint", F.get("_m", F.col("place"))).drop("_h", "_g", "_m")


def benchmark_windows(spark: SparkSession, benchmark: DataFrame) -> DataFrame:
    """Distinct windows: their words, how many those are, and the items that have them."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    windows = items.select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"))
    windows = windows.select("item_id", "length", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("window_text"))
    return stored(spark, windows.groupBy("length", "window_text").agg(F.collect_set("item_id").alias("items")), "benchmark-windows")[0]


def _small(df: DataFrame, size: Column) -> DataFrame:
    """With a broadcast hint if its rows have few bytes in all; size is that of a row."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def hits(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Occurrences of benchmark windows: doc_id, text_key, start (from 0), length, items.

    Fingerprints that documents and benchmark share give candidates; each is
    extended to the windows around it, and only windows equal word by word count.
    """
    windows = benchmark_windows(spark, benchmark)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    found = None
    for length in sorted(row.length for row in windows.select("length").distinct().collect()):  # ten values at most
        here = windows.where(F.col("length") == length)
        reach = length - min(GRAM, length)
        prints = winnowed(here.select(F.split("window_text", " ").alias("words")), length).select("fingerprint").distinct()
        prints = _small(stored(spark, prints, "benchmark-prints")[0], F.lit(16))
        around = winnowed(texts, length).join(prints, "fingerprint").select(
            "doc_id", "text_key", "place", F.slice("words", F.col("place") + 1, length + reach).alias("near")
        )
        starts = around.select("doc_id", "text_key", "place", "near", F.explode(F.sequence(F.lit(0), F.size("near") - length)).alias("at"))
        spans = starts.select(
            "doc_id", "text_key", (F.col("place") + F.col("at")).alias("start"),
            F.array_join(F.slice("near", F.col("at") + 1, length), " ").alias("window_text"),
        )
        size = F.octet_length("window_text") + 40 * F.size("items") + 100
        same = spans.join(_small(here, size), "window_text").select("doc_id", "text_key", "start", "length", "items")
        found = same if found is None else found.unionByName(same)
    if found is None:
        nothing = texts.where(F.lit(False)).select("doc_id", "text_key", F.lit(0).alias("start"), F.lit(0).alias("length"))
        item_type = benchmark.schema["item_id"].dataType.simpleString()
        return nothing.withColumn("items", F.array().cast(f"array<{item_type}>"))
    return found


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, text_key, n_words, n_hit, items (sorted as strings), contaminated.

    A null or empty text has no words and no hits; benchmark items without
    words hit nothing. Documents are told apart by doc_id and text, so rows
    that repeat one share its result, and null identifiers are kept. A window
    of several items counts for all of them. An item whose item_id is null hits
    words as others do, so it contaminates, but has no name to be listed by.
    Other columns are not read.
    """
    spans = hits(spark, docs, benchmark)
    by_window = spans.select("doc_id", "text_key", F.struct("start", "length").alias("span"), "items")
    per_doc = by_window.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda seen, span: F.struct(
            F.greatest(seen["end"], span["start"] + span["length"]).alias("end"),
            (seen["total"] + F.greatest(F.lit(0), span["start"] + span["length"] - F.greatest(seen["end"], span["start"]))).alias("total"),
        ),
        lambda seen: seen["total"],
    )
    per_doc = per_doc.select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), covered.alias("_n_hit"),
        F.array_sort(F.transform("items", lambda item: item.cast("string"))).alias("_items"),
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words_of(F.col("text"))).cast("bigint").alias("n_words"))
    matched = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return counted.join(per_doc, matched, "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("_n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"), F.col("_n_hit").isNotNull().alias("contaminated"),
    )


def without_benchmark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns."""
    hit = hits(spark, docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    hit, _ = stored(spark, hit, "contaminated")
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_id"]) & (F.xxhash64(docs["text"]) == hit["_key"]), "left_anti")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in ("documents", "benchmark"))
    return contamination(spark, docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
         b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
         s AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0),
         v AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS t FROM s),
         lengths AS (SELECT DISTINCT n FROM v),
         x AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n),
         y AS (SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS t FROM x),
         h AS (SELECT doc_id, p, n, item_id FROM y JOIN v USING (n, t)),
         places AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS place FROM h) GROUP BY doc_id),
         items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN places ON places.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""
