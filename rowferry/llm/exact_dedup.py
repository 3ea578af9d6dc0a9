"""Exact deduplication: a stream over keyed, disk-backed state that never expires."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.llm.scratch import settings, stored
from rowferry.plans.session import scratch_path

#: State lives in RocksDB on the executors' disks and is uploaded to the shared folder; its memory is bounded.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: nothing is preallocated
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # a call ends with its batch: no store stays in memory
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
}


#: A digest with more than one in so many of all rows is joined by a broadcast; there are fewer than this many of them.
HOT_SHARE = 1_000


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def absorb(spark: SparkSession, keys_path: str, state_path: str) -> DataFrame:
    """Run the stream over all key files not seen yet; return the state.

    The state has a row per digest: the largest identifier, that row's content
    locator and the number of rows. It has no watermark, so nothing expires; a
    later call with the same two paths goes on from where this one ended.
    """
    schema = "doc_id bigint, digest string, locator string"
    state = (
        spark.readStream.schema(schema).parquet(keys_path)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("group_size"))
    )
    with settings(spark, STATE_SETTINGS):
        query = (
            state.writeStream.format("noop").outputMode("update")
            .option("checkpointLocation", state_path).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    held = spark.read.format("statestore").load(state_path)
    return held.select("key.*", "value.*").toDF("digest", "keeper", "group_size")


def with_groups(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Each key with its digest's state. The digests that a large share of the rows have are not shuffled by it."""
    rows = state.agg(F.sum("group_size")).first()[0] or 0
    hot, keys = F.col("group_size") > rows // HOT_SHARE + 1, keys.select("doc_id", "digest")
    few = F.broadcast(state.where(hot))
    others = keys.join(few.select("digest"), "digest", "left_anti").join(state.where(~hot), "digest")
    return others.unionByName(keys.join(few, "digest"))


def decide(spark: SparkSession, docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept.

    Of rows with equal text the one with the largest doc_id stays. A null text
    counts as empty; a null doc_id is smaller than any other. Rows that repeat
    both doc_id and text are one document in several copies: each counts in
    group_size, and all share one decision. Other columns are not read.

    Rows with equal digests are hits. The full bytes of all hits are compared;
    should texts differ under one digest, they are grouped by text instead.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    keys, keys_path = stored(spark, texts.select(F.col("doc_id").cast("bigint"), "digest", F.input_file_name().alias("locator")), "dedup-keys")
    state, _ = stored(spark, absorb(spark, keys_path, scratch_path(spark, "dedup-state")), "dedup-groups")
    decisions = with_groups(keys, state).select(
        "doc_id", "digest", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")).alias("kept"),
    )
    hits = decisions.where("group_size > 1").select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"))
    same_row = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest"))
    differing = (
        texts.join(hits, same_row, "left_semi")
        .groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most"))
        .where("least <> most").select("digest")
    )
    differing, _ = stored(spark, differing, "dedup-collisions")
    if differing.isEmpty():
        return decisions
    mixed = texts.join(differing, "digest", "left_semi")
    groups = mixed.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    regrouped = mixed.join(groups, ["digest", "text"]).select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    )
    return decisions.join(differing, "digest", "left_anti").select(*regrouped.columns).unionByName(regrouped)


def without_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, one of each group of equal texts.

    Of rows that repeat doc_id and text, any one stays.
    """
    digest = sha256(F.coalesce(docs["text"], F.lit("")))
    kept = decide(spark, docs).where("kept").groupBy(F.col("doc_id").alias("_kept_id"), F.col("digest").alias("_kept_digest")).agg(F.count("*").alias("_rows"))
    kept, _ = stored(spark, kept, "kept-rows")

    def chosen(rows: DataFrame) -> DataFrame:
        return docs.join(rows, docs["doc_id"].eqNullSafe(rows["_kept_id"]) & (digest == rows["_kept_digest"]), "left_semi")

    once, repeated = chosen(kept.where("_rows = 1")), kept.where("_rows > 1")
    return once if repeated.isEmpty() else once.unionByName(chosen(repeated).dropDuplicates(["doc_id", "text"]))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(spark, docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLE = """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents),
         g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM d JOIN g USING (text)
"""
