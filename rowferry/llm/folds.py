"""Labelled rows that may be learned from, and bounded samples of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled_ids(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most so many rows: those whose doc_id hashes least, the same in every run."""
    return rows.where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)
