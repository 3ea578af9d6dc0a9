"""Rows that break a constraint."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with how often; keys with a null are exempt.

    Counts are added up before the shuffle, so that a hot key costs one row a task.
    """
    whole = reduce(and_, [F.col(key).isNotNull() for key in keys])
    return df.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def audit_foreign_key(child: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Child keys that no parent has, with their number of rows; keys with a null are exempt.

    The child's rows are counted by key first; only distinct keys meet the parent.
    """
    whole = reduce(and_, [F.col(key).isNotNull() for key in keys])
    counted = child.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_keys, keys, strict=True)])
    return counted.join(known, keys, "left_anti")


def audit_check(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition is false; as in SQL, an unknown outcome passes."""
    return df.where(~condition)


def audit_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column its number of nulls, if any: one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(name).isNull()).alias(f"c{i}") for i, name in enumerate(columns)])
    rows = F.array(
        *[F.struct(F.lit(n).alias("column_name"), F.col(f"c{i}").alias("n_nulls")) for i, n in enumerate(columns)]
    )
    return counts.select(F.inline(rows)).where("n_nulls > 0")
