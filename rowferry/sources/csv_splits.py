"""Delimited files with line breaks in their fields, read in parallel splits.

A line break lies within a field exactly if an odd number of quotes stands
before it in its file. So the quotes of each split are counted first, and
the sum of all splits before one says whether it starts within a field. Each
task then joins the lines of its splits into records, whole columns at a
time; what a record leaves in its first split, in whole splits and in its
last one is put together afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A complete record, the start of one, all of a split that lies within one, and the end of one.
_WHOLE, _START, _MIDDLE, _END = range(4)


@dataclass(frozen=True)
class Breaks:
    """broken: a field holds a line break; crossed: a split starts within a field."""

    broken: bool
    crossed: bool


def _lines(spark: SparkSession, path: str) -> DataFrame:
    at = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", at.file_path.alias("file"), at.file_block_start.alias("first"), at.file_block_length.alias("size")
    )


def _split_starts(spark: SparkSession, path: str) -> DataFrame:
    """file, first, size, within, odd: for each split whether it starts within a field, and its lines with an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = _lines(spark, path).groupBy("file", "first", "size").agg(F.sum((quotes % 2 == 1).cast("int")).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("*", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("within"))


def find_breaks(spark: SparkSession, path: str) -> Breaks:
    """One scan that counts quotes."""
    found = _split_starts(spark, path).agg(F.max(F.col("odd") > 0), F.max("within")).first()
    return Breaks(bool(found[0]), bool(found[1]))


class _Joiner:
    """The lines of one split, one batch after the other, as records."""

    def __init__(self, within: bool):
        self.within = within
        #: The lines of a record that has not ended, and what it is when it ends.
        self.open: list[pa.Array] = []
        self.kind = _END if within else _WHOLE

    def add(self, lines: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2
        ends = np.flatnonzero((np.cumsum(odd) + self.within) % 2 == 0) + 1
        self.within = bool((int(odd.sum()) + self.within) % 2)
        if not len(ends):
            self.open.append(lines)
            return
        if self.open:
            yield self.kind, self._joined([*self.open, lines.slice(0, ends[0])])
        elif self.kind == _END:
            yield _END, self._joined([lines.slice(0, ends[0])])
        else:
            ends = np.r_[0, ends]
        rest = lines.slice(ends[0], ends[-1] - ends[0])
        self.kind = _WHOLE
        if len(rest):
            lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), rest)
            yield _WHOLE, pc.binary_join(lists, "\n")
        self.open = [lines.slice(ends[-1])] if ends[-1] < len(lines) else []

    def end(self) -> Iterator[tuple[int, pa.Array]]:
        if self.open:
            yield _MIDDLE if self.kind == _END else _START, self._joined(self.open)

    @staticmethod
    def _joined(parts: list[pa.Array]) -> pa.Array:
        lines = pa.concat_arrays(parts)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")


def _pieces(spark: SparkSession, path: str, crossed: bool) -> DataFrame:
    """file, first, kind, head, value: records, and the parts of records that cross splits. head: it may be its file's header.

    The starts of splits are a row for each, about 150 bytes for the 128 MB of
    a split, and join the lines as a broadcast: so both scans of one query have
    the same splits, and lines stay in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, joiner, headed = None, None, False

        def rows(found: Iterator[tuple[int, pa.Array]]) -> Iterator[pa.RecordBatch]:
            nonlocal headed
            for kind, values in found:
                if kind != _WHOLE and not crossed:
                    raise ValueError("a quoted field does not end, or the files have changed while they were read")
                head = np.zeros(len(values), bool)
                if not headed and split[1] == 0:
                    filled = np.flatnonzero(pc.greater(pc.utf8_length(pc.utf8_trim(values, "\r\ufeff")), 0).to_numpy(zero_copy_only=False))
                    head[filled[:1]] = True
                    headed = bool(len(filled))
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(split[0], n), pa.repeat(split[1], n), pa.repeat(pa.scalar(kind, pa.int32()), n), pa.array(head), values],
                    ["file", "first", "kind", "head", "value"],
                )

        for batch in filter(len, batches):
            def key(i, batch=batch):
                return tuple(batch[name][i].as_py() for name in ("file", "first", "size", "within"))

            # Lines of a split are neighbours.
            cuts = [0, len(batch)] if key(0) == key(len(batch) - 1) else [0, *(i for i in range(1, len(batch)) if key(i) != key(i - 1)), len(batch)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if key(start) != split:
                    if joiner:
                        yield from rows(joiner.end())
                    split, headed = key(start), False
                    if split[3] is None:
                        raise ValueError("the files have changed while they were read")
                    joiner = _Joiner(split[3])
                yield from rows(joiner.add(batch["value"].slice(start, end - start)))
        if joiner:
            yield from rows(joiner.end())

    starts = F.broadcast(_split_starts(spark, path).drop("odd"))
    lines = _lines(spark, path).join(starts, ["file", "first", "size"], "left").select("value", "file", "first", "size", "within")
    return lines.mapInArrow(run, "file string, first long, kind int, head boolean, value string")


def _crossing(pieces: DataFrame) -> DataFrame:
    """The records that cross splits, put together from their parts: at most two parts and the whole splits between for each split."""
    parts = pieces.where(F.col("kind") != _WHOLE)
    # In a split the end of a record comes before the start of the next.
    order = F.struct("first", F.when(F.col("kind") == _END, 0).otherwise(1))
    record = F.sum((F.col("kind") == _START).cast("int")).over(Window.partitionBy("file").orderBy(order))
    grouped = parts.select("file", "head", "value", "first", "kind", record.alias("record")).groupBy("file", "record")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda part: part["value"]), "\n")
    return grouped.agg(F.max("head").alias("head"), whole.alias("value")).select("head", "value")


def _misquoted(value: Column) -> Column:
    """Whether a quote stands in a field that is not quoted, or one does not end: what lies outside quotes begins and ends with a comma."""
    parts = F.split(value, '"')
    last = F.size(parts) - 1
    wrong = F.transform(
        parts,
        lambda part, i: (i % 2 == 0) & (part != "") & (((i > 0) & ~part.startswith(",")) | ((i < last) & ~part.endswith(","))),
    )
    return F.contains(value, F.lit('"')) & ((last % 2 == 1) | F.exists(wrong, lambda w: w))


def read_split_records(spark: SparkSession, path: str, crossed: bool, columns: list[str], options: Mapping[str, object]) -> DataFrame:
    """The records of all files as texts under these columns; each file starts with the same header.

    A record with a quote in a field that is not quoted fails, as its line
    breaks cannot be told from those of the file. Blank lines are no records.
    """
    options = {**{k: str(v) for k, v in options.items()}, "multiLine": "true", "mode": "FAILFAST"}
    # Any file's, as all have the same; its first record is all that is read.
    header = spark.read.options(header=False, inferSchema=False, **options).csv(path).first() or columns
    # Where the header holds a line break, Spark takes that for the end of lines and leaves another one's first half.
    header, columns = ([*names[:-1], names[-1] and names[-1].removesuffix("\r")] for names in (header, columns))
    pieces = _pieces(spark, path, crossed)
    records = pieces.where(F.col("kind") == _WHOLE).select("head", "value")
    if crossed:
        records = records.unionByName(_crossing(pieces))
    value = F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    value = F.when(F.col("head"), F.ltrim(value, F.lit("\ufeff"))).otherwise(value)
    records = records.select("head", value.alias("value")).where(F.col("value") != "")
    stop = F.raise_error(F.lit("a quote within a field that is not quoted, or one that does not end: read such files with multiline=True"))
    checked = F.when(_misquoted(F.col("value")), stop).otherwise(F.col("value"))
    texts = ", ".join(f"c{i} string" for i in range(len(columns)))
    parsed = records.select("head", F.from_csv(checked, texts, options).alias("row"))
    agree = F.lit(True)
    for i, name in enumerate(header):
        agree = agree & F.lower(F.col("row")[f"c{i}"]).eqNullSafe(F.lower(F.lit(name)))
    other = F.raise_error(F.lit("the header of a file differs from that of the others"))
    kept = parsed.where(F.when(F.col("head"), F.when(agree, F.lit(False)).otherwise(other)).otherwise(F.lit(True)))
    return kept.select(*[F.col("row")[f"c{i}"].alias(name) for i, name in enumerate(columns)])
