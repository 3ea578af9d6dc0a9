"""Exact top-k search by inner product: a join of queries and data over the cells of a Voronoi diagram."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowferry.llm.scratch import stored
from rowferry.llm.vectors import floored, matrix, usable
from rowferry.plans.session import ship_package

#: Cells of the diagram, and the rows among which their pivots are chosen. Tables of cells by cells are all that tasks get.
PIVOTS, SAMPLE = 64, 256

#: Bytes of vectors that a task holds of a group of queries, and of a part of the data.
GROUP_BYTES, PART_BYTES = 1 << 25, 1 << 24

#: Scores that are computed together.
_SCORES = 1 << 21

_LARGE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Cells:
    """Pivots of data and of queries, and the norm that all vectors are lifted to.

    A data vector x becomes (x, sqrt(norm^2 - |x|^2)) and a query q becomes
    (q, 0). Then |q - x|^2 = |q|^2 + norm^2 - 2 <q, x>: the nearest are those
    with the highest inner products, and the triangle inequality holds.
    """

    pivots: np.ndarray
    query_pivots: np.ndarray
    norm: float

    def lifted(self, rows: np.ndarray, query: bool) -> np.ndarray:
        rows = rows.astype(np.float64)
        last = np.zeros(len(rows)) if query else np.sqrt(np.maximum(self.norm**2 - (rows**2).sum(axis=1), 0))
        return np.column_stack([rows, last])

    def nearest(self, rows: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its distance to that cell's pivot."""
        points, pivots = self.lifted(rows, query), self.query_pivots if query else self.pivots
        cell = ((pivots**2).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)
        return cell.astype(np.int32), np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))


def _spread(rows: np.ndarray, most: int) -> np.ndarray:
    """So many of the rows, each the farthest from those before it."""
    if not len(rows):
        return rows
    chosen = [0]
    away = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < most and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def place(spark: SparkSession, vectors: DataFrame, query: Column, width: int, norm: float) -> tuple[DataFrame, Cells]:
    """Each usable row as row_id, vec_id, x, query, cell, away (as data), query_cell, query_away (as a query); and the cells."""
    rows = vectors.select("vec_id", "x", query.alias("query"))
    nothing = np.empty((0, width + 1))
    cells = Cells(nothing, nothing, norm)
    data, asked = (
        matrix(some.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).select("x").toArrow()["x"], width) for some in (rows, rows.where("query"))
    )
    cells = Cells(_spread(cells.lifted(data, False), PIVOTS), _spread(cells.lifted(asked, True), PIVOTS), norm)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            found, wanted = matrix(batch["x"], width), batch["query"].to_numpy(zero_copy_only=False)
            asked = [np.zeros(len(found), np.int32), np.zeros(len(found))]
            if wanted.any():
                asked[0][wanted], asked[1][wanted] = cells.nearest(found[wanted], True)
            made = [pa.array(a) for a in (*cells.nearest(found, False), *asked)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "cell", "away", "query_cell", "query_away"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"row_id long, vec_id {kind}, x array<long>, query boolean, cell int, away double, query_cell int, query_away double"
    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), "vec_id", "x", "query")
    return stored(spark, numbered.mapInArrow(assign, schema), "knn-cells")[0], cells


@dataclass(frozen=True)
class Needs:
    """Which data each group of queries needs, from summaries of the cells.

    least and most, by query cell and data cell: the distances to the data
    cell's pivot within which a row may be among the nearest of some query.
    group: of each query cell, -1 without queries; blocks: of each group.
    """

    least: np.ndarray
    most: np.ndarray
    group: np.ndarray
    blocks: np.ndarray

    def of(self, cell: np.ndarray, away: np.ndarray) -> np.ndarray:
        """Rows by groups: does the group need the row."""
        wanted = np.zeros((len(cell), len(self.blocks)), bool)
        for i in np.flatnonzero(self.group >= 0):
            wanted[:, self.group[i]] |= (self.least[i, cell] <= away) & (away <= self.most[i, cell])
        return wanted


def needs(placed: DataFrame, cells: Cells, k: int, group_rows: int) -> Needs:
    """Bounds and groups, from the farthest query of each cell and the k + 1 nearest rows of each data cell.

    All queries of a cell have k rows besides their own within the bound: the
    distance of the farthest query, of the two pivots and of the row to its
    pivot, added up, the k + 1st smallest of these sums.
    """
    count = len(cells.query_pivots)
    radius, queries = np.zeros(count), np.zeros(count, np.int64)
    for row in placed.where("query").groupBy("query_cell").agg(F.max("query_away").alias("far"), F.count("*").alias("n")).collect():
        radius[row.query_cell], queries[row.query_cell] = row.far, row.n
    by_distance = Window.partitionBy("cell").orderBy("away")
    near = placed.select("cell", "away", F.row_number().over(by_distance).alias("place")).where(F.col("place") <= k + 1)
    near = near.collect()  # k + 1 rows of each cell at most
    between, among = (np.sqrt(((cells.query_pivots[:, None] - some[None]) ** 2).sum(axis=2)) for some in (cells.pivots, cells.query_pivots))
    sums = np.sort(between[:, [r.cell for r in near]] + np.array([r.away for r in near]), axis=1)
    reach = radius + sums[:, k] if len(near) > k else np.full(count, np.inf)
    slack = 1e-6 * (1 + cells.norm + radius + between.max(initial=0))
    reach = (reach + slack)[:, None]
    group, sizes = np.full(count, -1), []
    left = set(np.flatnonzero(queries).tolist())
    while left:
        seed = min(left)
        size = 0
        for i in sorted(left, key=lambda i: among[seed, i]):
            if size and size + queries[i] > group_rows:
                break
            group[i], size = len(sizes), size + int(queries[i])
            left.discard(i)
        sizes.append(size)
    blocks = -(-np.array(sizes, np.int64) // group_rows)
    return Needs(between - radius[:, None] - reach, between + radius[:, None] + reach, group, blocks)


def scores_of(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Inner products, exact; those beyond 64 bits count as the largest or smallest number of 64 bits."""
    most = [int(max(a.max(initial=0), -a.min(initial=0))) for a in (queries, data)]
    if most[0] * most[1] * max(1, queries.shape[1]) < 1 << 53:
        return (queries.astype(np.float64) @ data.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ data.astype(object).T
    return np.clip(exact, -_LARGE - 1, _LARGE).astype(np.int64)


def best(queries: np.ndarray, own: np.ndarray, data: np.ndarray, rows: np.ndarray, names: np.ndarray, k: int):
    """(query, data row, score) of the k best of each query, ties to the smaller name; own and rows tell a row from itself."""
    found = []
    step = max(1, _SCORES // max(1, len(data)))
    for at in range(0, len(queries), step):
        scores = scores_of(queries[at : at + step], data)
        itself = own[at : at + step, None] == rows
        least = np.full(len(scores), -_LARGE - 1)
        if len(data) > k + 1:  # a row itself may be one of them
            least = np.partition(scores, len(data) - k - 1, axis=1)[:, len(data) - k - 1]
        q, d = np.nonzero((scores >= least[:, None]) & ~itself)
        s = scores[q, d]
        order = np.lexsort((names[d], np.invert(s), q))
        q, d, s = q[order], d[order], s[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < k
        found.append((q[keep] + at, d[keep], s[keep]))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 3


def top_k(
    spark: SparkSession, vectors: DataFrame, query: Column, k: int, factor: int = 256,
    group_bytes: int = GROUP_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with query, the k other rows with the highest scores.

    The score is the inner product of the vectors after floor(factor * c);
    ties go to the smaller vec_id, null last. Vectors that are null or hold
    null or non-finite components take no part. A shorter vector counts as
    filled with zeros. Rows that repeat a vec_id are rows of their own: each is
    a query, and one finds the other. No row gives no result; fewer than k
    others give all of them. Components beyond 2^55 and scores beyond 64 bits
    count as the limit. Other columns are not read.

    Rows go to the cell of their nearest pivot. From the summaries of the cells
    (PIVOTS rows of counts and distances) follow the distances between which a
    row can matter to a group of query cells; only then it is sent there. A
    group has as many queries as a task may hold, a large cell is dealt out in
    blocks, and the data of a group in parts, by a hash, so that neither a hot
    cell nor a group of copies meets in one task.
    """
    ship_package(spark)
    rows = vectors.where(usable("embedding")).select("vec_id", floored("embedding", factor).alias("x"), query.alias("query"))
    square = F.aggregate("x", F.lit(0.0), lambda total, c: total + c.cast("double") * c)
    width, count, norm = rows.agg(F.max(F.size("x")), F.count("*"), F.max(square)).first()
    width = width or 0
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"query_row long, query_id {kind}, row_id long, vec_id {kind}, score long"
    # The lifted coordinate is a root of a difference: a little above the largest norm keeps it real.
    placed, cells = place(spark, rows, F.coalesce("query", F.lit(False)), width, float(np.sqrt(norm or 0.0)) * (1 + 1e-9))
    group_rows = max(1, group_bytes // (8 * max(1, width)))
    wanted = needs(placed, cells, k, group_rows)
    most = max(1, part_bytes // (8 * max(1, width)))
    parts = max(-(-count // most), min(3 * spark.sparkContext.defaultParallelism, -(-count // 1024)), 1)

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            needed = wanted.of(batch["cell"].to_numpy(), batch["away"].to_numpy())
            r, g = np.nonzero(needed)
            starts = np.searchsorted(r, np.arange(len(needed) + 1)).astype(np.int32)
            groups = pa.ListArray.from_arrays(pa.array(starts), pa.array(g.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch["row_id"], batch["vec_id"], batch["x"], groups], ["row_id", "vec_id", "x", "groups"])

    blocks = F.array(*[F.lit(int(b)) for b in wanted.blocks]).cast("array<int>")
    group_of = F.array(*[F.lit(int(g)) for g in wanted.group]).cast("array<int>")
    sent = placed.select("row_id", "vec_id", "x", "cell", "away").mapInArrow(routes, f"row_id long, vec_id {kind}, x array<long>, groups array<int>")
    sent = sent.select("row_id", "vec_id", "x", F.explode("groups").alias("group"))
    sent = sent.select("*", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("group")) - 1)).alias("block"))
    sent = sent.withColumn("part", F.pmod(F.xxhash64("row_id"), F.lit(parts)).cast("int"))
    asked = placed.where("query").select("row_id", "vec_id", "x", F.get(group_of, F.col("query_cell")).alias("group"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("row_id"), F.get(blocks, F.col("group"))).cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right["vec_id"].combine_chunks()
        names = ids.fill_null(_LARGE).to_numpy(zero_copy_only=False)
        own, there = (t["row_id"].to_numpy() for t in (left, right))
        q, d, s = best(matrix(left["x"], width), own, matrix(right["x"], width), there, names, k)
        return pa.table({"query_row": own[q], "query_id": left["vec_id"].take(q), "row_id": there[d], "vec_id": ids.take(pa.array(d)), "score": s})

    key = ["group", "block", "part"]
    found = asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(solve, schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
         s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.x, d.x)::BIGINT AS score
               FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank::INT AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
