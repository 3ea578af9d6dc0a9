import math

import duckdb
import numpy as np
import pytest
from conftest_llm import SMALL
from pyspark.sql import functions as F

from rowferry.llm import knn_join

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cell int, part string, score double, row_id long, query string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "p", 0.5, 3, "q") for i, v in rows], SCHEMA)


def expected(rows, k, of):
    usable = [
        (at, i, [math.floor(256 * float(np.float32(c))) for c in v])
        for at, (i, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    found = []
    for at, i, v in usable:
        if i is None or i % of:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j) for other, j, w in usable if other != at]
        found += [(i, rank, j, -s) for rank, (s, _, _, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=repr)


def got(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


def odd_rows():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(60)]
    rows += [(100 + i, rows[4][1]) for i in range(30)]  # a third are copies of one: ties
    rows += [(10, rows[10][1]), (10, rows[10][1]), (None, rows[10][1]), (None, rng.normal(size=6).tolist())]
    rows += [(200, None), (205, [1.0, None] * 3), (210, [math.nan] * 6), (215, [math.inf] + [0.0] * 5), (220, [1.0]), (225, []), (230, [0.0] * 6)]
    return rows


@pytest.mark.parametrize(("group", "part"), [(1 << 25, 1 << 24), (150, 400)])
def test_against_brute_force(spark, group, part):
    rows = odd_rows()
    found = knn_join.top_k(spark, table(spark, rows), F.col("vec_id") % 5 == 0, 4, group_bytes=group, part_bytes=part)
    assert got(found) == expected(rows, 4, 5)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (50, [2.0, 1.0]), (3, None)]):
        assert got(knn_join.top_k(spark, table(spark, rows), F.col("vec_id") % 50 == 0, 5)) == expected(rows, 5, 50)


def test_large_components_are_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [3e9, -1.0]), (3, [1e30, 1.0])]
    scores = {r.vec_id: r.score for r in knn_join.top_k(spark, table(spark, rows), F.col("vec_id") == 0, 5).collect()}
    high = 256 * int(np.float32(3e9))
    assert scores[3] == 2**63 - 1
    assert scores[1] == min(high * high + 512 * 256, 2**63 - 1)


def test_only_near_cells_are_sent(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 40
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.2).tolist()) for i in range(600)]
    df = table(spark, rows)
    vectors = df.select("vec_id", knn_join.floored("embedding", 256).alias("x"))
    norm = float(max(np.linalg.norm(np.floor(256 * np.array(v)), axis=0) for _, v in rows)) * 1.001
    placed, cells = knn_join.place(spark, vectors, F.col("vec_id") % 10 == 0, 8, norm)
    wanted = knn_join.needs(placed, cells, 5, group_rows=6)
    held = placed.toPandas()
    sent = wanted.of(held["cell"].to_numpy(), held["away"].to_numpy())
    assert len(wanted.blocks) >= 6
    assert sent.mean() < 0.5
    found = knn_join.top_k(spark, df, F.col("vec_id") % 10 == 0, 5, group_bytes=6 * 64)
    assert got(found) == expected(rows, 5, 10)


def test_query(spark):
    df = knn_join.op11_knn_join(spark, SMALL)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    wanted = duck.sql(f"SELECT query_id, rank, vec_id, score FROM ({knn_join.ORACLE})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(wanted)
