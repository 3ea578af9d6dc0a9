import math

import numpy as np
import pytest
from conftest_llm import SMALL

from rowferry.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, at int, n string, component string"
COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "n", "c") for i, v in rows], SCHEMA)


def expected(rows, wanted=16):
    """(vec_id, deviation, whitened values) of each row, and the parts explained."""
    width = max(len(v) for _, v in rows)
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    e, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = [i for i in np.argsort(-e) if e[i] > 1e-12 * e.max()][:wanted]
    away = n * x.astype(object) - sums
    return n, [int(sum(d * d for d in row)) for row in away], (x - sums / n) @ (vectors[:, order] / np.sqrt(e[order])), e[order] / e.sum()


def check(df, rows, precise=1e-9):
    assert df.columns == COLUMNS
    found = df.toPandas()
    n, deviations, whitened, explained = expected(rows)
    count = len(explained)
    assert len(found) == len(rows) * count
    assert set(found["n"]) == {n}
    assert found["identity_error"].nunique() == 1 and found["identity_error"].max() < 1e-9
    assert np.allclose(found.groupby("component")["explained"].first(), explained, rtol=1e-9)
    by_row = {}
    for at, (vec_id, _) in enumerate(rows):
        by_row.setdefault(vec_id, []).append((deviations[at], whitened[at]))
    wide = [(key, part.sort_values("component")) for key, part in found.groupby(found.index // count)]
    flips = None
    for _, part in wide:
        vec_id = None if part["vec_id"].isna().any() else int(part["vec_id"].iloc[0])
        options = by_row[vec_id]
        values = part["whitened"].to_numpy()
        if flips is None and len(options) == 1:
            flips = np.sign(values * options[0][1])
        assert any(d == part["deviation"].iloc[0] and np.allclose(np.abs(values), np.abs(w), atol=precise) for d, w in options)
        if flips is not None and len(options) == 1:
            assert np.allclose(values, flips * options[0][1], atol=precise)


@pytest.fixture(scope="module")
def varied():
    rng = np.random.default_rng(2)
    return (rng.normal(size=(150, 20)) * np.linspace(0.3, 3, 20)).tolist()


def test_against_eigenvectors(spark, varied):
    rows = [(i + 1, v) for i, v in enumerate(varied)]
    copies = [(1000 + i, varied[3]) for i in range(60)] + [(7, varied[8]), (7, varied[8]), (None, varied[9])]
    odd = [(300, None), (301, [None] * 20), (302, [math.nan] * 20), (303, [-math.inf] + [0.0] * 19)]
    check(whitening.whiten(spark, table(spark, rows + copies + odd)), rows + copies)


def test_lower_rank(spark, varied):
    flat = [[v[0], 5.0, v[1], v[0], 0.0, v[2]] for v in varied]
    rows = [(i, v) for i, v in enumerate(flat)]
    df = whitening.whiten(spark, table(spark, rows))
    assert df.agg({"component": "max"}).first()[0] == 3
    check(df, rows)


def test_blocks_of_a_long_vector(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=70) * 2.0 ** -np.arange(70).clip(0, 5)).tolist()) for i in range(120)]
    check(whitening.whiten(spark, table(spark, rows)), rows, precise=1e-7)


def test_short_vectors_are_filled(spark, varied):
    rows = [(i, v[: 20 if i % 9 else 4]) for i, v in enumerate(varied)]
    check(whitening.whiten(spark, table(spark, rows)), rows)


def test_few_rows(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], [(1, [])]):
        df = whitening.whiten(spark, table(spark, rows))
        assert df.columns == COLUMNS and df.count() == 0


def test_deviations_beyond_64_bits(spark):
    rows = [(1, [0.0, 1e12]), (2, [1.0, -1e12]), (3, [2.0, 0.0])]
    assert {r.deviation for r in whitening.whiten(spark, table(spark, rows)).where("vec_id < 3").collect()} == {None}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(whitening.op13_whitening(spark, SMALL), rows, precise=1e-8)
