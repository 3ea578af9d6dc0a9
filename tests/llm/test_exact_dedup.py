import duckdb
from conftest_llm import SMALL, sha256
from pyspark.sql import functions as F

from rowferry.llm import exact_dedup

ROWS = [(1, "a"), (2, "b"), (5, "a"), (3, None), (4, ""), (None, "a"), (7, "A"), (8, "x" * 200_000), (9, "x" * 200_000), (9, "x" * 200_000), (10, "é")]


def expected(rows):
    found = []
    for i, text in rows:
        group = [j for j, other in rows if (other or "") == (text or "")]
        keep = max((j for j in group if j is not None), default=None)
        found.append((i, keep, len(group), i == keep, sha256(text or "")))
    return sorted(found, key=repr)


def decided(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "digest").collect()), key=repr)


def test_decisions(spark, documents):
    assert decided(exact_dedup.decide(spark, documents(ROWS))) == expected(ROWS)


def test_no_rows(spark, documents):
    assert decided(exact_dedup.decide(spark, documents([]))) == []


def test_texts_are_compared_where_digests_agree(spark, documents):
    found = exact_dedup.decide(spark, documents(ROWS), digest=lambda text: F.substring(F.sha2(text, 256), 1, 0))
    wanted = [row[:4] for row in expected(ROWS)]
    assert [row[:4] for row in decided(found)] == wanted


def test_state_goes_on(spark, tmp_path):
    keys, state = str(tmp_path / "keys"), str(tmp_path / "state")
    spark.createDataFrame([(1, "p", "f"), (2, "q", "f")], "doc_id long, digest string, locator string").write.parquet(keys)
    exact_dedup.absorb(spark, keys, state).collect()
    spark.createDataFrame([(3, "p", "g")], "doc_id long, digest string, locator string").write.mode("append").parquet(keys)
    held = {r.digest: (r.keeper.doc_id, r.keeper.locator, r.group_size) for r in exact_dedup.absorb(spark, keys, state).collect()}
    assert held == {"p": (3, "g", 2), "q": (2, "f", 1)}


def test_one_of_each_stays(spark, documents):
    kept = exact_dedup.without_copies(spark, documents(ROWS))
    assert kept.columns == documents(ROWS).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 7, 9, 10]


def test_query(spark):
    df = exact_dedup.op7_exact_dedup(spark, SMALL)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    wanted = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({exact_dedup.ORACLE})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(wanted)


def test_hot_digests_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 5)
    digests = ["hot"] * 400 + ["warm"] * 60 + [f"d{i}" for i in range(140)]
    keys = spark.createDataFrame(list(enumerate(digests)), "doc_id long, digest string")
    state = keys.groupBy("digest").agg(F.max(F.struct("doc_id")).alias("keeper"), F.count("*").alias("group_size"))
    found = exact_dedup.with_groups(keys, state)
    sizes = {r.doc_id: (r.digest, r.group_size, r.keeper.doc_id) for r in found.collect()}
    assert found.count() == 600 and sizes == {
        i: (d, digests.count(d), max(j for j, e in enumerate(digests) if e == d)) for i, d in enumerate(digests)
    }
    empty = exact_dedup.with_groups(keys.limit(0), state.limit(0))
    assert empty.count() == 0
