import random

import pytest
from pyspark.sql import functions as F

from rowferry.operators import grouping, numbering, pages, results


def test_bounded_flags(spark):
    df = spark.range(10).orderBy(F.desc("id"))
    for cap, kept, truncated in ((9, 9, True), (10, 10, False), (11, 10, False), (0, 10, False), (-1, 10, False)):
        result = results.bounded(df, cap)
        rows = result.flagged.collect()
        assert [r.id for r in rows] == list(range(9, -1, -1))[:kept]
        assert {r.truncated for r in rows} == {truncated}
        envelope = results.bounded(df, cap, "select id", "mysql").envelope().first()
        assert (envelope.rows_returned, envelope.truncated) == (kept, truncated)


def test_empty_result_has_an_envelope(spark):
    row = results.run_sql(spark, "/* none */ SELECT 1 AS a, 'x' AS b WHERE false").envelope().first()
    assert row.asDict() == {
        "cols": ["a", "b"], "column_types": ["int", "string"], "rows_returned": 0, "truncated": False,
        "rows_affected": None, "stmt_cmd": "select", "stmt_type": "query",
    }


@pytest.fixture(scope="module")
def skewed(spark):
    """Twelve thousand rows; half of them share one group, and some have none."""
    rng = random.Random(5)
    groups = [None, "", "a", "b", "hot"] + [f"g{i}" for i in range(40)]
    rows = [(rng.choice(groups) if i % 2 else "hot", i * 7919 % 12_007, i) for i in range(12_000)]
    return spark.createDataFrame(rows, "g string, o int, v int").repartition(6).cache()


def expected_numbers(rows):
    counts, numbers = {}, {}
    for row in sorted(rows, key=lambda r: r.o):
        counts[row.g] = counts.get(row.g, 0) + 1
        numbers[row.v] = counts[row.g]
    return numbers


@pytest.mark.parametrize("ranges", [40, 3, 1, None])
def test_numbers_within_hot_groups(spark, skewed, ranges):
    numbered = numbering.number_rows(skewed, ["o"], ["g"], ranges=ranges)
    assert {r.v: r.row_number for r in numbered.collect()} == expected_numbers(skewed.collect())


@pytest.mark.parametrize("ranges", [40, 3, 1, None])
def test_numbers_over_all_rows(spark, skewed, ranges):
    numbered = numbering.number_rows(skewed, ["g", "o"], ranges=ranges)
    order = sorted(skewed.collect(), key=lambda r: (r.g is not None, r.g or "", r.o))
    assert {r.v: r.row_number for r in numbered.collect()} == {r.v: i for i, r in enumerate(order, start=1)}


def test_hot_groups_are_split(spark, skewed):
    placed = numbering.write_ranges(skewed, ["g", "o"], 40)
    sizes = [r["count"] for r in placed.groupBy(numbering.RANGE).count().collect()]
    assert len(sizes) >= 30 and sum(sizes) == 12_000 and max(sizes) < 4 * 300
    # One shuffle of the rows: all that is joined with them afterwards is small.
    numbered = numbering.number_rows(skewed, ["o"], ["g"], ranges=40)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and plan.count("BroadcastHashJoin") == 1


def test_no_rows_to_number(spark):
    empty = spark.createDataFrame([], "g string, o int")
    assert numbering.number_rows(empty, ["o"], ["g"]).columns == ["g", "o", "row_number"]
    assert numbering.number_rows(empty, ["o"], ["g"]).count() == numbering.number_rows(empty, ["o"]).count() == 0
    assert results.page(empty, ["o"], 1_000).count() == 0


@pytest.mark.parametrize("kind", ["double", "string", "timestamp_ntz", "timestamp", "decimal(20,3)", "date"])
def test_numbers_for_all_key_types(spark, kind):
    base = spark.range(2_000)
    keys = {
        "double": (F.col("id") - 1_000) / 7,
        "string": F.concat(F.lit("é"), F.xxhash64("id").cast("string")),
        "date": F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")),
        "decimal(20,3)": (F.col("id") * F.lit(1.001)).cast("decimal(20,3)"),
    }
    key = keys.get(kind, F.timestamp_micros(F.col("id") * 86_399_999_999)).cast(kind).alias("k")
    df = base.select(F.when(F.col("id") > 0, key).alias("k"), "id")
    numbered = numbering.number_rows(df, ["k"], ranges=20).collect()
    in_order = [r.id for r in df.orderBy("k").collect()]
    assert [r.id for r in sorted(numbered, key=lambda r: r.row_number)] == in_order


def test_late_pages_push_a_bound(spark, tmp_path):
    spark.range(30_000).write.parquet(str(tmp_path / "t"))
    page = results.page(spark.read.parquet(str(tmp_path / "t")), ["id"], 1_000)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id" in plan and "LessThanOrEqual(id" in plan
    assert [r.id for r in page.collect()] == list(range(15_000, 15_015))


@pytest.mark.parametrize("number", [0, 1, 700, 799, 800, 10_000])
def test_pages(spark, skewed, number):
    page = [r.v for r in results.page(skewed, ["o"], number).collect()]
    order = [r.v for r in sorted(skewed.collect(), key=lambda r: r.o)]
    assert page == order[number * 15 : number * 15 + 15]


def test_late_pages_with_nulls_first(spark):
    df = spark.range(25_000).select(F.when(F.col("id") >= 12_000, F.col("id")).alias("a"), "id")
    for number in (700, 799, 800, 801, 1_600):
        page = [r.id for r in results.page(df, ["a", "id"], number).collect()]
        assert page == list(range(number * 15, number * 15 + 15))


@pytest.mark.parametrize("number", [0, 1, 2, 3, 4])
def test_pages_larger_than_a_top_k(spark, number):
    df = spark.range(22_000).select(((F.col("id") * 7919) % 22_000).alias("k"))
    page = [r.k for r in results.page(df, ["k"], number, size=6_000).collect()]
    assert page == list(range(number * 6_000, min(22_000, number * 6_000 + 6_000)))


@pytest.mark.parametrize("order_by", [["k"], ["a", "k"]])
@pytest.mark.parametrize("ranges", [1, 4])
def test_every_page_of_an_index(spark, order_by, ranges):
    df = spark.range(990).select(F.when(F.col("id") >= 300, F.lit(1)).alias("a"), F.col("id").alias("k")).cache()
    index = pages.build_index(df, order_by, stretch=100, ranges=ranges)
    for size in (15, 100, 330, 600):
        for number in sorted({*range(0, -(-990 // size) + 2, 1 + 60 // size), 989 // size, 990 // size, 1_000}):
            page = [r.k for r in index.page(df, number, size).collect()]
            assert page == list(range(number * size, min(990, number * size + size)))


def test_index_of_a_table_is_kept(spark):
    spark.sql("DROP TABLE IF EXISTS paged")
    spark.range(30_000).select(((F.col("id") * 7919) % 30_000).alias("k"), F.lit("x").alias("t")).write.saveAsTable("paged")
    index = pages.table_index(spark, "paged", ["k"])
    tracker = spark.sparkContext.statusTracker()

    def jobs(number):
        spark.sparkContext.setJobGroup(f"page {number}", "")
        page = pages.page_of_table(spark, "paged", ["k"], number, 15)
        assert pages.table_index(spark, "paged", ["k"]) == index
        spark.sparkContext.setJobGroup("", "")
        return page, len(tracker.getJobIdsForGroup(f"page {number}"))

    page, ran = jobs(1_500)
    assert ran <= 2, "one lookup, which adaptive execution runs as two jobs"
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k" in plan and "LessThanOrEqual(k" in plan
    assert [r.k for r in page.collect()] == list(range(22_500, 22_515))
    spark.sql("INSERT INTO paged VALUES (-1, 'new')")
    assert pages.table_index(spark, "paged", ["k"]) != index
    assert [r.k for r in pages.page_of_table(spark, "paged", ["k"], 1_500, 15).collect()] == list(range(22_499, 22_514))
    spark.sql("DROP TABLE paged")


def test_page_count(spark):
    counts = spark.createDataFrame([(0,), (1,), (15,), (16,)], "n long")
    assert [r[0] for r in counts.select(results.page_count(F.col("n"))).collect()] == [0, 1, 1, 2]


def test_page_index(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    rows = results.page_index(df, ["k"], ranges=5).collect()
    assert {(r.k, r.page, r.place) for r in rows} == {(k, k // 15, k % 15 + 1) for k in range(100)}


def test_header_sample(spark):
    df = spark.createDataFrame([(2, None), (1, 2.0)], "id int, x double")
    rows = results.header_sample(df, ["id"]).orderBy("place").collect()
    assert [tuple(r) for r in rows] == [(1, "1", "2"), (2, "2", "null"), (11, "id", "x")]


def test_display_profile(spark):
    df = spark.createDataFrame(
        [(1, None, [1, None], "😀a", 1e6), (12345, "abcdef", None, None, None)],
        "i int, s string, long_name array<int>, u string, f double",
    )
    rows = {r.column_name: r.max_length for r in results.display_profile(df).collect()}
    assert rows == {"i": 5, "s": 6, "long_name": 9, "u": 4, "f": 7}
    empty = {r.column_name: r.max_length for r in results.display_profile(df.where("i < 0")).collect()}
    assert empty == {"i": 2, "s": 2, "long_name": 9, "u": 2, "f": 2}


def test_statements_report_the_rows_they_write(spark):
    spark.sql("CREATE TABLE written (a INT) USING parquet")
    try:
        done = results.run_sql(spark, "insert into written select cast(id as int) from range(7) where id > :least", args={"least": 2}, vendor="mysql")
        row = done.envelope().first()
        assert (row.rows_affected, row.rows_returned, row.stmt_cmd) == (4, 0, "insert")
        assert spark.table("written").count() == 4  # it ran once
        asked = results.run_sql(spark, "select a from written order by a", cap=3, schema="default")
        assert [r.a for r in asked.rows.collect()] == [3, 4, 5]
        assert asked.envelope().first().rows_affected is None
    finally:
        spark.sql("DROP TABLE written")


def widths(spark, lengths, available):
    profile = spark.createDataFrame(list(enumerate(lengths)), "position int, max_length int")
    return [r.width for r in results.with_widths(profile, available).orderBy("position").collect()]


def test_widths_by_hand(spark):
    # All fit: 2 * 6.5 + 12 = 25 and 10 * 6.5 + 12 = 77, plus a fifth of 102 shared by two.
    assert widths(spark, [2, 10], 1000) == [35, 87]
    # The narrow one gets 25, the wide ones share 275; what a column takes is whole.
    assert widths(spark, [2, 100, 100], 300) == [25, 137, 138]
    assert widths(spark, [100, 100], 300) == [150, 150]
    # Spare width below a fifth: 25 + 25 of 55 leaves 5, two each.
    assert widths(spark, [2, 2], 55) == [27, 27]
    assert widths(spark, [], 100) == []
    # Three wide ones share the 417.5 that 25 and 57.5 leave of 500.
    assert widths(spark, [90, 7, 80, 2, 85], 500) == [139, 57, 139, 25, 139]
    assert widths(spark, [90, 80, 85], 500) == [166, 167, 167]


def sub_millisecond(spark, rows=3_000):
    """Three moments a microsecond apart, each with many rows."""
    moment = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") % 3)
    return spark.range(rows).select(moment.alias("ts"), (F.col("id") * 7919 % rows).alias("x"), "id").repartition(5)


def test_late_pages_below_a_millisecond(spark, monkeypatch):
    monkeypatch.setattr(results, "STRETCH", 300)
    df = sub_millisecond(spark)
    order = [r.id for r in sorted(df.collect(), key=lambda r: (r.ts, r.x))]
    for number in (0, 19, 20, 67, 133, 199, 200):
        assert [r.id for r in results.page(df, ["ts", "x"], number).collect()] == order[number * 15 : number * 15 + 15]


def test_groups_below_a_millisecond(spark):
    df = sub_millisecond(spark)
    numbered = numbering.number_rows(df, ["x"], ["ts"], ranges=30).collect()
    seen = {}
    for row in sorted(numbered, key=lambda r: (r.ts, r.x)):
        seen[row.ts] = seen.get(row.ts, 0) + 1
        assert row.row_number == seen[row.ts]


@pytest.mark.parametrize("kind", ["float", "double", "decimal(20,6)", "binary", "date", "timestamp_ntz", "string"])
def test_keys_of_other_types(spark, monkeypatch, kind):
    monkeypatch.setattr(results, "STRETCH", 100)
    number = F.col("id") * 7919 % 1_000
    made = {
        "binary": F.lpad(number.cast("string"), 4, "0").cast("binary"),
        "string": F.concat(F.lit("\u00e9\""), F.lpad(number.cast("string"), 4, "0")),
        "date": F.date_add(F.lit("2000-01-01").cast("date"), number.cast("int")),
        "timestamp_ntz": F.timestamp_micros(number + 1_700_000_000_000_000).cast("timestamp_ntz"),
    }
    df = spark.range(1_000).select(made.get(kind, number / 1_000).cast(kind).alias("k"), number.alias("n"))
    for page in (3, 30, 66):
        assert [r.n for r in results.page(df, ["k"], page).collect()] == list(range(page * 15, min(1_000, page * 15 + 15)))


def test_group_options(spark, skewed):
    options = grouping.group_options(skewed, "g", "v", "o", "o", ranges=40).collect()
    rows = skewed.collect()
    expected = {}
    for row in sorted(rows, key=lambda r: r.o):
        expected.setdefault(row.g or "", []).append(row)
    assert len(options) == len(rows)
    for option in options:
        group = expected[option.group]
        assert (option.value, option.label) == (group[option.place - 1].v, group[option.place - 1].o)
        assert option.group_order == group[0].o


def test_concatenated_lines(spark):
    first = -3
    lines = spark.range(20_002).select((F.col("id") % 2).alias("k"), (F.floor(F.col("id") / 2) + first).alias("n"), F.concat("id", F.lit(";")).alias("t"))
    texts = {r.k: r.text for r in grouping.concat_lines(lines.repartition(7), ["k"], "n", "t").collect()}
    assert texts == {k: "".join(f"{i};" for i in range(k, 20_002, 2)) for k in (0, 1)}


def test_definition_texts(spark):
    single = spark.createDataFrame([("v", 1, "x", "create view v"), ("w", 1, "y", "")], "o string, n int, name string, `Create View` string")
    found = grouping.definition_text(single, ["o"], "n", ["name", "Create View"]).collect()
    assert {r.o: r.text for r in found} == {"v": "create view v", "w": "y"}
    lines = spark.createDataFrame([("p", 2, "b"), ("p", 1, "a"), ("q", 1, "z")], "o string, n int, text string")
    joined = grouping.definition_text(lines, ["o"], "n", ["text"]).collect()
    assert {r.o: r.text for r in joined} == {"p": "ab", "q": "z"}


def test_create_table(spark):
    columns = spark.range(25).select(F.lit("t").alias("tab"), F.col("id").alias("n"), F.concat(F.lit("c"), "id").alias("name"))
    made = grouping.create_table_ddl(columns.repartition(5), ["tab"], "n", F.col("tab"), F.col("name"), F.lit("INT"), "mysql")
    assert [r.text for r in made.collect()] == ["CREATE TABLE `t` (" + ",".join(f"`c{i}` INT" for i in range(25)) + ")"]
