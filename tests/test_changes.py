"""Changes of catalog tables: published versions, and inserts that keep constraints."""

import uuid

import pytest
from pyspark.sql import functions as F

from rowferry.endpoint import Endpoint
from rowferry.operators import access
from rowferry.operators.constraints import ConstraintViolation, Rule, broken_rules, checked_append
from rowferry.operators.versions import TableBusy, TableMoved, change_table, exclusive, location_of
from rowferry.sources.tables import create_table


@pytest.fixture(params=["managed", "external"])
def grants(spark, request, tmp_path):
    name = f"grants_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, None)], "user_id int, ds_id int")
    create_table(rows, Endpoint("table", table=name, options={"path": str(tmp_path / "grants")} if request.param == "external" else {}))
    yield name
    spark.sql(f"DROP TABLE {name}")


def rows(spark, table):
    return sorted(map(tuple, spark.table(table).collect()), key=repr)


BEFORE = [(1, 1), (1, 2), (2, 2), (3, None)]


def test_revoke_and_update_reach_the_table(spark, grants):
    users = spark.createDataFrame([("ann", 1), ("bob", 0)], "name string, isadmin int")
    doomed = spark.createDataFrame([(1, 2), (3, None), (9, 9)], "user_id int, ds_id int")
    assert not access.revoke_from(grants, doomed, ["user_id", "ds_id"], access.admin_gate(users, "bob"))
    assert rows(spark, grants) == BEFORE
    first = location_of(spark, grants)
    assert access.revoke_from(grants, doomed, ["user_id", "ds_id"], access.admin_gate(users, "ann"))
    assert rows(spark, grants) == [(1, 1), (2, 2), (3, None)]  # a null equals nothing
    second = location_of(spark, grants)
    assert access.update_table(grants, "ds_id", F.col("ds_id").isNull(), F.lit(7), access.admin_gate(users, "ann"))
    assert rows(spark, grants) == [(1, 1), (2, 2), (3, 7)]
    assert len({first, second, location_of(spark, grants)}) == 3
    assert spark.read.parquet(first).count() == 4  # what a running query still reads
    spark.sql(f"INSERT INTO {grants} VALUES (5, 5)")
    assert (5, 5) in rows(spark, grants)


def test_a_failing_task_leaves_the_old_version(spark, grants, tmp_path):
    location = location_of(spark, grants)
    bad = F.when(F.col("user_id") == 2, F.raise_error(F.lit("no such luck")).cast("int")).otherwise(F.col("ds_id"))
    with pytest.raises(Exception, match="no such luck"):
        change_table(spark, grants, lambda df: df.withColumn("ds_id", bad))
    assert location_of(spark, grants) == location and rows(spark, grants) == BEFORE
    change_table(spark, grants, lambda df: df.where("user_id = 1"))  # it is not held any more
    assert rows(spark, grants) == [(1, 1), (1, 2)]


def test_a_second_writer_leaves_the_old_version(spark, grants):
    def meanwhile(df):
        spark.sql(f"INSERT INTO {grants} VALUES (8, 8)")
        return df.where("user_id = 1")

    location = location_of(spark, grants)
    with pytest.raises(TableMoved):
        change_table(spark, grants, meanwhile)
    assert location_of(spark, grants) == location and rows(spark, grants) == [*BEFORE, (8, 8)]


def test_two_writers_at_once(spark, grants):
    with exclusive(spark, grants):
        with pytest.raises(TableBusy, match="lock"):
            change_table(spark, grants, lambda df: df)
        with pytest.raises(TableBusy):
            checked_append(spark, grants, spark.table(grants), [])
    assert rows(spark, grants) == BEFORE


def test_a_new_version_of_no_rows(spark, grants):
    change_table(spark, grants, lambda df: df.where(F.lit(False)))
    assert rows(spark, grants) == [] and spark.table(grants).columns == ["user_id", "ds_id"]


def test_partitioned_tables_are_refused(spark):
    name = f"parts_{uuid.uuid4().hex}"
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").saveAsTable(name)
    with pytest.raises(ValueError, match="partitioned"):
        change_table(spark, name, lambda df: df)
    spark.sql(f"DROP TABLE {name}")


RULES = [
    Rule("one_grant", "unique", ("user_id", "ds_id")),
    Rule("known_source", "foreign_key", ("ds_id",), "sources_of_test", ("id",)),
    Rule("user_given", "not_null", ("user_id",)),
    Rule("small_user", "check", condition="user_id < 100"),
]


@pytest.mark.parametrize(
    ("batch", "broken"),
    [
        ([(4, 1), (5, 2)], {}),
        ([(4, None), (4, None), (3, None)], {}),  # a key with a null is exempt
        ([(1, 1), (4, 1)], {"one_grant": 1}),
        ([(4, 1), (4, 1), (4, 1), (5, 1)], {"one_grant": 3}),
        ([(4, 9), (5, 9), (6, 1)], {"known_source": 2}),
        ([(None, 1), (100, 1), (101, 9)], {"user_given": 1, "small_user": 2, "known_source": 1}),
        ([], {}),
    ],
)
def test_inserts_keep_the_rules(spark, grants, batch, broken):
    spark.createDataFrame([(1,), (2,)], "id int").createOrReplaceTempView("sources_of_test")
    new = spark.createDataFrame(batch, "user_id int, ds_id int")
    if broken:
        with pytest.raises(ConstraintViolation) as refused:
            checked_append(spark, grants, new, RULES)
        assert refused.value.broken == broken and all(name in str(refused.value) for name in broken)
        assert rows(spark, grants) == BEFORE
    else:
        assert checked_append(spark, grants, new, RULES) == len(batch)
        assert rows(spark, grants) == sorted([*BEFORE, *batch], key=repr)


def test_a_closed_gate_inserts_nothing(spark, grants):
    new = spark.createDataFrame([(4, 1)], "user_id int, ds_id int")
    assert checked_append(spark, grants, new, RULES[2:], gate=new.where("user_id = 0")) == 0
    assert rows(spark, grants) == BEFORE


def test_a_key_to_the_table_itself(spark):
    people = spark.createDataFrame([(1, None)], "id int, boss int")
    name = f"people_{uuid.uuid4().hex}"
    create_table(people, Endpoint("table", table=name))
    rule = Rule("known_boss", "foreign_key", ("boss",), name, ("id",))
    new = spark.createDataFrame([(2, 1), (3, 2), (4, 9)], "id int, boss int")
    assert [tuple(r) for r in broken_rules(new, spark.table(name), name, [rule]).collect()] == [("known_boss", 1)]
    assert checked_append(spark, name, new.where("id < 4"), [rule]) == 2
    spark.sql(f"DROP TABLE {name}")


def test_rules_are_of_known_kinds():
    with pytest.raises(ValueError, match="kind"):
        Rule("x", "exclusion")
