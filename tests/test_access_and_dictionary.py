import pytest
from pyspark.sql import functions as F

from rowferry.operators import access, audits, dictionary


@pytest.fixture(scope="module")
def catalog(spark):
    users = spark.createDataFrame([(1, "admin", 1), (2, "ann", 0), (3, "bob", 0)], "id int, name string, isadmin int")
    grants = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2)], "user_id int, ds_id int")
    sources = spark.createDataFrame(
        [(1, "own", "/x.db", "1"), (2, "big", "secret", "2"), (3, "free", "secret3", "2")],
        "id int, name string, location string, vendor_id string",
    )
    vendors = spark.createDataFrame([(1, "sqlite3"), (2, "mssql")], "id int, name string")
    return users, grants, sources, vendors


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_entitlements(catalog):
    assert rows(access.entitled(*catalog, principal="ann")) == [
        ("ann", "big", "mssql", ""), ("ann", "own", "sqlite3", "/x.db"),
    ]
    assert rows(access.entitled(*catalog, principal="admin")) == [
        ("admin", "own", "sqlite3", "/x.db"), ("ann", "big", "mssql", "secret"),
        ("ann", "own", "sqlite3", "/x.db"), ("bob", "big", "mssql", "secret"),
    ]
    assert rows(access.entitled(*catalog, principal="ann", user_name="bob")) == []
    assert rows(access.entitled(*catalog, principal="nobody")) == []


def test_visible_users(catalog):
    users = catalog[0]
    assert rows(access.visible_users(users, "ann")) == [("ann", 0)]
    assert len(rows(access.visible_users(users, "admin"))) == 3
    assert rows(access.visible_users(users, "nobody")) == []


def test_ungranted(catalog):
    assert rows(access.ungranted(*catalog, principal="admin", user_name="bob")) == [
        ("free", "mssql", "secret3"), ("own", "sqlite3", "/x.db"),
    ]
    assert rows(access.ungranted(*catalog, principal="ann", user_name="bob")) == []
    assert len(rows(access.ungranted(*catalog, principal="admin", user_name="nobody"))) == 3


def test_required_rows(catalog):
    rows_of_ann = access.entitled(*catalog, principal="ann")
    found = access.require_row(rows_of_ann, F.col("source") == "big", "data source 'big'", "ann")
    assert found.first().vendor == "mssql"
    with pytest.raises(access.NotAllowed, match="data source 'free' not found or not allowed for user 'ann'"):
        access.require_row(rows_of_ann, F.col("source") == "free", "data source 'free'", "ann")


def test_guarded_changes(catalog):
    users, grants, sources, _ = catalog
    grant = access.new_grant(users, sources, "bob", "free").select(*[F.col(c).cast("int") for c in ("user_id", "ds_id")])
    open_gate, closed = access.admin_gate(users, "admin"), access.admin_gate(users, "ann")
    assert (3, 3) in rows(access.guarded_rows(grants, grant, open_gate))
    assert rows(access.guarded_rows(grants, grant, closed)) == rows(grants)
    assert rows(access.new_grant(users, sources, "bob", "nowhere")) == []
    doomed = grants.where("user_id = 2 AND ds_id = 1")
    assert rows(access.revoke(grants, doomed, ["user_id", "ds_id"], open_gate)) == [(1, 1), (2, 2), (3, 2)]
    assert rows(access.revoke(grants, doomed, ["user_id", "ds_id"], closed)) == rows(grants)


def test_guards_use_no_join(catalog):
    users, _, sources, _ = catalog
    gated = access.gated(sources, access.admin_gate(users, "admin"))
    for df in (gated, access.visible_users(users, "ann")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "CartesianProduct" not in plan and "ubquery" in plan


def test_updates_and_masks(catalog):
    users = catalog[0]
    changed = access.update_where(users, "isadmin", F.col("name") == "bob", F.lit(1))
    assert changed.schema == users.schema or changed.dtypes == users.dtypes
    assert rows(changed)[2] == (3, "bob", 1)
    assert [r.name for r in access.mask_column(users, "name", F.col("id") > 1, "-").orderBy("id").collect()] == ["-", "ann", "bob"]
    unknown = access.mask_column(users, "name", F.lit(None).cast("boolean"))
    assert {r.name for r in unknown.collect()} == {""}


def test_audits(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, None), (2, 7)], "a int, b int")
    assert rows(audits.audit_unique(df, ["a", "b"])) == [(1, 1, 2)]
    parents = spark.createDataFrame([(1,), (None,)], "p int")
    assert rows(audits.audit_foreign_key(df, ["b"], parents, ["p"])) == [(7, 1)]
    assert rows(audits.audit_check(df, F.col("b") < 5)) == [(2, 7)]
    assert rows(audits.audit_not_null(df, ["a", "b"])) == [("b", 2)]


COLUMNS = [
    ("pg_catalog", "t", "BASE TABLE", 1, "id", "int", None, "NO", None),
    ("public", "b", "BASE TABLE", 2, "name", "text", 20, "YES", None),
    ("public", "b", "BASE TABLE", 1, "id", "int", None, "NO", "0"),
    ("public", "a", "VIEW", 1, "id", "int", None, "NO", None),
    ("pgx", "B", "BASE TABLE", 1, "id", "int", None, "NO", None),
]


def test_dictionary(spark):
    columns = spark.createDataFrame(COLUMNS, dictionary.COLUMNS).repartition(3)
    keys = spark.createDataFrame([("public", "b", "id"), ("public", "b", "id")], "table_schema string, table_name string, column_name string")
    assert [r[0] for r in dictionary.dict_schemas(columns).collect()] == ["pgx", "public"]
    assert [tuple(r) for r in dictionary.dict_tables(columns).collect()] == [("pg_catalog", "t"), ("pgx", "B"), ("public", "b")]
    assert [r[0] for r in dictionary.dict_tables(columns, "public").collect()] == ["b"]
    assert [r[0] for r in dictionary.dict_views(columns, "public").collect()] == ["a"]
    assert [r[0] for r in dictionary.distinct_lower(columns, "table_name").collect()] == ["a", "b", "t"]
    found = dictionary.dict_columns(columns, keys, "public", "b").collect()
    assert [(r.column_name, r.max_length, r.nullable, r.default_value, r.is_primary_key) for r in found] == [
        ("id", None, "NO", "0", "YES"), ("name", 20, "YES", None, "NO"),
    ]


def test_dictionary_of_spark(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS harvest")
    spark.sql("CREATE TABLE IF NOT EXISTS harvest.t (id INT NOT NULL, name STRING) USING parquet")
    spark.range(1).createOrReplaceTempView("harvest_view")
    found = dictionary.dict_from_spark(spark, "harvest")
    assert found.schema == dictionary.COLUMNS
    own = {(r.table_name, r.table_type, r.ordinal, r.column_name, r.data_type) for r in found.collect()}
    assert {("t", "BASE TABLE", 1, "id", "int"), ("t", "BASE TABLE", 2, "name", "string")} <= own
    assert ("harvest_view", "VIEW", 1, "id", "bigint") in own
