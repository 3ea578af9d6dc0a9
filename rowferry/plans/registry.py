"""The registered queries: each runs one operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.endpoint import Endpoint
from rowferry.functions import sqltypes, statements, texts
from rowferry.operators import access, audits, constraints, dictionary, grouping, pages, results, versions
from rowferry.operators.copying import copy, read_endpoint, well_split
from rowferry.plans import derived
from rowferry.plans.derived import load
from rowferry.plans.session import scratch_path, ship_package
from rowferry.sources import csv_files, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

ADMIN, SOMEONE = "Customer#000000001", "Customer#000000007"

REVENUE = """
    SELECT n_name, o_orderstatus, count(*) AS n_orders,
           cast(sum(cast(o_totalprice AS decimal(18, 2))) AS double) AS revenue
    FROM orders
    JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey
    WHERE o_totalprice >= :least
    GROUP BY n_name, o_orderstatus
"""


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


# ---------------------------------------------------------------- scans


@query
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived.register_tables(spark, sf_dir, "customer")
    return read_endpoint(spark, Endpoint("table", table="customer"))


@query
def scan_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived.register_tables(spark, sf_dir, "orders", "customer", "nation")
    return read_endpoint(spark, Endpoint("query", query=REVENUE, args={"least": 50000.0}))


@query
def scan_in_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query whose tables are of the schema that the endpoint names."""
    schema = f"scope_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {schema}")
    try:
        spark.sql(f"CREATE TABLE {schema}.accounts USING parquet LOCATION '{sf_dir}/customer.parquet'")
        query = "SELECT c_nationkey, count(*) AS n FROM accounts GROUP BY c_nationkey"
        return read_endpoint(spark, Endpoint("query", query=query, schema=schema))
    finally:
        spark.sql(f"DROP DATABASE {schema} CASCADE")  # the files are not the table's own and stay


def _through_files(spark: SparkSession, sf_dir: str, table: str, file_format: str, typed: bool = False) -> DataFrame:
    """Copy a table to a fresh folder of files and read it back under its own types."""
    ship_package(spark)
    df = load(spark, sf_dir, table)
    # As many files as shuffles have partitions, unless the scan's splits do as well. One task reads a whole workbook.
    shuffled = file_format == "xlsx" or not well_split(df)
    options = {"partitions": int(spark.conf.get("spark.sql.shuffle.partitions"))} if shuffled else {}
    derived.register_tables(spark, sf_dir, table)
    folder = scratch_path(spark, file_format)
    copy(spark, Endpoint("table", table=table), Endpoint("file", format=file_format, path=folder, options=options))
    read_options = {"schema": df.schema} if typed else {}
    back = read_endpoint(spark, Endpoint("file", format=file_format, path=folder, options=read_options))
    return tables.insert_positional(back, df.schema)


@query
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "documents", "csv")


@query
def scan_csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose fields hold line breaks and quotes, in as many splits as their size asks for."""
    df = load(spark, sf_dir, "documents")
    folder = scratch_path(spark, "csv-split")
    csv_files.write_csv(df, folder)
    return csv_files.read_csv(spark, folder, schema=df.schema)


@query
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "events", "json")


@query
def scan_json_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "orders", "jsonTabular")


@query
def scan_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "customer", "xlsx")


# ---------------------------------------------------------------- copies


@query
def copy_table_to_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "lineitem", "csv")


@query
def copy_table_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "lineitem", "json", typed=True)


@query
def copy_table_to_json_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "lineitem", "jsonTabular")


@query
def copy_table_to_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "lineitem", "xlsx", typed=True)


@query
def copy_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived.register_tables(spark, sf_dir, "lineitem")
    folder = scratch_path(spark, "report")
    return copy(spark, Endpoint("table", table="lineitem"), Endpoint("file", format="csv", path=folder))


def _new_table(spark: SparkSession, label: str) -> Endpoint:
    name = f"{label}_{uuid.uuid4().hex}"
    return Endpoint("table", table=name, new_table=True, options={"path": scratch_path(spark, name)})


def _existing(new: Endpoint) -> Endpoint:
    return Endpoint("table", table=new.table)


def _read_and_forget(spark: SparkSession, endpoint: Endpoint) -> DataFrame:
    """The table's rows; its name leaves the catalog, its files stay."""
    spark.sql(f"DROP TABLE {endpoint.qualified_table()}")
    return spark.read.parquet(endpoint.options["path"])


@query
def copy_new_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived.register_tables(spark, sf_dir, "part")
    made = _new_table(spark, "part_copy")
    copy(spark, Endpoint("table", table="part"), made)
    return _read_and_forget(spark, made)


@query
def copy_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived.register_tables(spark, sf_dir, "orders")
    made = _new_table(spark, "orders_copy")
    copy(spark, Endpoint("table", table="orders"), made)
    closed = Endpoint("query", query="SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_orderstatus = 'F'")
    copy(spark, closed, _existing(made))
    return _read_and_forget(spark, made)


@query
def copy_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived.register_tables(spark, sf_dir, "supplier", "customer")
    made = _new_table(spark, "party")
    copy(spark, Endpoint("table", table="supplier"), made)
    customers = load(spark, sf_dir, "customer").select(
        *[F.col(f"c_{part}").alias(f"s_{own}") for part, own in
          (("custkey", "suppkey"), ("name", "name"), ("nationkey", "nationkey"), ("acctbal", "acctbal"))]
    )
    tables.append_staged(customers, made, expected_rows=customers.count())
    return _read_and_forget(spark, made)


@query
def copy_query_to_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived.register_tables(spark, sf_dir, "orders", "customer", "nation")
    made = _new_table(spark, "revenue")
    copy(spark, Endpoint("query", query=REVENUE, args={"least": 0.0}), made)
    return _read_and_forget(spark, made)


# ---------------------------------------------------------------- columns and rows


@query
def align_to_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.align_to_header(load(spark, sf_dir, "events"), ["value", "event_id", "missing", "user_id"])


@query
def insert_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = T.StructType.fromDDL("talk bigint, place int, speaker string, body string")
    return tables.insert_positional(load(spark, sf_dir, "conversations"), target)


@query
def mask_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
    return access.mask_column(lines, "l_returnflag", F.col("l_linenumber") == 1)


@query
def valid_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = load(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return words.select("word", statements.is_valid_identifier(F.col("word")).alias("valid"))


# ---------------------------------------------------------------- access


@query
def resolve_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.resolve_grants(*derived.catalog(spark, sf_dir))


@query
def entitled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.entitled(*derived.catalog(spark, sf_dir), principal=ADMIN)


@query
def entitled_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = derived.catalog(spark, sf_dir)
    return access.entitled(*catalog, principal=SOMEONE, user_name=SOMEONE, open_vendor="NATION_3")


@query
def theta_or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = derived.users(spark, sf_dir)
    seen = [access.visible_users(users, name).withColumn("principal", F.lit(name)) for name in (ADMIN, SOMEONE)]
    return seen[0].unionByName(seen[1])


@query
def gated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, sources = derived.users(spark, sf_dir), derived.sources(spark, sf_dir)
    seen = [
        access.gated(sources, access.admin_gate(users, name)).withColumn("principal", F.lit(name))
        for name in (ADMIN, SOMEONE)
    ]
    return seen[0].unionByName(seen[1])


@query
def ungranted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.ungranted(*derived.catalog(spark, sf_dir), principal=ADMIN, user_name=SOMEONE)


@query
def guarded_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = derived.users(spark, sf_dir)
    users.createOrReplaceTempView("users_origin")
    made = _new_table(spark, "users_copy")
    copy(spark, Endpoint("table", table="users_origin"), made)
    suppliers = derived.sources(spark, sf_dir).select("id", "name", F.lit(0).alias("isadmin"))
    for principal in (ADMIN, SOMEONE):
        access.guarded_append(made.table, suppliers, access.admin_gate(users, principal))
    return _read_and_forget(spark, made)


@query
def revoke_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, grants, sources, _ = derived.catalog(spark, sf_dir)
    first = sources.where(F.col("vendor_id") == "3").select(F.col("id").alias("ds_id"))
    return access.revoke(grants, first, ["ds_id"], access.admin_gate(users, ADMIN))


@query
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.update_where(load(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_acctbal") < 0, F.lit("OVERDRAWN"))


def _version_and_forget(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a table's present version; its name leaves the catalog, its files stay."""
    location = versions.location_of(spark, table)
    schema = spark.table(table).schema
    spark.sql(f"DROP TABLE {table}")
    return spark.read.schema(schema).parquet(location)


@query
def revoke_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after one revoke that is allowed and one that is not."""
    users, grants, sources, _ = derived.catalog(spark, sf_dir)
    made = _new_table(spark, "grants_copy")
    tables.create_table(grants, made)
    for principal, vendor in ((ADMIN, "3"), (SOMEONE, "4")):
        doomed = sources.where(F.col("vendor_id") == vendor).select(F.col("id").alias("ds_id"))
        access.revoke_from(made.table, doomed, ["ds_id"], access.admin_gate(users, principal))
    return _version_and_forget(spark, made.table)


@query
def update_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after two updates, each a version of its own."""
    gate = access.admin_gate(derived.users(spark, sf_dir), ADMIN)
    made = _new_table(spark, "customer_copy")
    tables.create_table(load(spark, sf_dir, "customer"), made)
    access.update_table(made.table, "c_mktsegment", F.col("c_acctbal") < 0, F.lit("OVERDRAWN"), gate)
    access.update_table(made.table, "c_acctbal", F.col("c_mktsegment") == "OVERDRAWN", F.lit(0), gate)
    return _version_and_forget(spark, made.table)


def _half_of_grants(spark: SparkSession, sf_dir: str) -> tuple[Endpoint, DataFrame, list[constraints.Rule]]:
    """A table with the grants of every other user, all grants, and the rules that hold for them."""
    users, grants, sources, _ = derived.catalog(spark, sf_dir)
    made = _new_table(spark, "grants_half")
    tables.create_table(grants.where("user_id % 2 = 0"), made)
    users.createOrReplaceTempView("known_users")
    sources.createOrReplaceTempView("known_sources")
    rules = [
        constraints.Rule("one_grant", "unique", ("user_id", "ds_id")),
        constraints.Rule("known_user", "foreign_key", ("user_id",), "known_users", ("id",)),
        constraints.Rule("known_source", "foreign_key", ("ds_id",), "known_sources", ("id",)),
        constraints.Rule("source_given", "not_null", ("ds_id",)),
        constraints.Rule("user_counts", "check", condition="user_id >= 0"),
    ]
    return made, grants, rules


@query
def insert_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a batch that keeps all rules."""
    made, grants, rules = _half_of_grants(spark, sf_dir)
    constraints.checked_append(spark, made.table, grants.where("user_id % 2 <> 0"), rules)
    return _version_and_forget(spark, made.table)


@query
def insert_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refused batch breaks, by rule, and the rows of the table after it."""
    made, grants, rules = _half_of_grants(spark, sf_dir)
    known, unknown, none = grants.where("user_id % 3 = 0"), grants.where("user_id % 5 = 0"), grants.where("user_id % 7 = 0")
    batch = known.unionByName(unknown.withColumn("user_id", F.col("user_id") + 100_000_000))
    batch = batch.unionByName(none.withColumn("ds_id", F.lit(None).cast(grants.schema["ds_id"].dataType)))
    try:
        constraints.checked_append(spark, made.table, batch, rules)
        broken = {}
    except constraints.ConstraintViolation as refused:
        broken = refused.broken
    report = spark.createDataFrame(list(broken.items()), "rule string, n_rows bigint")
    after = _version_and_forget(spark, made.table)
    return report.unionByName(after.agg(F.lit("rows after").alias("rule"), F.count("*").alias("n_rows")))


@query
def audit_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.audit_unique(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def audit_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    builders = load(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return audits.audit_foreign_key(load(spark, sf_dir, "orders"), ["o_custkey"], builders, ["c_custkey"])


@query
def audit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.labelled_documents(spark, sf_dir)
    return audits.audit_check(rows, (F.col("doc_id") < 10) | (F.col("quality") == 1))


@query
def audit_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.labelled_documents(spark, sf_dir)
    return audits.audit_not_null(rows, rows.columns)


# ---------------------------------------------------------------- results


@query
def bounded_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = load(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return results.bounded(ordered).flagged


@query
def result_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    derived.register_tables(spark, sf_dir, "events")
    wanted = "-- all clicks\nSELECT event_id, user_id, value FROM events WHERE event_type = 'click'"
    envelope = results.run_sql(spark, wanted, cap=300).envelope()
    return envelope.withColumns({name: F.array_join(name, ",") for name in ("cols", "column_types")})


@query
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    early, late = (results.page(orders, ["o_orderkey"], number) for number in (3, 900))
    return early.unionByName(late)


@query
def page_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A late page in an order that begins with a time."""
    events = load(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    return results.page(events, ["ts", "event_id"], 450, 20)


@query
def page_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of a catalog table: the first one builds the table's index, the other one finds it."""
    table = f"orders_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{sf_dir}/orders.parquet'")
    try:
        order = ["o_orderdate", "o_orderkey"]
        first, other = (pages.page_of_table(spark, table, order, number, 20) for number in (333, 8))
        return first.unionByName(other)
    finally:
        spark.sql(f"DROP TABLE {table}")  # the files are not the table's own and stay


@query
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_totalprice")
    return results.page_index(orders, ["o_orderdate", "o_orderkey"])


@query
def header_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.header_sample(load(spark, sf_dir, "orders"), ["o_orderkey"])


@query
def display_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.display_profile(load(spark, sf_dir, "lineitem"))


@query
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.with_widths(results.display_profile(derived.labelled_documents(spark, sf_dir)), 600)


@query
def group_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = load(spark, sf_dir, "documents").withColumn("lang", F.nullif("lang", F.lit("en")))
    return grouping.group_options(documents, group="lang", value="doc_id", label="source", order="doc_id")


@query
def concat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.concat_lines(derived.document_lines(spark, sf_dir), ["doc_id"], "line_no", "line")


@query
def definition_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("name"), F.col("text").alias("Create Text"))
    return grouping.definition_text(replies, ["doc_id"], "doc_id", ["name", "Create Text"])


# ---------------------------------------------------------------- values


@query
def to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.to_text(load(spark, sf_dir, "orders"))


@query
def render_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts.render_cells(derived.labelled_documents(spark, sf_dir))


@query
def row_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.labelled_documents(spark, sf_dir)
    return rows.select("doc_id", texts.json_object(rows).alias("line"))


@query
def base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", texts.base_name(F.col("url")).alias("base_name"))


@query
def duration_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.col("event_id") * 1234567 % 5000000
    return load(spark, sf_dir, "events").select(
        "event_id", texts.duration_ms(taken).alias("ms"), texts.duration_text(taken).alias("shown")
    )


@query
def canonical_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.columns(spark, sf_dir).select(
        "table_name", "ordinal", "vendor", "data_type",
        sqltypes.canonical_type(F.col("vendor"), F.col("data_type")).alias("canonical"),
    )


@query
def vendor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    column_types = derived.columns(spark, sf_dir).withColumn(
        "canonical", F.get(F.array(*map(F.lit, sqltypes.CANONICAL_TYPES)), (F.length("table_name") + F.col("ordinal")) % 14)
    )
    return column_types.select(
        "table_name", "ordinal", "vendor", "canonical",
        sqltypes.vendor_type(F.col("vendor"), F.col("canonical")).alias("vendor_type"),
    )


@query
def convert_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.columns(spark, sf_dir).select(
        "table_name", "ordinal", "vendor", "data_type",
        sqltypes.convert_type(F.col("vendor"), "postgresql", F.col("data_type")).alias("postgresql"),
    )


@query
def quote_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.columns(spark, sf_dir).select(
        "table_name", "ordinal", "vendor", "column_name",
        sqltypes.quote_identifier(F.col("vendor"), F.col("column_name")).alias("quoted"),
    )


@query
def clean_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.query_log(spark, sf_dir)
    return log.select("origin", "stmt_id", statements.clean_statement(F.col("sql_text")).alias("cleaned"))


@query
def classify_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = derived.query_log(spark, sf_dir)
    return statements.classify_statements(log, "sql_text", "vendor").select(
        "origin", "stmt_id", "vendor", "stmt_cmd", "stmt_type"
    )


# ---------------------------------------------------------------- dictionary


@query
def dict_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dict_schemas(derived.columns(spark, sf_dir))


@query
def distinct_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.distinct_lower(derived.columns(spark, sf_dir), "table_name")


@query
def dict_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dict_tables(derived.columns(spark, sf_dir))


@query
def dict_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dict_views(derived.columns(spark, sf_dir))


@query
def dict_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dict_columns(derived.columns(spark, sf_dir), derived.primary_keys(spark, sf_dir))


@query
def create_table_ddl(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = derived.columns(spark, sf_dir)
    return grouping.create_table_ddl(
        columns,
        key=["table_schema", "table_name"],
        order="ordinal",
        table=F.col("table_name"),
        column_name=F.col("column_name"),
        column_type=sqltypes.convert_type(F.col("vendor"), "mysql", F.col("data_type")),
        vendor="mysql",
    )


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation and status, largest first, within the default cap."""
    derived.register_tables(spark, sf_dir, "orders", "customer", "nation")
    revenue = read_endpoint(spark, Endpoint("query", query=REVENUE, args={"least": 0.0}))
    return results.bounded(revenue.orderBy(F.desc("revenue"), "n_name", "o_orderstatus")).flagged
