"""Tables derived from the given ones, for operators whose subject those lack.

Access rules need users, sources and grants; the dictionary needs a table of
columns; the statement functions need a query log. Each is a projection of
given tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.functions.sqltypes import TYPE_NAMES, VENDORS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Column names of the derived dictionary; three hold a vendor's closing quote.
COLUMN_NAMES = ("id", "name", "created at", 'am"ount', "no]te", "fl`ag")

# Type names of the derived dictionary: all known ones, then ones with a twist.
DATA_TYPES = tuple(name for names in TYPE_NAMES.values() for name in names) + (
    "TINYINT(1)", "tinyint(10)", "BIGINT UNSIGNED", "int(10) unsigned", "Nullable(Decimal(18,2))",
    "LowCardinality(String)", "LowCardinality(Nullable(String))", "Nullable(LowCardinality(FixedString(3)))",
    "BIT", "JSONB", "", " varchar(40) ", "DECIMAL (18,2)", "Nullable",
)

# Statement texts of the derived query log; {T} stands for an event's type, {V} for its properties.
STATEMENTS = (
    "SELECT * FROM {T}",
    "-- all of it\nSELECT a, b -- two\nFROM {T}\n\n  WHERE c = '{V}'",
    "/* one */ /* two */ INSERT INTO {T} VALUES ('{V}')",
    "/* over\n   lines\n*/\nUPDATE {T} SET v = '{V}'\n  RETURNING id",
    "  // note\nDELETE FROM {T} // gone\nWHERE id = 1\noutput deleted.id",
    "insert into {T}\n(url) values ('http://x/{V}')\nreturning id",
    "WITH q AS (SELECT 1) INSERT INTO {T} SELECT * FROM q",
    "MERGE INTO {T} USING s ON 1 = 1",
    "/* open\nDROP TABLE {T}",
    "/*/ CREATE TABLE {T} (id int)",
    "/* a\n-- b */\n*/ ALTER TABLE {T} ADD c int /* tail */",
    "truncate table {T}",
    "\tDROP\tTABLE {T}\r\n",
    "update {T} set a = 1 output inserted.id where b = 2",
    "",
    "create view v as\n/* x */ select 1 /* y */\nfrom {T} -- {V}",
)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Given tables as temporary views."""
    for table in tables or TABLES:
        load(spark, sf_dir, table).createOrReplaceTempView(table)


def _pick(values: tuple[str, ...], index) -> F.Column:
    return F.get(F.array(*[F.lit(value) for value in values]), (index % len(values)).cast("int"))


# ---------------------------------------------------------------- users, sources, grants


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_custkey") == 1).cast("int").alias("isadmin")
    )


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("db://"), F.col("s_nationkey"), F.lit("/"), F.col("s_name")).alias("location"),
        F.col("s_nationkey").cast("string").alias("vendor_id"),
    )


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer holds the suppliers it ordered from."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("ds_id"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    return lines.join(orders, "o_orderkey").select("user_id", "ds_id").distinct()


def catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Users, grants, sources and vendors."""
    return tuple(make(spark, sf_dir) for make in (users, grants, sources, vendors))


# ---------------------------------------------------------------- dictionary


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of columns: each part stands for a table or view of one to six columns."""
    size, key, ordinal = F.col("p_size"), F.col("p_partkey"), F.col("ordinal")
    return (
        load(spark, sf_dir, "part")
        .select("*", F.explode(F.sequence(F.lit(1), size % 6 + 1)).alias("ordinal"))
        .select(
            F.when(size % 7 == 0, F.concat(F.lit("pg_"), F.lower("p_brand"))).otherwise(F.col("p_brand")).alias("table_schema"),
            F.concat("p_type", F.lit("_"), key).alias("table_name"),
            F.when(size % 5 == 0, F.lit("VIEW")).otherwise(F.lit("BASE TABLE")).alias("table_type"),
            "ordinal",
            _pick(COLUMN_NAMES, ordinal - 1).alias("column_name"),
            _pick(DATA_TYPES, key + ordinal * 7).alias("data_type"),
            F.when(ordinal == 2, F.lit(255)).alias("max_length"),
            F.when(ordinal == 1, F.lit("NO")).otherwise(F.lit("YES")).alias("nullable"),
            F.when(ordinal == 3, F.lit("now()")).alias("default_value"),
            _pick(VENDORS, key).alias("vendor"),
        )
    )


def primary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first column of every table, and the second of those with a short name."""
    second = (F.col("ordinal") == 2) & (F.length("table_name") < 10)
    return (
        columns(spark, sf_dir)
        .where((F.col("table_type") == "BASE TABLE") & ((F.col("ordinal") == 1) | second))
        .select("table_schema", "table_name", "column_name")
    )


# ---------------------------------------------------------------- texts


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as numbered lines."""
    return load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select(
        "doc_id", (F.col("at") + 1).alias("line_no"), "line"
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement for each event, and each document's whole text as one more."""
    event = F.col("event_id")
    made = F.replace(_pick(STATEMENTS, event), F.lit("{T}"), F.col("event_type"))
    events = load(spark, sf_dir, "events").select(
        F.lit("event").alias("origin"),
        event.alias("stmt_id"),
        _pick(VENDORS, event).alias("vendor"),
        F.replace(made, F.lit("{V}"), F.col("props")).alias("sql_text"),
    )
    documents = load(spark, sf_dir, "documents").select(
        F.lit("document").alias("origin"),
        F.col("doc_id").alias("stmt_id"),
        _pick(VENDORS, F.col("doc_id")).alias("vendor"),
        F.col("text").alias("sql_text"),
    )
    return events.unionByName(documents)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels; most have none, so that nulls occur."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"))
    return load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
