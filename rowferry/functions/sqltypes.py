"""Column types across database vendors, as column expressions.

A vendor's type name is folded to one of fourteen canonical names, and a
canonical name is spelled out for a vendor. Both directions work on whole
columns, so that an information-schema extract of any size converts in one
projection without a join or a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.functions.spaces import trim_space

# Vendor names.
VENDORS = ("mssql", "mysql", "mariadb", "sqlite3", "postgresql", "clickhouse")

# The type name of each canonical type, per vendor, in the order of VENDORS.
VENDOR_TYPES = {
    "int": ("INT", "INT", "INT", "INTEGER", "INTEGER", "Int32"),
    "bigint": ("BIGINT", "BIGINT", "BIGINT", "INTEGER", "BIGINT", "Int64"),
    "smallint": ("SMALLINT", "SMALLINT", "SMALLINT", "INTEGER", "SMALLINT", "Int16"),
    "boolean": ("BIT", "TINYINT(1)", "TINYINT(1)", "INTEGER", "BOOLEAN", "UInt8"),
    "decimal": ("DECIMAL(18,2)", "DECIMAL(18,2)", "DECIMAL(18,2)", "NUMERIC", "NUMERIC(18,2)", "Decimal(18,2)"),
    "float": ("FLOAT", "FLOAT", "FLOAT", "REAL", "DOUBLE PRECISION", "Float64"),
    "char": ("CHAR(1)", "CHAR(1)", "CHAR(1)", "TEXT", "CHAR(1)", "FixedString(1)"),
    "varchar": ("VARCHAR(255)", "VARCHAR(255)", "VARCHAR(255)", "TEXT", "VARCHAR(255)", "String"),
    "text": ("TEXT", "TEXT", "TEXT", "TEXT", "TEXT", "String"),
    "binary": ("VARBINARY(MAX)", "BLOB", "BLOB", "BLOB", "BYTEA", "String"),
    "date": ("DATE", "DATE", "DATE", "TEXT", "DATE", "Date"),
    "time": ("TIME", "TIME", "TIME", "TEXT", "TIME", "String"),
    "datetime": ("DATETIME2", "DATETIME", "DATETIME", "TEXT", "TIMESTAMP", "DateTime"),
    "uuid": ("UNIQUEIDENTIFIER", "CHAR(36)", "CHAR(36)", "TEXT", "UUID", "UUID"),
}

# Bare vendor type names that fold to each canonical type.
TYPE_NAMES = {
    "int": ("INT", "INTEGER", "INT4", "INT32", "UINT16"),
    "bigint": ("INT8", "BIGINT", "INT64", "UINT32", "UINT64"),
    "smallint": ("TINYINT", "SMALLINT", "INT2", "INT16"),
    "boolean": ("BOOL", "BOOLEAN", "UINT8"),
    "decimal": ("NUMERIC", "DEC", "DECIMAL", "MONEY"),
    "float": ("REAL", "FLOAT", "FLOAT4", "FLOAT8", "DOUBLE", "DOUBLE PRECISION", "FLOAT32", "FLOAT64"),
    "char": ("CHAR", "NCHAR", "CHARACTER", "FIXEDSTRING"),
    "varchar": ("VARCHAR", "NVARCHAR", "STRING"),
    "text": ("TEXT", "CLOB"),
    "binary": ("BLOB", "BYTEA", "VARBINARY"),
    "date": ("DATE", "DATE32"),
    "time": ("TIME",),
    "datetime": ("DATETIME", "DATETIME2", "SMALLDATETIME", "TIMESTAMP", "DATETIME64"),
    "uuid": ("UUID", "UNIQUEIDENTIFIER"),
}

CANONICAL_TYPES = tuple(VENDOR_TYPES)

_CANONICAL_BY_NAME = {name: canonical for canonical, names in TYPE_NAMES.items() for name in names}
_NAME_BY_VENDOR = {
    f"{vendor} {canonical}": name
    for canonical, names in VENDOR_TYPES.items()
    for vendor, name in zip(VENDORS, names, strict=True)
}

# The Spark type that carries each canonical type.
_SPARK_TYPES = {
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "smallint": T.ShortType(),
    "boolean": T.BooleanType(),
    "decimal": T.DecimalType(18, 2),
    "float": T.DoubleType(),
    "char": T.StringType(),
    "varchar": T.StringType(),
    "text": T.StringType(),
    "binary": T.BinaryType(),
    "date": T.DateType(),
    "time": T.StringType(),
    "datetime": T.TimestampNTZType(),
    "uuid": T.StringType(),
}

# Names that documents from elsewhere use besides the canonical ones.
_FOREIGN_TYPES = {"integer": "bigint", "string": "text", "number": "float"}


def _as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _literal_map(pairs: dict[str, str]) -> Column:
    """A constant map, so that a lookup evaluates its key once."""
    return F.create_map(*[F.lit(text) for pair in pairs.items() for text in pair])


def _unwrap(name: Column, wrapper: str) -> Column:
    """Drop one ``WRAPPER(`` at the start, with one closing bracket at the end."""
    return F.regexp_replace(name, rf"(?s)^{wrapper}\((.*?)\)?\z", "$1")


def canonical_type(vendor: Column | str, type_name: Column, strict: bool = False) -> Column:
    """The canonical name of a vendor's type; ``text`` where nothing fits.

    ``vendor`` is a column or one vendor's name. With ``strict`` an unknown
    type name fails the query instead of becoming ``text``.
    """
    vendor = _as_column(vendor)
    raw = F.upper(trim_space(type_name))
    bare = trim_space(F.replace(raw, F.lit("UNSIGNED"), F.lit("")))
    bare = F.substring_index(_unwrap(_unwrap(bare, "NULLABLE"), "LOWCARDINALITY"), "(", 1)

    flag = vendor.isin("mysql", "mariadb") & F.startswith(raw, F.lit("TINYINT(1"))
    named = F.when(flag, F.lit("boolean")).otherwise(F.try_element_at(_literal_map(_CANONICAL_BY_NAME), bare))
    if strict:
        unknown = F.concat(F.lit("unknown column type: "), F.coalesce(type_name, F.lit("null")))
        return F.coalesce(named, F.raise_error(unknown).cast("string"))
    return F.coalesce(named, F.lit("text"))


def vendor_type(vendor: Column | str, canonical: Column) -> Column:
    """The vendor's type name for a canonical type; '' where either is unknown."""
    key = F.concat(_as_column(vendor), F.lit(" "), canonical)
    return F.coalesce(F.try_element_at(_literal_map(_NAME_BY_VENDOR), key), F.lit(""))


def convert_type(from_vendor: Column | str, to_vendor: Column | str, type_name: Column) -> Column:
    """A type name of one vendor as the other vendor would write it."""
    return vendor_type(to_vendor, canonical_type(from_vendor, type_name))


def quote_identifier(vendor: Column | str, name: Column) -> Column:
    """An identifier in the vendor's quotes, with inner quotes doubled.

    An unknown vendor gives ''.
    """
    vendor = _as_column(vendor)

    def quoted(opening: str, closing: str) -> Column:
        return F.concat(F.lit(opening), F.replace(name, F.lit(closing), F.lit(closing * 2)), F.lit(closing))

    return (
        F.when(vendor.isin("clickhouse", "mysql", "mariadb", "sqlite3"), quoted("`", "`"))
        .when(vendor == "mssql", quoted("[", "]"))
        .when(vendor == "postgresql", quoted('"', '"'))
        .otherwise(F.lit(""))
    )


def canonical_of(data_type: T.DataType) -> str:
    """The canonical name of a Spark type; nested types become ``text``."""
    by_class = {
        T.IntegerType: "int",
        T.LongType: "bigint",
        T.ShortType: "smallint",
        T.ByteType: "smallint",
        T.BooleanType: "boolean",
        T.DecimalType: "decimal",
        T.FloatType: "float",
        T.DoubleType: "float",
        T.CharType: "char",
        T.VarcharType: "varchar",
        T.BinaryType: "binary",
        T.DateType: "date",
        T.TimestampType: "datetime",
        T.TimestampNTZType: "datetime",
    }
    return by_class.get(type(data_type), "text")


def spark_type_of(type_name: str, column: str = "?") -> T.DataType:
    """The Spark type of a canonical name, or of ``integer``, ``string``, ``number``."""
    canonical = _FOREIGN_TYPES.get(type_name, type_name)
    if canonical not in _SPARK_TYPES:
        raise ValueError(f"unknown type {type_name!r} for column {column!r}")
    return _SPARK_TYPES[canonical]


def quoted(vendor: str, name: str) -> str:
    """One name in the vendor's quotes, for statements that the driver sends."""
    if vendor not in VENDORS:
        raise ValueError(f"unknown database type: {vendor}")
    opening, closing = {"mssql": "[]", "postgresql": '""'}.get(vendor, "``")
    return opening + name.replace(closing, closing * 2) + closing


def create_table_statement(vendor: str, table: str, schema: T.StructType) -> str:
    """``CREATE TABLE`` for a vendor, from a quoted table name and a Spark schema."""
    if not schema.fields:
        raise ValueError("columns and types mismatch or empty")
    position = VENDORS.index(vendor)
    columns = [f"{quoted(vendor, f.name)} {VENDOR_TYPES[canonical_of(f.dataType)][position]}" for f in schema]
    return f"CREATE TABLE {table} ({','.join(columns)})"
