"""What each registered query must give, as SQL for DuckDB over the given tables."""

from __future__ import annotations

from rowferry.plans.derived import COLUMN_NAMES, DATA_TYPES, STATEMENTS
from rowferry.functions.sqltypes import VENDORS


def _text(value: str) -> str:
    parts = value.replace("'", "''").split("\n")
    quoted = " || chr(10) || ".join("'" + part.replace("\r", "' || chr(13) || '") + "'" for part in parts)
    return f"({quoted})"


def _texts(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(_text(value) for value in values) + "]"


# ---------------------------------------------------------------- derived tables

_USERS = "users AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey = 1 THEN 1 ELSE 0 END AS isadmin FROM customer)"
_VENDORS = "vendors AS (SELECT n_nationkey AS id, n_name AS name FROM nation)"
_SOURCES = """sources AS (SELECT s_suppkey AS id, s_name AS name, 'db://' || s_nationkey || '/' || s_name AS location,
    CAST(s_nationkey AS VARCHAR) AS vendor_id FROM supplier)"""
_GRANTS = """grants AS (SELECT DISTINCT o_custkey AS user_id, l_suppkey AS ds_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_CATALOG = f"WITH {_USERS}, {_VENDORS}, {_SOURCES}, {_GRANTS}"

_COLUMNS = f"""WITH numbered AS (SELECT *, unnest(range(1, p_size % 6 + 2)) AS o FROM part),
columns AS (
    SELECT CASE WHEN p_size % 7 = 0 THEN 'pg_' || lower(p_brand) ELSE p_brand END AS table_schema,
           p_type || '_' || p_partkey AS table_name,
           CASE WHEN p_size % 5 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type,
           CAST(o AS INTEGER) AS ordinal,
           ({_texts(COLUMN_NAMES)})[o] AS column_name,
           ({_texts(DATA_TYPES)})[(p_partkey + o * 7) % {len(DATA_TYPES)} + 1] AS data_type,
           CASE WHEN o = 2 THEN 255 END AS max_length,
           CASE WHEN o = 1 THEN 'NO' ELSE 'YES' END AS nullable,
           CASE WHEN o = 3 THEN 'now()' END AS default_value,
           ({_texts(VENDORS)})[p_partkey % {len(VENDORS)} + 1] AS vendor
    FROM numbered)"""

_CANONICAL_STEPS = """
steps AS (SELECT *, upper(trim(data_type)) AS raw FROM columns),
bare1 AS (SELECT *, trim(replace(raw, 'UNSIGNED', '')) AS b FROM steps),
bare2 AS (SELECT * REPLACE (CASE WHEN starts_with(b, 'NULLABLE(')
    THEN CASE WHEN ends_with(b, ')') THEN b[10:-2] ELSE b[10:] END ELSE b END AS b) FROM bare1),
bare3 AS (SELECT * REPLACE (CASE WHEN starts_with(b, 'LOWCARDINALITY(')
    THEN CASE WHEN ends_with(b, ')') THEN b[16:-2] ELSE b[16:] END ELSE b END AS b) FROM bare2),
bare AS (SELECT * REPLACE (split_part(b, '(', 1) AS b) FROM bare3),
typed AS (SELECT *, CASE
    WHEN vendor IN ('mysql', 'mariadb') AND starts_with(raw, 'TINYINT(1') THEN 'boolean'
    WHEN b IN ('INT', 'INTEGER', 'INT4', 'INT32', 'UINT16') THEN 'int'
    WHEN b IN ('INT8', 'BIGINT', 'INT64', 'UINT32', 'UINT64') THEN 'bigint'
    WHEN b IN ('TINYINT', 'SMALLINT', 'INT2', 'INT16') THEN 'smallint'
    WHEN b IN ('BOOL', 'BOOLEAN', 'UINT8') THEN 'boolean'
    WHEN b IN ('NUMERIC', 'DEC', 'DECIMAL', 'MONEY') THEN 'decimal'
    WHEN b IN ('REAL', 'FLOAT', 'FLOAT4', 'FLOAT8', 'DOUBLE', 'DOUBLE PRECISION', 'FLOAT32', 'FLOAT64') THEN 'float'
    WHEN b IN ('CHAR', 'NCHAR', 'CHARACTER', 'FIXEDSTRING') THEN 'char'
    WHEN b IN ('VARCHAR', 'NVARCHAR', 'STRING') THEN 'varchar'
    WHEN b IN ('BLOB', 'BYTEA', 'VARBINARY') THEN 'binary'
    WHEN b IN ('DATE', 'DATE32') THEN 'date'
    WHEN b = 'TIME' THEN 'time'
    WHEN b IN ('DATETIME', 'DATETIME2', 'SMALLDATETIME', 'TIMESTAMP', 'DATETIME64') THEN 'datetime'
    WHEN b IN ('UUID', 'UNIQUEIDENTIFIER') THEN 'uuid'
    ELSE 'text' END AS canonical FROM bare)"""

# Canonical type, then its name for mssql, mysql and mariadb, sqlite3, postgresql, clickhouse.
_MATRIX = """matrix(c, mssql, mysql, sqlite3, postgresql, clickhouse) AS (VALUES
    ('int', 'INT', 'INT', 'INTEGER', 'INTEGER', 'Int32'),
    ('bigint', 'BIGINT', 'BIGINT', 'INTEGER', 'BIGINT', 'Int64'),
    ('smallint', 'SMALLINT', 'SMALLINT', 'INTEGER', 'SMALLINT', 'Int16'),
    ('boolean', 'BIT', 'TINYINT(1)', 'INTEGER', 'BOOLEAN', 'UInt8'),
    ('decimal', 'DECIMAL(18,2)', 'DECIMAL(18,2)', 'NUMERIC', 'NUMERIC(18,2)', 'Decimal(18,2)'),
    ('float', 'FLOAT', 'FLOAT', 'REAL', 'DOUBLE PRECISION', 'Float64'),
    ('char', 'CHAR(1)', 'CHAR(1)', 'TEXT', 'CHAR(1)', 'FixedString(1)'),
    ('varchar', 'VARCHAR(255)', 'VARCHAR(255)', 'TEXT', 'VARCHAR(255)', 'String'),
    ('text', 'TEXT', 'TEXT', 'TEXT', 'TEXT', 'String'),
    ('binary', 'VARBINARY(MAX)', 'BLOB', 'BLOB', 'BYTEA', 'String'),
    ('date', 'DATE', 'DATE', 'TEXT', 'DATE', 'Date'),
    ('time', 'TIME', 'TIME', 'TEXT', 'TIME', 'String'),
    ('datetime', 'DATETIME2', 'DATETIME', 'TEXT', 'TIMESTAMP', 'DateTime'),
    ('uuid', 'UNIQUEIDENTIFIER', 'CHAR(36)', 'TEXT', 'UUID', 'UUID'))"""

_LABELLED = """SELECT d.doc_id, lang, source, n_chars, quality, toxic = 1 AS toxic
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""

_LOG = f"""WITH log AS (
    SELECT 'event' AS origin, event_id AS stmt_id, ({_texts(VENDORS)})[event_id % {len(VENDORS)} + 1] AS vendor,
           replace(replace(({_texts(STATEMENTS)})[event_id % {len(STATEMENTS)} + 1], '{{T}}', event_type), '{{V}}', props) AS s
    FROM events
    UNION ALL
    SELECT 'document', doc_id, ({_texts(VENDORS)})[doc_id % {len(VENDORS)} + 1], text FROM documents)"""

_HS = r"\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WS = _HS + r"\n"
_CLEAN = rf""",
s1 AS (SELECT * REPLACE (regexp_replace(regexp_replace(lower(s), '^[{_WS}]+', ''), '[{_WS}]+$', '') AS s) FROM log),
s2 AS (SELECT * REPLACE (regexp_replace(s, '[{_HS}]*\n[{_WS}]*', chr(10), 'g') AS s) FROM s1),
s3 AS (SELECT * REPLACE (regexp_replace(s, '(?m)^(--|//)[^\n]*\n?', '', 'g') AS s) FROM s2),
s4 AS (SELECT * REPLACE (regexp_replace(s, '(?m)^(/(\*/|\*(?s:.)*?(\*/|\z))[{_WS}]*)+', '', 'g') AS s) FROM s3),
s5 AS (SELECT * REPLACE (regexp_replace(s, '(--|//)[^\n]*', '', 'g') AS s) FROM s4),
cleaned AS (SELECT * REPLACE (regexp_replace(trim(s, chr(10)), '\n+', ' ', 'g') AS s) FROM s5)"""


def _number(column: str) -> str:
    return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"


def _moment(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%SZ')"


_ORDER_TEXTS = f"""CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
    {_number('o_totalprice')} AS o_totalprice, {_moment('o_orderdate')} AS o_orderdate, o_orderpriority"""

_LENGTHS = {
    "l_orderkey": "length(CAST(l_orderkey AS VARCHAR))",
    "l_partkey": "length(CAST(l_partkey AS VARCHAR))",
    "l_suppkey": "length(CAST(l_suppkey AS VARCHAR))",
    "l_linenumber": "length(CAST(l_linenumber AS VARCHAR))",
    "l_quantity": f"length({_number('l_quantity')})",
    "l_extendedprice": f"length({_number('l_extendedprice')})",
    "l_discount": f"length({_number('l_discount')})",
    "l_tax": f"length({_number('l_tax')})",
    "l_returnflag": "length(l_returnflag)",
    "l_linestatus": "length(l_linestatus)",
    "l_shipdate": "20",
}

_REVENUE = """SELECT n_name, o_orderstatus, count(*) AS n_orders,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
    FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
    WHERE o_totalprice >= {least} GROUP BY n_name, o_orderstatus"""

_GRANTED = f"""{_CATALOG} SELECT u.name AS user_name, s.name AS source, v.name AS vendor, {{location}} AS location
    FROM grants g JOIN users u ON u.id = g.user_id JOIN sources s ON s.id = g.ds_id
    JOIN vendors v ON v.id = CAST(s.vendor_id AS INTEGER)"""

ORACLES: dict[str, str] = {
    # scans and copies
    "scan_table": "SELECT * FROM customer",
    "scan_in_schema": "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey",
    "scan_query": _REVENUE.format(least=50000),
    "scan_csv": "SELECT * FROM documents",
    "scan_csv_split": "SELECT * FROM documents",
    "scan_json": "SELECT * FROM events",
    "scan_json_tabular": "SELECT * FROM orders",
    "scan_workbooks": "SELECT * FROM customer",
    "copy_table_to_csv": "SELECT * FROM lineitem",
    "copy_table_to_json": "SELECT * FROM lineitem",
    "copy_table_to_json_tabular": "SELECT * FROM lineitem",
    "copy_table_to_workbooks": "SELECT * FROM lineitem",
    "copy_report": "SELECT count(*) AS reads, count(*) AS writes FROM lineitem",
    "copy_new_table": "SELECT * FROM part",
    "copy_append": """SELECT * FROM orders UNION ALL BY NAME
        SELECT o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_orderstatus = 'F'""",
    "copy_atomic": """SELECT * FROM supplier UNION ALL
        SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer""",
    "copy_query_to_table": _REVENUE.format(least=0),
    # columns and rows
    "align_to_header": "SELECT value, event_id, CAST(NULL AS VARCHAR) AS missing, user_id FROM events",
    "insert_positional": """SELECT conv_id AS talk, CAST(turn AS INTEGER) AS place, role AS speaker, text AS body
        FROM conversations""",
    "mask_column": """SELECT l_orderkey, l_linenumber, l_partkey,
        CASE WHEN l_linenumber = 1 THEN l_returnflag ELSE '' END AS l_returnflag, l_shipdate FROM lineitem""",
    "valid_identifiers": r"""SELECT word, regexp_matches(word, '^[_\p{L}][_\p{L}\p{N}$]*$') AND length(word) <= 63 AS valid
        FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents)""",
    # access
    "resolve_grants": _GRANTED.format(location="s.location"),
    "entitled_rows": _GRANTED.format(location="s.location"),
    "entitled_self": _GRANTED.format(location="CASE WHEN v.name = 'NATION_3' THEN s.location ELSE '' END")
    + " WHERE u.name = 'Customer#000000007'",
    "theta_or_join": f"""WITH {_USERS} SELECT u.name, u.isadmin, p.name AS principal
        FROM users u JOIN users p ON u.name = p.name OR p.isadmin = 1
        WHERE p.name IN ('Customer#000000001', 'Customer#000000007')""",
    "gated_rows": f"""WITH {_USERS}, {_SOURCES} SELECT s.*, p.name AS principal
        FROM sources s JOIN users p ON p.isadmin = 1
        WHERE p.name IN ('Customer#000000001', 'Customer#000000007')""",
    "ungranted": f"""{_CATALOG} SELECT s.name, v.name AS vendor, s.location
        FROM sources s JOIN vendors v ON v.id = CAST(s.vendor_id AS INTEGER)
        WHERE s.id NOT IN (SELECT ds_id FROM grants JOIN users u ON u.id = user_id WHERE u.name = 'Customer#000000007')""",
    "guarded_insert": f"""WITH {_USERS}, {_SOURCES} SELECT * FROM users UNION ALL SELECT id, name, 0 FROM sources""",
    "revoke_rows": f"""{_CATALOG} SELECT * FROM grants
        WHERE ds_id NOT IN (SELECT id FROM sources WHERE vendor_id = '3')""",
    "update_where": """SELECT c_custkey, c_name, c_nationkey, c_acctbal,
        CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "revoke_published": f"""{_CATALOG} SELECT * FROM grants
        WHERE ds_id NOT IN (SELECT id FROM sources WHERE vendor_id = '3')""",
    "update_published": """SELECT c_custkey, c_name, c_nationkey, greatest(c_acctbal, 0) AS c_acctbal,
        CASE WHEN c_acctbal < 0 THEN 'OVERDRAWN' ELSE c_mktsegment END AS c_mktsegment FROM customer""",
    "insert_checked": f"{_CATALOG} SELECT * FROM grants",
    "insert_refused": f"""{_CATALOG} SELECT 'one_grant' AS rule, count(*) AS n_rows FROM grants WHERE user_id % 6 = 0
        UNION ALL SELECT 'known_user', count(*) FROM grants WHERE user_id % 5 = 0
        UNION ALL SELECT 'source_given', count(*) FROM grants WHERE user_id % 7 = 0
        UNION ALL SELECT 'rows after', count(*) FROM grants WHERE user_id % 2 = 0""",
    "audit_unique": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "audit_foreign_key": """SELECT o_custkey, count(*) AS n_rows FROM orders
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_custkey""",
    "audit_check": f"SELECT * FROM ({_LABELLED}) WHERE NOT (doc_id < 10 OR quality = 1)",
    "audit_not_null": f"""SELECT * FROM (
        SELECT 'quality' AS column_name, count(*) - count(quality) AS n_nulls FROM ({_LABELLED})
        UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM ({_LABELLED})) WHERE n_nulls > 0""",
    # results
    "bounded_result": """SELECT *, (SELECT count(*) FROM orders) > 500 AS truncated FROM (
        SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500)""",
    "result_envelope": """SELECT 'event_id,user_id,value' AS cols, 'bigint,bigint,double' AS column_types,
        least(count(*), 300) AS rows_returned, count(*) > 300 AS truncated, CAST(NULL AS BIGINT) AS rows_affected, 'select' AS stmt_cmd, 'query' AS stmt_type
        FROM events WHERE event_type = 'click'""",
    "page_rows": """(SELECT * FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 45)
        UNION ALL (SELECT * FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 13500)""",
    "page_of_events": "SELECT ts, event_id, event_type FROM events ORDER BY ts, event_id LIMIT 20 OFFSET 9000",
    "page_stored_index": """(SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 6660)
        UNION ALL (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 160)""",
    "page_index": """SELECT o_orderdate, o_orderkey, o_totalprice, (n - 1) // 15 AS page, (n - 1) % 15 + 1 AS place
        FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""",
    "header_sample": f"""SELECT row_number() OVER (ORDER BY k) AS place, * EXCLUDE (k) FROM (
        SELECT o_orderkey AS k, {_ORDER_TEXTS} FROM orders ORDER BY k LIMIT 10)
        UNION ALL SELECT 11, 'o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'""",
    "display_profile": " UNION ALL ".join(
        f"SELECT {i} AS position, '{name}' AS column_name, "
        f"greatest(2, max({length}), {len(name)}) AS max_length FROM lineitem"
        for i, (name, length) in enumerate(_LENGTHS.items())
    ),
    "column_widths": f"""WITH d AS ({_LABELLED}),
        p AS ({" UNION ALL ".join(
            f"SELECT {i} AS position, '{name}' AS column_name, greatest(2, {len(name)}, max(coalesce(length(CAST({name} AS VARCHAR)), 4))) AS max_length FROM d"
            for i, name in enumerate(("doc_id", "lang", "source", "n_chars", "quality", "toxic"))
        )}),
        a AS (SELECT *, max_length * 6.5 + 12 AS need FROM p),
        b AS (SELECT *, need <= floor((600 - coalesce(sum(need) OVER (ORDER BY need, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (count(*) OVER () - row_number() OVER (ORDER BY need, position) + 1)) AS alone FROM a),
        c AS (SELECT *, bool_and(alone) OVER (ORDER BY need, position) AS fits FROM b),
        t AS (SELECT 600 - coalesce(sum(need) FILTER (WHERE fits), 0) AS rest, count(*) AS n, count(*) FILTER (WHERE NOT fits) AS k FROM c),
        w AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY position) AS turn FROM c, t)
        SELECT position, column_name, max_length, CAST(CASE
            WHEN fits THEN floor(need + CASE WHEN k = 0 AND rest > n THEN floor(least(rest, (600 - rest) * 0.2) / n) ELSE 0 END)
            ELSE floor(floor(rest) / k) + CASE WHEN turn > k - floor(rest) % k THEN 1 ELSE 0 END END AS INTEGER) AS width FROM w""",
    "group_options": """SELECT "group", min(doc_id) OVER (PARTITION BY "group") AS group_order,
        row_number() OVER (PARTITION BY "group" ORDER BY doc_id) AS place, doc_id AS value, source AS label
        FROM (SELECT *, CASE WHEN lang = 'en' OR lang IS NULL THEN '' ELSE lang END AS "group" FROM documents)""",
    "concat_lines": "SELECT doc_id, replace(text, chr(10), '') AS text FROM documents",
    "definition_text": "SELECT doc_id, CASE WHEN text <> '' THEN text ELSE source END AS text FROM documents",
    # values
    "to_text": f"SELECT {_ORDER_TEXTS} FROM orders",
    "render_cells": f"""SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, 'null') AS lang, coalesce(source, 'null') AS source,
        coalesce(CAST(n_chars AS VARCHAR), 'null') AS n_chars, coalesce(CAST(quality AS VARCHAR), 'null') AS quality,
        CASE WHEN toxic THEN 'true' WHEN NOT toxic THEN 'false' ELSE 'null' END AS toxic FROM ({_LABELLED})""",
    "row_to_json": f"""SELECT doc_id, CAST(json_object('doc_id', doc_id, 'lang', lang, 'source', source, 'n_chars', n_chars,
        'quality', quality, 'toxic', toxic) AS VARCHAR) AS line FROM ({_LABELLED})""",
    "base_name": r"SELECT page_id, regexp_extract(url, '[^/\\]*$') AS base_name FROM pages",
    "duration_ms": """SELECT event_id, (ns + 999999) // 1000000 AS ms,
        CASE WHEN ns = 0 THEN '<1 ms' ELSE ((ns + 999999) // 1000000) || ' ms' END AS shown
        FROM (SELECT event_id, event_id * 1234567 % 5000000 AS ns FROM events)""",
    "canonical_types": f"""{_COLUMNS}, {_CANONICAL_STEPS}
        SELECT table_name, ordinal, vendor, data_type, canonical FROM typed""",
    "vendor_types": f"""{_COLUMNS}, {_MATRIX}, asked AS (SELECT table_name, ordinal, vendor,
            (SELECT list(c) FROM matrix)[(length(table_name) + ordinal) % 14 + 1] AS canonical FROM columns)
        SELECT table_name, ordinal, vendor, canonical, CASE vendor WHEN 'mssql' THEN mssql WHEN 'sqlite3' THEN sqlite3
            WHEN 'postgresql' THEN postgresql WHEN 'clickhouse' THEN clickhouse ELSE mysql END AS vendor_type
        FROM asked JOIN matrix ON c = canonical""",
    "convert_types": f"""{_COLUMNS}, {_CANONICAL_STEPS}, {_MATRIX}
        SELECT table_name, ordinal, vendor, data_type, postgresql FROM typed JOIN matrix ON c = canonical""",
    "quote_identifiers": f"""{_COLUMNS} SELECT table_name, ordinal, vendor, column_name, CASE
            WHEN vendor = 'mssql' THEN '[' || replace(column_name, ']', ']]') || ']'
            WHEN vendor = 'postgresql' THEN '"' || replace(column_name, '"', '""') || '"'
            ELSE '`' || replace(column_name, '`', '``') || '`' END AS quoted FROM columns""",
    "clean_statements": f"{_LOG}{_CLEAN} SELECT origin, stmt_id, s AS cleaned FROM cleaned",
    "classify_statements": rf"""{_LOG}{_CLEAN}, words AS (SELECT *, regexp_extract(s, '^[^{_WS}]*') AS cmd FROM cleaned)
        SELECT origin, stmt_id, vendor, cmd AS stmt_cmd, CASE
            WHEN cmd NOT IN ('insert', 'update', 'delete', 'drop', 'alter', 'create') THEN 'query'
            WHEN vendor = 'mssql' AND regexp_matches(s, '\soutput\s') THEN 'query'
            WHEN vendor <> 'mssql' AND regexp_matches(s, '\sreturning\s') THEN 'query'
            ELSE 'non-query' END AS stmt_type FROM words""",
    # dictionary
    "dict_schemas": rf"{_COLUMNS} SELECT DISTINCT table_schema FROM columns WHERE table_schema NOT LIKE 'pg\_%' ESCAPE '\'",
    "distinct_lower": f"{_COLUMNS} SELECT DISTINCT lower(table_name) AS table_name FROM columns",
    "dict_tables": f"{_COLUMNS} SELECT DISTINCT table_schema, table_name FROM columns WHERE table_type = 'BASE TABLE'",
    "dict_views": f"{_COLUMNS} SELECT DISTINCT table_schema, table_name FROM columns WHERE table_type = 'VIEW'",
    "dict_columns": f"""{_COLUMNS} SELECT table_schema, table_name, ordinal, column_name, data_type, max_length, nullable,
        default_value, CASE WHEN table_type = 'BASE TABLE' AND (ordinal = 1 OR ordinal = 2 AND length(table_name) < 10)
            THEN 'YES' ELSE 'NO' END AS is_primary_key FROM columns""",
    "create_table_ddl": f"""{_COLUMNS}, {_CANONICAL_STEPS}, {_MATRIX}
        SELECT table_schema, table_name, 'CREATE TABLE `' || table_name || '` (' || string_agg(
            '`' || replace(column_name, '`', '``') || '` ' || mysql, ',' ORDER BY ordinal) || ')' AS text
        FROM typed JOIN matrix ON c = canonical GROUP BY table_schema, table_name""",
}
