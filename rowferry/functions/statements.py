"""Classifying SQL statements of a query log, as column expressions.

Nothing here parses SQL: comments are cut by line rules, and the first word
decides. The rules know no string literals, so that ``--`` or ``//`` within a
literal also cuts the line, and a block comment counts only where a line
starts with it.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.functions.spaces import trim_space

# The commands that change data or tables.
NON_QUERY_COMMANDS = ("insert", "update", "delete", "drop", "alter", "create")

MAX_IDENTIFIER_LENGTH = 63


def clean_statement(sql: Column) -> Column:
    """A statement without its comments, lower-cased, its lines joined by one space.

    Lines are trimmed; empty and comment lines go, and so do block comments that
    open a line (they may follow one another, run over lines, or stay open to
    the end). The rest of a line is cut at ``--`` or ``//``. The one regular
    expression tries line starts only and never backtracks, so that the time is
    linear in the text.
    """
    lines = F.transform(F.split(F.lower(sql), "\n"), trim_space)
    kept = F.filter(
        lines, lambda line: (line != "") & ~F.startswith(line, F.lit("--")) & ~F.startswith(line, F.lit("//"))
    )
    text = F.regexp_replace(F.array_join(kept, "\n"), r"(?Umd)^(?:/(?=\*)[\s\S]*?(?:\*/|\z)\s*+)++", "")
    code = F.transform(
        F.split(text, "\n"), lambda line: F.substring_index(F.substring_index(line, "--", 1), "//", 1)
    )
    return F.array_join(F.filter(code, lambda line: line != ""), " ")


def statement_command(cleaned: Column) -> Column:
    """The first word of a cleaned statement."""
    return F.regexp_extract(cleaned, r"(?U)\A\S*+", 0)


def statement_type(cleaned: Column, vendor: Column | str) -> Column:
    """``non-query`` for a change that returns no rows, else ``query``."""
    vendor = vendor if isinstance(vendor, Column) else F.lit(vendor)
    returns_rows = F.when(vendor == "mssql", F.rlike(cleaned, F.lit(r"[\t\n\f\r ]output[\t\n\f\r ]"))).otherwise(
        F.rlike(cleaned, F.lit(r"[\t\n\f\r ]returning[\t\n\f\r ]"))
    )
    changes = statement_command(cleaned).isin(*NON_QUERY_COMMANDS)
    return F.when(changes & ~returns_rows, F.lit("non-query")).otherwise(F.lit("query"))


def classify_statements(df: DataFrame, sql: str, vendor: str) -> DataFrame:
    """A query log with each statement's command and type; the text is cleaned once a row."""
    cleaned = df.withColumn("__cleaned", clean_statement(F.col(sql)))
    return cleaned.withColumns(
        {
            "stmt_cmd": statement_command(F.col("__cleaned")),
            "stmt_type": statement_type(F.col("__cleaned"), F.col(vendor)),
        }
    ).drop("__cleaned")


def is_valid_identifier(name: Column) -> Column:
    """A letter or underscore, then letters, digits, underscores or ``$``; 63 at most."""
    return F.rlike(name, F.lit(r"\A[_\p{L}][_\p{L}\p{N}$]*+\z")) & (F.length(name) <= MAX_IDENTIFIER_LENGTH)


def is_identifier(name: str) -> bool:
    """The same rule for one name on the driver."""
    kinds = [unicodedata.category(letter)[0] for letter in name]
    first, rest = name[:1], zip(name[1:], kinds[1:], strict=True)
    return (
        0 < len(name) <= MAX_IDENTIFIER_LENGTH
        and (first == "_" or kinds[0] == "L")
        and all(letter in "_$" or kind in "LN" for letter, kind in rest)
    )
