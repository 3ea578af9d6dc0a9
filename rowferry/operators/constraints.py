"""Inserts that keep a table's constraints: unique, foreign-key, check and not-null rules as data."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowferry.operators.access import gated
from rowferry.operators.audits import audit_foreign_key
from rowferry.operators.versions import exclusive
from rowferry.plans.session import scratch_path
from rowferry.sources.tables import fit_to_table


@dataclass(frozen=True)
class Rule:
    """A constraint. ``kind`` is ``unique``, ``foreign_key``, ``check`` or ``not_null``.

    ``parent`` and ``parent_columns`` are those of a foreign key, a catalog
    table, which may be the table itself; ``condition`` is the SQL of a check.
    """

    name: str
    kind: str
    columns: tuple[str, ...] = ()
    parent: str | None = None
    parent_columns: tuple[str, ...] = ()
    condition: str | None = None

    def __post_init__(self):
        if self.kind not in ("unique", "foreign_key", "check", "not_null"):
            raise ValueError(f"no such kind of rule: {self.kind!r}")


class ConstraintViolation(ValueError):
    """Rules that new rows break, with the number of rows."""

    def __init__(self, table: str, broken: dict[str, int]):
        super().__init__(f"rows for {table} break " + ", ".join(f"{name} ({n})" for name, n in sorted(broken.items())))
        self.broken = broken


def _repeated(rule: Rule, staged: DataFrame, target: DataFrame) -> DataFrame:
    """New rows whose key another new row or a row of the target has; keys with a null are exempt.

    The new rows are counted by key before they are shuffled, so a hot key is one row a task, and the target is
    met by distinct keys, which Spark broadcasts where they are few.
    """
    keys = list(rule.columns)
    whole = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    counted = staged.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    known = target.select(*keys).join(counted.select(*keys), keys).distinct().withColumn("n_known", F.lit(1))
    both = counted.select(*keys, "n_rows", F.lit(0).alias("n_known")).unionByName(known.select(*keys, F.lit(0).cast("bigint").alias("n_rows"), "n_known"))
    met = both.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows"), F.max("n_known").alias("n_known"))
    return met.where("n_rows > 1 OR n_known > 0")


def broken_rules(staged: DataFrame, target: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """rule, n_rows: the rules that new rows break, on their own or with the rows of the target. One job for all rules.

    As in SQL, keys with a null break no unique and no foreign-key rule, and a check whose outcome is unknown passes.
    """
    spark = staged.sparkSession
    by_row = {rule.name: ~F.expr(rule.condition) for rule in rules if rule.kind == "check"}
    by_row |= {rule.name: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in rule.columns]) for rule in rules if rule.kind == "not_null"}
    found = []
    if by_row:
        counts = staged.agg(*[F.count_if(wrong).alias(f"c{i}") for i, wrong in enumerate(by_row.values())])
        named = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"c{i}").alias("n_rows")) for i, name in enumerate(by_row)])
        found.append(counts.select(F.inline(named)))
    for rule in rules:
        if rule.kind == "unique":
            wrong = _repeated(rule, staged, target)
        elif rule.kind == "foreign_key":
            parent = spark.table(rule.parent).select(*rule.parent_columns)
            if rule.parent == table:
                parent = parent.unionByName(staged.select(*rule.parent_columns))
            wrong = audit_foreign_key(staged, list(rule.columns), parent, list(rule.parent_columns))
        else:
            continue
        found.append(wrong.agg(F.lit(rule.name).alias("rule"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")))
    if not found:
        return spark.createDataFrame([], "rule string, n_rows bigint")
    return reduce(DataFrame.unionByName, found).where("n_rows > 0")


def checked_append(spark: SparkSession, table: str, new_rows: DataFrame, rules: list[Rule], gate: DataFrame | None = None) -> int:
    """Append rows to a catalog table if none breaks a rule; their number.

    The rows are computed once, into a staging folder, tested there together
    with the table, and published in one insert. The table is held meanwhile,
    so that another writer of this library cannot add what would break a rule
    between test and insert. A violating batch changes nothing and the error
    names its rules. With a gate that is closed there are no rows.
    """
    with exclusive(spark, table):
        spark.catalog.refreshTable(table)
        target = spark.table(table)
        folder = scratch_path(spark, "stage")
        rows = fit_to_table(new_rows, target.schema)
        (rows if gate is None else gated(rows, gate)).write.parquet(folder)
        staged = spark.read.schema(target.schema).parquet(folder)
        broken = {row["rule"]: row["n_rows"] for row in broken_rules(staged, target, table, rules).collect()}  # a row per rule
        if broken:
            raise ConstraintViolation(table, broken)
        staged.write.insertInto(table)
        return staged.count()
