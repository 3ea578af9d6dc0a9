"""Who may see and change what, over tables of users, sources and grants.

The principal is one row of the users, by unique name. Its name and its flag
enter a plan as scalar subqueries and a gate as ``EXISTS``: Spark evaluates
them once, before the scan they guard, and no join remains. If the principal
is missing, every comparison with it is null and no row passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.operators.versions import change_table


class NotAllowed(LookupError):
    """The named row does not exist or the caller may not see it."""


def mask_column(df: DataFrame, column: str, visible: Column, replacement: str = "") -> DataFrame:
    """Show a column only where ``visible`` holds; elsewhere the replacement stands."""
    return df.withColumn(column, F.when(visible, F.col(column)).otherwise(F.lit(replacement)))


def principal_row(users: DataFrame, principal: str) -> DataFrame:
    """The caller's row; names are unique, and one row is all that is ever used."""
    return users.where(F.col("name") == principal).limit(1)


def admin_gate(users: DataFrame, principal: str) -> DataFrame:
    """A row if the caller is an admin, else none."""
    return principal_row(users, principal).where(F.col("isadmin") == 1)


def is_self_or_admin(users: DataFrame, principal: str, name: Column) -> Column:
    """Whether a row of that user name is the caller's own, or the caller is an admin."""
    caller = principal_row(users, principal)
    return (name == caller.select("name").scalar()) | (caller.select("isadmin").scalar() == 1)


def visible_users(users: DataFrame, principal: str) -> DataFrame:
    """All users for an admin, else only the caller."""
    return users.where(is_self_or_admin(users, principal, F.col("name"))).select("name", "isadmin")


def gated(df: DataFrame, gate: DataFrame) -> DataFrame:
    """All rows if the gate has a row, else none."""
    return df.where(gate.exists())


def resolve_grants(users: DataFrame, grants: DataFrame, sources: DataFrame, vendors: DataFrame) -> DataFrame:
    """Every grant with its user, source and vendor by name.

    Grants are by far the largest table. Sources meet their vendors first, so
    that grants are shuffled for two joins only; where one user or source holds
    many of them, the skewed part is split at run time.
    """
    named_sources = sources.select(
        F.col("id").alias("ds_id"), F.col("name").alias("source"), "location", F.col("vendor_id").cast("int").alias("vendor_id")
    ).join(vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor")), "vendor_id")
    named_users = users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    granted = grants.join(named_users, "user_id").join(named_sources, "ds_id")
    return granted.select("user_name", "source", "vendor", "location")


def entitled(
    users: DataFrame,
    grants: DataFrame,
    sources: DataFrame,
    vendors: DataFrame,
    principal: str,
    user_name: str | None = None,
    open_vendor: str = "sqlite3",
) -> DataFrame:
    """The granted sources that the caller may see, of one user or of all.

    The location shows to an admin, and to anyone for sources of the open
    vendor; otherwise it is ''.
    """
    chosen = users.where(is_self_or_admin(users, principal, F.col("name")))
    if user_name is not None:
        chosen = chosen.where(F.col("name") == user_name)
    rows = resolve_grants(chosen, grants, sources, vendors)
    admin = principal_row(users, principal).select("isadmin").scalar() == 1
    return mask_column(rows, "location", admin | (F.col("vendor") == open_vendor))


def ungranted(
    users: DataFrame, grants: DataFrame, sources: DataFrame, vendors: DataFrame, principal: str, user_name: str
) -> DataFrame:
    """The sources that a user does not have yet; only an admin sees them."""
    user_id = users.where(F.col("name") == user_name).select("id").limit(1).scalar()
    held = grants.where(F.col("user_id") == user_id).select(F.col("ds_id").alias("id"))
    free = sources.join(held, "id", "left_anti").withColumn("vendor_id", F.col("vendor_id").cast("int"))
    named = free.join(vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("vendor")), "vendor_id")
    return gated(named.select("name", "vendor", "location"), admin_gate(users, principal))


def require_row(df: DataFrame, condition: Column, what: str, user_name: str) -> DataFrame:
    """The one row that the condition names, or an error."""
    found = df.where(condition).limit(1)
    if found.isEmpty():
        raise NotAllowed(f"{what} not found or not allowed for user {user_name!r}")
    return found


# ---------------------------------------------------------------- changes


def guarded_rows(target: DataFrame, new_rows: DataFrame, gate: DataFrame) -> DataFrame:
    """A table with new rows added, if the gate is open."""
    return target.unionByName(gated(new_rows, gate))


def guarded_append(table: str, new_rows: DataFrame, gate: DataFrame) -> None:
    """Append new rows to a catalog table, if the gate is open."""
    target = new_rows.sparkSession.table(table)
    gated(new_rows, gate).select(*target.columns).write.insertInto(table)


def new_grant(users: DataFrame, sources: DataFrame, user_name: str, source: str) -> DataFrame:
    """The grant of a source to a user, both by name; no row if either is missing."""
    source_id = sources.where(F.col("name") == source).select("id").limit(1).scalar()
    granted = users.where(F.col("name") == user_name).select(F.col("id").alias("user_id"))
    return granted.withColumn("ds_id", source_id).where(F.col("ds_id").isNotNull())


def revoke(target: DataFrame, doomed: DataFrame, keys: list[str], gate: DataFrame | None = None) -> DataFrame:
    """A table without the rows whose keys are named, if the gate is open."""
    if gate is not None:
        doomed = gated(doomed, gate)
    return target.join(doomed.select(*keys), keys, "left_anti").select(*target.columns)


def update_where(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """A table with one column changed where the condition holds."""
    kind = df.schema[column].dataType
    return df.withColumn(column, F.when(condition, value.cast(kind)).otherwise(F.col(column)))


def revoke_from(table: str, doomed: DataFrame, keys: list[str], gate: DataFrame | None = None) -> bool:
    """Remove the rows whose keys are named from a catalog table; whether the gate was open.

    The table's next version is published at once, or the old one stays; see ``change_table``.
    """
    if gate is not None and gate.isEmpty():
        return False
    change_table(doomed.sparkSession, table, lambda rows: revoke(rows, doomed, keys))
    return True


def update_table(table: str, column: str, condition: Column, value: Column, gate: DataFrame) -> bool:
    """Change one column of a catalog table where the condition holds; whether the gate was open."""
    if gate.isEmpty():
        return False
    change_table(gate.sparkSession, table, lambda rows: update_where(rows, column, condition, value))
    return True
