"""What a copy reads from and writes to."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from rowferry.functions.texts import quoted_name


@dataclass(frozen=True)
class Endpoint:
    """One side of a copy.

    ``type`` is ``table``, ``query`` (origin only) or ``file``. A table is
    named by ``table`` and, if need be, ``schema``; with ``jdbc`` (the options
    of Spark's JDBC source) it lies in a database, else in Spark's catalog. A
    file endpoint is a folder, read and written in parallel, in one ``format``:
    ``csv``, ``json``, ``jsonTabular`` or ``xlsx``. ``options`` go to the
    format's reader or writer.
    """

    type: str
    table: str | None = None
    schema: str | None = None
    new_table: bool = False
    query: str | None = None
    args: Mapping[str, Any] | None = None
    format: str | None = None
    path: str | None = None
    vendor: str | None = None
    jdbc: Mapping[str, str] | None = None
    options: Mapping[str, Any] = field(default_factory=dict)

    def qualified_table(self) -> str:
        """The table's name for Spark SQL, every part quoted."""
        parts = [part for part in (self.schema, self.table) if part]
        return ".".join(quoted_name(part) for part in parts)
