"""A database as statements, and results as text."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from ..session import Session


def _value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, bytes | bytearray):
        return f"X'{bytes(v).hex()}'"
    return repr(v)


def dump(session: Session, only: str | None = None) -> Iterator[str]:
    """CREATE and INSERT statements, row by row in the order of row ids, without holding a table in memory."""
    yield "BEGIN TRANSACTION;"
    for t in session.catalog.tables.values():
        if only is not None and t.name.lower() != only.lower():
            continue
        yield t.sql.rstrip(";") + ";"
        for row in session.catalog.read(t).orderBy("_rowid_").drop("_rowid_").toLocalIterator():
            yield f"INSERT INTO \"{t.name}\" VALUES ({', '.join(map(_value, row))});"
        for i in session.catalog.indexes.values():
            if i.table.lower() == t.name.lower():
                yield i.sql.rstrip(";") + ";"
    yield "COMMIT;"


def shown(v) -> str:
    if v is None:
        return ""
    return bytes(v).hex().upper() if isinstance(v, bytes | bytearray) else str(v)


def formatted(columns: list[str], rows: list, mode: str = "list", headers: bool = False) -> str:
    """Rows as text in the mode list, column, csv or line."""
    cells = [[shown(v) for v in r] for r in rows]
    if mode == "csv":
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n")
        writer.writerows(([columns] if headers else []) + cells)
        return out.getvalue().rstrip("\n")
    if mode == "line":
        width = max(map(len, columns), default=0)
        return "\n\n".join("\n".join(f"{c:>{width}} = {v}" for c, v in zip(columns, r, strict=True)) for r in cells)
    if mode == "column":
        widths = [max(len(x) for x in col) for col in zip(columns, *cells, strict=True)] if cells else [len(c) for c in columns]
        lines = [columns, ["-" * w for w in widths]] if headers else []
        return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [*lines, *cells])
    return "\n".join("|".join(r) for r in ([columns] if headers else []) + cells)
