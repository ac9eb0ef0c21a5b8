"""Files of SQL statements."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from typing import TextIO

from pyspark.sql import DataFrame

from lakeloom.catalog import Catalog
from lakeloom.ddl import is_create_table
from lakeloom.layout import load
from lakeloom.sources.sinks import print_rows


def split_statements(text: str) -> list[str]:
    """Statements between semicolons; quotes and comments hide semicolons, and comments go."""
    out, now, i, quote = [], [], 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif text.startswith("--", i):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
            continue
        elif c == ";":
            out.append("".join(now))
            now, i = [], i + 1
            continue
        now.append(c)
        i += 1
    return [s.strip() for s in [*out, "".join(now)] if s.strip()]


@dataclass
class Outcome:
    statement: str
    rows: int | None = None
    error: str | None = None


def run_script(catalog: Catalog, text: str, out: TextIO | None = None, err: TextIO | None = None, loading: bool = False, buckets: int = 8, index: dict[str, str] | None = None) -> list[Outcome]:
    """Run each statement: CREATE TABLE registers a table (and stores it, when loading, by the column that index names
    for it), any other is a query whose rows are printed. A failure is reported and the next statement runs."""
    done = []
    for statement in split_statements(text):
        try:
            if is_create_table(statement):
                table = catalog.create(statement)
                if loading:
                    load(catalog, table.name, buckets, (index or {}).get(table.name))
                done.append(Outcome(statement))
            else:
                result: DataFrame = catalog.sql(statement)
                done.append(Outcome(statement, rows=print_rows(result, out)))
        except Exception as e:  # noqa: BLE001  reported, and the script goes on
            print(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=err or sys.stderr)
            done.append(Outcome(statement, error=str(e)))
    return done
