"""CREATE TABLE statements: columns, types and keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from lakeloom.types import spark_type

_CREATE = re.compile(r"\s*create\s+table\s+(?:if\s+not\s+exists\s+)?([\w`\".]+)\s*\((.*)\)\s*;?\s*$", re.I | re.S)
_COLUMN = re.compile(r"([\w`\"]+)\s+(\w+(?:\s*\([^)]*\))?)(.*)$", re.S)
_NAMES = re.compile(r"\(([^)]*)\)")


@dataclass(frozen=True)
class TableDef:
    """A declared table. Names are lower-case; keys are in order of declaration."""

    name: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    indexes: tuple[str, ...] = ()


def _name(text: str) -> str:
    return text.strip().strip('`"').lower()


def split_top(text: str, mark: str) -> list[str]:
    """Parts of text between marks that stand outside of brackets and quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == mark and not depth:
            parts.append(text[start:i])
            start = i + 1
    return [*parts, text[start:]]


def is_create_table(statement: str) -> bool:
    return re.match(r"\s*create\s+table\b", statement, re.I) is not None


def parse_create_table(statement: str) -> TableDef:
    """The table that a CREATE TABLE statement declares.

    PRIMARY KEY may follow a column or stand alone; INDEX and KEY name index columns; REFERENCES,
    FOREIGN KEY, UNIQUE, CHECK and DEFAULT are read over.
    """
    match = _CREATE.match(statement)
    if not match:
        raise ValueError(f"not a CREATE TABLE statement: {statement.strip()[:80]}")
    fields, primary, indexes = [], [], []
    for item in split_top(match[2], ","):
        item = item.strip()
        words = item.upper().split()
        if not words:
            continue
        if words[0] == "CONSTRAINT":
            item = " ".join(item.split()[2:])
            words = item.upper().split()
        head = words[0].split("(")[0]
        listed = [_name(n) for n in _NAMES.search(item)[1].split(",")] if _NAMES.search(item) else []
        if head == "PRIMARY":
            primary += listed
        elif head in ("INDEX", "KEY"):
            indexes += listed
        elif head in ("FOREIGN", "UNIQUE", "CHECK"):
            continue
        else:
            column = _COLUMN.match(item)
            if not column:
                raise ValueError(f"not a column: {item}")
            rest = column[3].upper()
            fields.append(T.StructField(_name(column[1]), spark_type(column[2])))
            if "PRIMARY KEY" in rest:
                primary.append(fields[-1].name)
    names = {f.name for f in fields}
    if len(names) != len(fields):
        raise ValueError(f"a column is declared twice in {match[1]}")
    if unknown := [k for k in [*primary, *indexes] if k not in names]:
        raise ValueError(f"key of unknown columns: {', '.join(unknown)}")
    return TableDef(_name(match[1]), T.StructType(fields), tuple(primary), tuple(indexes))
