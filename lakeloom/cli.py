"""python -m lakeloom.cli --data DIR [--db DIR] [--swap DIR] [--load] [--index TABLE.COLUMN]... FILE.sql..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass
from pathlib import Path

from lakeloom.catalog import Catalog
from lakeloom.session import build_session
from lakeloom.sql import run_script


@dataclass(frozen=True)
class Config:
    """Folders of a run: text tables, stored tables, and what spills. With `load`, CREATE TABLE stores its table
    in `db`, by the index column that is given for it; without, later runs find it there."""

    data: str
    db: str | None = None
    swap: str | None = None
    load: bool = False
    files: tuple[str, ...] = ()
    index: tuple[tuple[str, str], ...] = ()


def parse(argv: list[str]) -> Config:
    args = argparse.ArgumentParser(prog="lakeloom")
    args.add_argument("--data", required=True)
    args.add_argument("--db")
    args.add_argument("--swap")
    args.add_argument("--load", action="store_true")
    args.add_argument("--index", action="append", default=[], metavar="TABLE.COLUMN")
    args.add_argument("files", nargs="+")
    found = args.parse_args(argv)
    pairs = [i.lower().partition(".")[::2] for i in found.index]
    if not all(t and c for t, c in pairs):
        args.error("--index takes TABLE.COLUMN")
    return Config(found.data, found.db, found.swap, found.load, tuple(found.files), tuple(pairs))


def main(argv: list[str] | None = None) -> int:
    """Run the files in order in one session; 1 if a statement failed."""
    config = parse(sys.argv[1:] if argv is None else argv)
    spark = build_session(local_dir=config.swap)
    catalog = Catalog(spark, config.data, config.swap, config.db)
    failed = False
    for file in config.files:
        outcomes = run_script(catalog, Path(file).read_text(), loading=config.load, index=dict(config.index))
        failed |= any(o.error for o in outcomes)
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
