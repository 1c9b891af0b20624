"""Command line: run a script, statements, or an interactive session over a folder of tables."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame

from brindle.plans.statements import execute, execute_all, render, run_script, save
from brindle.plans.workspace import Workspace
from brindle.session import build_session

HELP = ".help  .tables  .schema [table]  .open FOLDER (of CSV files)  .run FILE  .clear  .quit"


def options(args: Sequence[str] | None = None) -> argparse.Namespace:
    """Parsed options; conflicts and missing values end the process with status 2."""
    p = argparse.ArgumentParser(prog="brindle", description=__doc__)
    p.add_argument("--data", default="data", help="folder of the tables")
    what = p.add_mutually_exclusive_group()
    what.add_argument("-f", "--file", help="run a script")
    what.add_argument("-q", "--query", help="run one or more statements")
    what.add_argument("-r", "--repl", action="store_true", help="interactive session")
    p.add_argument("-o", "--output", help="with -q: write all rows there (a folder of CSV files if it ends in .csv, else Parquet)")
    o = p.parse_args(args)
    if o.output and not o.query:
        p.error("--output needs --query")
    return o


def _show(result, output: str | None = None) -> None:
    if isinstance(result, DataFrame):
        for line in [save(result, output)] if output else render(result):
            print(line)
        return
    if result:
        print("\n".join(result))
    if output:
        print("(no rows to write)")


def meta(ws: Workspace, line: str) -> bool:
    """A command that starts with a point; False ends the session."""
    word, _, rest = line.strip().partition(" ")
    if word in (".quit", ".exit"):
        return False
    if word == ".tables":
        print("\n".join(f"{n} ({k} columns)" for n, k in sorted(ws.tables().items())))
    elif word == ".schema":
        for t in [ws.catalog.get(rest)] if rest else ws.catalog.tables.values():
            marks = lambda c: " ".join(x for x, on in (("PRIMARY KEY", c.name in t.primary_key), ("NOT NULL", c.not_null), ("UNIQUE", c.unique), (f"REFERENCES {c.references}", c.references), (f"CHECK ({c.check})", c.check)) if on)  # noqa: E731, B023
            print(t.name, *[f"  {c.name} {c.type} {marks(c)}".rstrip() for c in t.columns], *[f"  CHECK ({x})" for x in t.checks], sep="\n")
    elif word == ".open":
        print("\n".join(ws.import_folder(rest)) or "(no new table)")
    elif word == ".run":
        with open(rest, encoding="utf-8") as f:
            run_script(ws, f.read())
    elif word == ".clear":
        print("\033[2J\033[H", end="")
    else:
        print(HELP)
    return True


def repl(ws: Workspace) -> None:
    """Statements end with a semicolon; an error does not end the session."""
    history = os.path.expanduser("~/.brindle_history")
    with contextlib.suppress(ImportError, OSError):
        import readline

        readline.read_history_file(history)
    held = ""
    while True:
        try:
            line = input("      -> " if held else "brindle> ")
        except (EOFError, KeyboardInterrupt):
            break
        if not held and line.strip().startswith("."):
            try:
                if not meta(ws, line):
                    break
            except (ValueError, OSError) as e:
                print(e)
            continue
        held += line + "\n"
        if line.rstrip().endswith(";"):
            try:
                for result in execute_all(ws, held):
                    _show(result)
            except Exception as e:  # shown, and the session goes on
                print(f"{type(e).__name__}: {str(e).splitlines()[0]}")
            held = ""
    with contextlib.suppress(ImportError, OSError):
        import readline

        readline.write_history_file(history)


def main(args: Sequence[str] | None = None) -> int:
    o = options(args)
    ws = Workspace(build_session(), o.data)
    if o.file:
        with open(o.file, encoding="utf-8") as f:
            return int(run_script(ws, f.read()) > 0)
    if o.query:
        try:
            if o.output:
                _show(execute(ws, o.query), o.output)
            else:
                for result in execute_all(ws, o.query):
                    _show(result)
        except Exception as e:
            print(f"{type(e).__name__}: {str(e).splitlines()[0]}", file=sys.stderr)
            return 1
        return 0
    repl(ws)
    return 0


if __name__ == "__main__":
    sys.exit(main())
