"""A small interactive shell: ``python -m lakequill.cli [folder]``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .errors import EngineError
from .session import Session
from .sources.dump import dump, formatted
from .sql.lexer import statements, tokens


class Shell:
    """Commands that begin with a dot, and statements that end with a semicolon."""

    def __init__(self, session: Session, out=print) -> None:
        self.session, self.out = session, out
        self.mode, self.headers, self.pending = "list", False, ""

    def line(self, text: str) -> bool:
        """Takes one line; False ends the shell."""
        if not self.pending and text.strip().startswith("."):
            return self.command(text.strip())
        self.pending += text + "\n"
        if self._complete():
            ready, self.pending = self.pending, ""
            self._run(ready)
        return True

    def _complete(self) -> bool:
        try:
            found = tokens(self.pending)
        except EngineError:
            return self.pending.rstrip().endswith(";") and self.pending.count("'") % 2 == 0
        return len(found) > 1 and found[-2].text == ";" and found[-2].kind == "sign"

    def _run(self, script: str) -> None:
        try:
            for s in statements(script):
                result = self.session.execute(s)
                if isinstance(result, DataFrame):
                    text = formatted(result.columns, result.collect(), self.mode, self.headers)
                    if text:
                        self.out(text)
        except Exception as e:  # the shell goes on after any error
            self.out(f"Error: {e}")

    def command(self, text: str) -> bool:
        name, *args = text.split()
        s = self.session
        if name in (".quit", ".exit"):
            return False
        if name == ".tables":
            self.out("  ".join(sorted([t.name for t in s.catalog.tables.values()] + s.foreign())))
        elif name == ".schema":
            for x in [*s.catalog.tables.values(), *s.catalog.indexes.values()]:
                if not args or args[0].lower() in (x.name.lower(), getattr(x, "table", "").lower()):
                    self.out(x.sql.rstrip(";") + ";")
        elif name in (".indexes", ".indices"):
            self.out("\n".join(i.name for i in s.catalog.indexes.values() if not args or i.table.lower() == args[0].lower()))
        elif name == ".headers" and args:
            self.headers = args[0].lower() == "on"
        elif name == ".mode" and args and args[0] in ("list", "column", "csv", "line"):
            self.mode = args[0]
        elif name == ".read" and args:
            with open(args[0], encoding="utf-8") as f:
                self._run(f.read())
        elif name == ".dump":
            for x in dump(s, args[0] if args else None):
                self.out(x)
        elif name == ".open" and args:
            self.session = Session(s.spark, args[0])
        elif name == ".help":
            self.out(".quit .exit .tables .schema .indexes .indices .headers on|off .mode list|column|csv|line .read FILE .dump [TABLE] .open FOLDER .help")
        else:
            self.out(f"unknown command: {text}; .help lists all")
        return True


def main(argv: list[str]) -> None:
    spark = SparkSession.builder.appName("lakequill").config("spark.ui.enabled", "false").getOrCreate()
    shell = Shell(Session(spark, argv[0] if argv else None))
    while True:
        try:
            text = input("   ...> " if shell.pending else "quill> ")
        except EOFError:
            return
        if not shell.line(text):
            return


if __name__ == "__main__":
    main(sys.argv[1:])
