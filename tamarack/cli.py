"""The command line and the shell: ``python -m tamarack [path] [switches]``."""

from __future__ import annotations

import argparse
import os
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from tamarack.engine import Engine, Options
from tamarack.errors import EngineError
from tamarack.plans import ast
from tamarack.plans.parser import parse

HELP = """.help;            this text
.pwd;             the folder that tables are looked for in
.cd "folder";     go to another folder
.debug on|off;    show plans
.pretty on|off;   show results in cells
Anything else is a query, ended by a semicolon; end of file leaves the shell.
"""


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("tamarack", description="Queries over files, run by Spark. Without a path, a shell.")
    p.add_argument("path", nargs="?", help="a file with a query")
    p.add_argument("--output", help="a file for the result")
    p.add_argument("--graph", help="a file for the statement's graph in DOT")
    p.add_argument("--use-caching", action="store_true", help="keep tables that are read, and subqueries that a statement repeats")
    p.add_argument("--no-select-push-down", action="store_true", help="don't push filters down")
    p.add_argument("--no-projection-opti", action="store_true", help="don't prune columns")
    p.add_argument("--no-joins", action="store_true", help="don't turn products into joins")
    p.add_argument("--big-data", action="store_true", help="sort-merge joins instead of broadcasts")
    return p


class Shell:
    def __init__(self, engine: Engine, out: TextIO):
        self.engine, self.out, self.debug, self.pretty = engine, out, False, False

    def run(self, text: str) -> None:
        statement = parse(text)
        if isinstance(statement, ast.Command):
            self.command(statement)
            return
        if self.debug:
            self.out.write(self.engine.explain(text, "extended") + "\n")
        self.engine.write(self.engine.lower(statement), self.out, self.pretty)

    def command(self, command: ast.Command) -> None:
        match command:
            case ast.Command("help"):
                self.out.write(HELP)
            case ast.Command("pwd"):
                self.out.write((self.engine.catalog.base_dir or os.getcwd()) + "\n")
            case ast.Command("cd", str(path)):
                self.out.write(self.engine.change_dir(path) + "\n")
            case ast.Command("debug" | "pretty" as name, "on" | "off" as value):
                setattr(self, name, value == "on")
            case _:
                self.out.write(f"unknown command: .{command.name}\n")

    def loop(self, lines: TextIO, prompt: bool) -> None:
        held = ""
        while True:
            if prompt:
                self.out.write("> " if not held else "  ")
                self.out.flush()
            line = lines.readline()
            held += line
            while ";" in held or (not line and held.strip()):
                text, _, held = held.partition(";")
                try:
                    self.run(text + ";")
                except EngineError as error:
                    self.out.write(f"{error}\n")
            if not line:
                return


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("tamarack").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    engine = Engine(spark, os.getcwd(), Options(a.use_caching, not a.no_select_push_down, not a.no_projection_opti, not a.no_joins, a.big_data))
    if not a.path:
        Shell(engine, sys.stdout).loop(sys.stdin, sys.stdin.isatty())
        return 0
    try:
        with open(a.path, encoding="utf-8") as f:
            text = f.read()
        if a.graph:
            with open(a.graph, "w", encoding="utf-8") as f:
                f.write(engine.to_dot(text))
        if a.output:
            with open(a.output, "w", encoding="utf-8") as f:
                engine.write(engine.sql(text), f)
        else:
            engine.write(engine.sql(text), sys.stdout)
    except (EngineError, OSError) as error:
        print(error, file=sys.stderr)
        return 1
    return 0
