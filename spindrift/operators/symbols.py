"""Chunks by declared symbols, and relative imports against indexed paths."""

from __future__ import annotations

import ast
import posixpath
from collections.abc import Callable
from functools import partial
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import braces, chunking
from spindrift.operators.graph import EDGES, resolved, source_edges
from spindrift.operators.store import spread

SYMBOL_CHUNKS = "path string, start_line int, end_line int, contents string, symbol string, kind string, parent string"
#: Below this part of a file's characters in symbols, the file is cut by lines instead.
LEAST_COVERED = 0.35
# What a relative import may stand for, in this order.
EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".rs", ".java", ".cs")


def python_symbols(source: str) -> list[tuple[int, int, str, str, str | None]]:
    """(first line, last line, name, kind, parent) of functions, methods and class headers; [] if it does not parse."""
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple[int, int, str, str, str | None]] = []

    def collect(body: list[ast.stmt], parent: str | None) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                if isinstance(node, ast.ClassDef):
                    out.append((first, max(first, node.body[0].lineno - 1), node.name, "class", parent))
                    collect(node.body, node.name)
                else:
                    out.append((first, node.end_lineno or first, node.name, "function", parent))

    collect(module.body, None)
    return out


def _python(source: str) -> list[braces.Symbol]:
    lines = source.split("\n")
    ends = [0, *accumulate(len(x) + 1 for x in lines)]
    return [braces.Symbol(*s, ends[s[0] - 1], ends[s[1]]) for s in python_symbols(source)]


#: How the symbols of a language's sources are found; a caller may add others.
CHUNKED: dict[str, Callable[[str], list[braces.Symbol]]] = {"python": _python} | {x: partial(braces.symbols, language=x) for x in braces.RULES}


def chunk_symbols(files: DataFrame, size: int = 80, overlap: int = 15, most_chars: int = 20_000, by_language: dict[str, Callable[[str], list[braces.Symbol]]] | None = None) -> DataFrame:
    """SYMBOL_CHUNKS of files (path, contents) by the symbols of their language; where it is not known, or symbols cover too little, by lines.

    Files are cut each by itself, on all cores even if the table has few parts; a null or empty file has no chunks.
    """
    known = CHUNKED if by_language is None else by_language

    def run(batches):
        for batch in batches:
            rows = []
            for path, contents, language in zip(batch["path"], batch["contents"], batch["language"], strict=True):
                if not contents:
                    continue
                lines = contents.split("\n")
                found = known[language](contents) if language in known else []
                spans = [(s.first, s.last, s.name, s.kind, s.parent) for s in found]
                if not spans or sum(s.end - s.start for s in found) < LEAST_COVERED * len(contents):
                    spans = [(a, b, None, None, None) for a, b in chunking.spans_of(lines, size, overlap)]
                rows += [(path, *part, *s[2:]) for s in spans for part in chunking.by_characters(lines[s[0] - 1 : s[1]], s[0], most_chars)]
            yield pd.DataFrame(rows, columns=["path", "start_line", "end_line", "contents", "symbol", "kind", "parent"])

    return spread(files.select("path", "contents", X.language_of(F.col("path")).alias("language"))).mapInPandas(run, SYMBOL_CHUNKS)


def resolved_imports(imports: DataFrame, indexed: DataFrame) -> DataFrame:
    """path, specifier, target: the first indexed file that each relative import (path, specifier) may stand for."""
    tries = F.array(*[x for n, e in enumerate(EXTENSIONS) for x in (F.struct(F.lit(2 * n).alias("place"), F.lit(e).alias("ending")), F.struct(F.lit(2 * n + 1).alias("place"), F.lit(f"/index{e}").alias("ending")))])
    wanted = imports.where(F.col("specifier").startswith(".")).withColumn("base", resolved("path", "specifier")).select("path", "specifier", "base", F.explode(tries).alias("t"))
    hits = wanted.withColumn("target", F.concat("base", "t.ending")).join(indexed.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return hits.groupBy("path", "specifier").agg(F.min_by("target", "t.place").alias("target"))


def python_module(path: str, module: str, level: int) -> str:
    """The path, without an ending, that a module's name stands for; relative ones against the file."""
    name = module.replace(".", "/")
    if not level:
        return name
    return posixpath.normpath(posixpath.join(posixpath.dirname(path), *[".."] * (level - 1), name))


def python_edges(path: str, source: str) -> list[tuple]:
    """EDGES of a Python file by its syntax tree; none if it does not parse.

    Imports with the names they bind, top-level definitions and classes as exports, base classes, and calls of imported names.
    """
    try:
        module = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[tuple] = []
    bound: dict[str, tuple[str, str | None]] = {}
    for node in ast.walk(module):
        if isinstance(node, ast.Import):
            for name in node.names:
                target, local = python_module(path, name.name, 0), name.asname or name.name.split(".")[0]
                out.append((path, local, target, None, "imports", 0.9))
                bound[local] = (target, None)
        elif isinstance(node, ast.ImportFrom):
            target = python_module(path, node.module or "", node.level)
            for name in node.names:
                if name.name == "*":
                    out.append((path, None, target, None, "imports", 0.7))
                else:
                    out.append((path, name.asname or name.name, target, name.name, "imports", 1.0))
                    bound[name.asname or name.name] = (target, name.name)
        elif isinstance(node, ast.ClassDef):
            out.append((path, node.name, path, node.name, "exports", 1.0))
            for base in node.bases:
                name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else None
                if name:
                    out.append((path, node.name, path, name, "extends", 0.85))
    out += [(path, node.name, path, node.name, "exports", 1.0) for node in module.body if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))]
    for node in ast.walk(module):
        if isinstance(node, ast.Call):
            called = node.func if isinstance(node.func, ast.Name) else node.func.value if isinstance(node.func, ast.Attribute) else None
            if isinstance(called, ast.Name) and called.id in bound:
                target, symbol = bound[called.id]
                out.append((path, None, target, symbol, "calls", 0.75))
    return list(dict.fromkeys(out))


#: Languages whose edges are found by a function of (path, contents) instead of by expressions; a caller may add his own.
BY_TREE: dict[str, Callable[[str, str], list[tuple]]] = {"python": python_edges}


def all_edges(files: DataFrame, by_tree: dict[str, Callable[[str, str], list[tuple]]] | None = None) -> DataFrame:
    """EDGES of files (path, contents, language): by syntax tree where there is one and it finds some, else by expressions."""
    known = BY_TREE if by_tree is None else by_tree

    def run(batches):
        for batch in batches:
            rows = [e for path, contents, language in zip(batch["path"], batch["contents"], batch["language"], strict=True) for e in known[language](path, contents or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EDGES.split(", ")])

    parsed = files.where(F.col("language").isin(*known)).select("path", "contents", "language").mapInPandas(run, EDGES)
    rest = files.join(parsed.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti")
    return parsed.unionAll(source_edges(rest))
