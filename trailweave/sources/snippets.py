"""Functions and classes out of source files. Python is parsed; other languages are cut by their braces, which is an
approximation of a grammar."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LINES, MOST_LINES = 5, 10_000
#: Languages by the endings of their files: fixed values.
LANGUAGES = {"typescript": (".ts", ".tsx"), "javascript": (".js", ".jsx", ".mjs"), "python": (".py",), "rust": (".rs",), "swift": (".swift",)}
#: How definitions begin, for languages with braces: kind and pattern, the name its group.
_BEGINS = [
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:public\s+|final\s+)*class\s+(\w+)"),
    ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+|public\s+)*struct\s+(\w+)"),
    ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)*(?:unsafe\s+)?trait\s+(\w+)"),
    ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+|public\s+|export\s+|const\s+)*enum\s+(\w+)"),
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+|public\s+|private\s+|static\s+|async\s+|const\s+|unsafe\s+)*(?:function\*?|fn|func)\s+(\w+)"),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>\s*\{"),
    ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b)(\w+)\s*\([^;]*\)\s*(?::[^{]+)?\{\s*$"),
]
_BEGINS = [(kind, re.compile(p)) for kind, p in _BEGINS]


def language_of(path: str) -> str | None:
    return next((name for name, ends in LANGUAGES.items() if path.endswith(ends)), None)


def _of_python(text: str) -> Iterator[tuple[str, str, int, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    todo: list[tuple[ast.AST, bool]] = [(tree, False)]
    while todo:
        node, in_class = todo.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield child.name, "method" if in_class else "function", child.lineno, child.end_lineno
            elif isinstance(child, ast.ClassDef):
                yield child.name, "class", child.lineno, child.end_lineno
            todo.append((child, isinstance(child, ast.ClassDef)))


def _of_braces(lines: list[str]) -> Iterator[tuple[str, str, int, int]]:
    depth, open_ = 0, []
    for number, line in enumerate(lines, 1):
        found = next(((kind, m[1]) for kind, p in _BEGINS if (m := p.match(line))), None)
        if found:
            open_.append((found[1], found[0], number, depth, False))
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", line)
        depth += bare.count("{") - bare.count("}")
        open_ = [(n, k, s, d, begun or depth > d or "{" in bare) for n, k, s, d, begun in open_]
        while open_ and open_[-1][4] and depth <= open_[-1][3]:
            name, kind, start, *_ = open_.pop()
            yield name, kind, start, number


def snippets_of(path: str, text: str | None) -> list[tuple[str, str, int, int, str]]:
    """(name, kind, first line, last line, source) of the definitions of a file, of five lines at least."""
    language, lines = language_of(path), (text or "").split("\n")
    if language is None or len(lines) > MOST_LINES:
        return []
    found = _of_python(text or "") if language == "python" else _of_braces(lines)
    return sorted(((n, k, a, b, "\n".join(lines[a - 1 : b])) for n, k, a, b in found if b - a + 1 >= LEAST_LINES), key=lambda s: (s[2], -s[3]))


def extract(files: DataFrame) -> DataFrame:
    """schema.SNIPPETS of files (file, text). Ids and hashes are JVM-side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(file, *s) for file, text in zip(batch["file"], batch["text"], strict=True) for s in snippets_of(file, text)]
            yield pd.DataFrame(rows, columns=["file", "name", "kind", "start_line", "end_line", "source"])

    raw = files.select("file", "text").mapInPandas(run, "file string, name string, kind string, start_line int, end_line int, source string")
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    parent = F.concat(F.lit("file:"), "file")
    return raw.select(F.concat(F.lit("snip:"), short(F.concat_ws(":", parent, "start_line", "end_line"))).alias("id"), parent.alias("parent"), "name", "kind", "start_line", "end_line", "source", short(F.col("source")).alias("content_hash"))


def upserted(known: DataFrame, new: DataFrame) -> DataFrame:
    """known with all snippets of the parents in new replaced by new's."""
    return known.join(new.select("parent").distinct(), "parent", "left_anti").select(*known.columns).unionByName(new.select(*known.columns))
