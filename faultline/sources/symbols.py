"""Where classes and functions begin and end: Python by its own grammar, languages with braces by a lexical scan."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from . import parsers

_TOKEN = re.compile(r"//|/\*|[\"'`{}]|\n")
_CLASS = re.compile(r"\b(?:class|interface|object|enum)\s+([A-Za-z_$][\w$]*)")
_FUNCTION = {
    "typescript": [re.compile(parsers.TS_FUNCTION), re.compile(parsers.TS_METHOD)],
    "kotlin": [re.compile(r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?([A-Za-z_]\w*)\s*\(")],
    "java": [re.compile(r"(?m)^\s*(?:[\w@]+\s+)*[\w<>\[\],.?]+\s+([A-Za-z_]\w*)\s*\([^;{}]*\)\s*(?:throws[^{;]+)?\{")],
}
_TAG = re.compile(r"(?<=>)[^<>{}]*(?=</)")


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def blanked(text: str, jsx: bool = False) -> str:
    """text with its comments and the contents of its strings as blanks, so that places and lines stay. Templates may hold code
    between ${ and }, and that code templates again; with `jsx` the text of an element is blank, too.
    """
    out, i, depth, open_ = [], 0, 0, []

    def until(start: int, end: re.Pattern) -> int:
        m = end.search(text, start)
        return m.end() if m else len(text)

    def template(start: int) -> int:
        """Past the end of a template's text, or past the ${ that begins code in it."""
        m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(`|\$\{)?", re.S).match(text, start)
        if m[1] == "${":
            open_.append(depth)
        return m.end()

    while m := _TOKEN.search(text, i):
        out.append(text[i : m.start()])
        token, at = m[0], m.start()
        if token == "//":
            i = until(at, re.compile(r"(?=\n)"))
            out.append(_blank(text[at:i]))
        elif token == "/*":
            i = until(at + 2, re.compile(r"\*/"))
            out.append(_blank(text[at:i]))
        elif token in "\"'":
            i = until(at + 1, re.compile(rf"(?<!\\)(?:\\\\)*{token}|(?=\n)"))
            out.append(_blank(text[at:i]))
        elif token == "`" or token == "}" and open_ and open_[-1] == depth:
            if token == "}":
                open_.pop()
            i = template(at + 1)
            out.append(_blank(text[at:i]))
        else:
            depth += {"{": 1, "}": -1}.get(token, 0)
            out.append(token)
            i = at + 1
    code = "".join(out) + text[i:]
    return _TAG.sub(lambda m: _blank(m[0]), code) if jsx else code


def braced(text: str, language: str, jsx: bool = False) -> list[tuple[str, str, int, int]]:
    """(name, kind, start line, end line) of the classes and functions of a language with braces, in order. What has a body ends with
    it, other declarations where they begin.
    """
    code = blanked(text, jsx)
    closing, stack = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            closing[stack.pop()] = m.start()
    starts = [m.start() for m in re.finditer(r"\n", code)]
    from bisect import bisect_left

    line = lambda at: bisect_left(starts, at) + 1
    out = {}
    for kind, patterns in (("class", [_CLASS]), ("function", _FUNCTION[language])):
        for m in (m for p in patterns for m in p.finditer(code)):
            if kind == "function" and m[1] in (*parsers.KEYWORDS, "function", "return", "new", "else"):
                continue
            at = m.start(1)
            # a body begins before the next declaration ends or another line of code begins
            body = re.compile(r"[^{};=]*?(?:=>\s*)?\{").match(code, m.end() - (code[m.end() - 1] == "{"))
            end = closing.get(body.end() - 1, at) if body else at
            out[at] = (m[1], kind, line(at), line(max(end, at)))
    return [out[k] for k in sorted(out)]


def of_python(text: str) -> list[tuple[str, str, int, int]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "function", ast.AsyncFunctionDef: "function"}
    return sorted(((n.name, kinds[type(n)], n.lineno, n.end_lineno) for n in ast.walk(tree) if type(n) in kinds), key=lambda x: x[2:])


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text, language = row.pop("text") or "", row.pop("fl_language")
            found = of_python(text) if language == "python" else braced(text, language, row["path"].lower().endswith(("x", ".js")))
            out += [row | dict(zip(("name", "kind", "start_line", "end_line"), s)) for s in found]
        yield pa.RecordBatch.from_pylist(out, schema)


def symbols(files: DataFrame) -> DataFrame:
    """The columns of files (path, text and any others but text) with name, kind (class or function), start_line and end_line of
    every class and function; vendor and other files, null and broken texts have none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    d = files.withColumn("fl_language", parsers.language(files["path"])).where("fl_language IN ('python', 'typescript', 'kotlin', 'java')")
    own = files.drop("text").schema
    schema = StructType([*own.fields, *StructType.fromDDL("name string, kind string, start_line int, end_line int").fields])
    return d.mapInArrow(partial(_rows, schema=to_arrow_schema(schema)), schema)
