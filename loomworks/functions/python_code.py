"""What needs Python's own grammar (FLT13, FN18, FN19), as Arrow UDFs: a batch is parsed once for both results."""

from __future__ import annotations

import ast
from itertools import dropwhile, takewhile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

_BAD = (SyntaxError, ValueError, RecursionError, MemoryError)


def parses(code: str | None) -> bool:
    try:
        ast.parse(code or "")
    except _BAD:
        return False
    return True


def signature_and_body(code: str | None) -> tuple[str | None, str | None]:
    """Of the first function that a breadth-first walk meets; (None, None) if there is none or the code does not parse."""
    try:
        found = next((n for n in ast.walk(ast.parse(code or "")) if isinstance(n, ast.FunctionDef)), None)
    except _BAD:
        return None, None
    if found is None:
        return None, None
    rows = code.split("\n")
    return _signature(rows, found.name), _body(rows, found)


def _signature(rows: list[str], name: str) -> str | None:
    """From the first line that opens a definition and has the name in it, through the first that ends in a colon (or all).

    So the name of a longer function may match first, and a comment behind the colon takes the lines that follow along.
    """
    found = list(dropwhile(lambda row: not (row.lstrip().startswith("def ") and name in row), rows))
    colons = (i for i, row in enumerate(found, 1) if row.rstrip().endswith(":"))
    return "\n".join(found[: next(colons, len(found))]).strip() if found else None


def _body(rows: list[str], found: ast.FunctionDef) -> str | None:
    """What is indented behind the docstring, or behind the `def` line: the tree tells where either ends.

    So parameters on lines of their own count as body where there is no docstring, and a body on the `def` line as none.  The
    first line's indent is cut off every line that is as long; blank lines are emptied.
    """
    begin = found.body[0].end_lineno if ast.get_docstring(found, clean=False) is not None else found.lineno
    block = takewhile(lambda row: not row or row[0].isspace(), rows[begin:])
    lines = list(dropwhile(lambda row: not row.strip(), block))
    if not lines:
        return None
    margin = len(lines[0]) - len(lines[0].lstrip())
    return "\n".join(row[margin if len(row) >= margin else 0 :] if row.strip() else "" for row in lines).rstrip()


@F.arrow_udf(BooleanType())
def syntax_valid(code: pa.Array) -> pa.Array:
    """FLT13: the code parses."""
    return pa.array([parses(x) for x in code.to_pylist()], pa.bool_())


@F.arrow_udf(StructType([StructField("signature", StringType()), StructField("body", StringType())]))
def split_function(code: pa.Array) -> pa.Array:
    """FN18 and FN19: signature and body."""
    rows = [signature_and_body(x) for x in code.to_pylist()]
    kind = pa.struct([("signature", pa.string()), ("body", pa.string())])
    return pa.array([{"signature": s, "body": b} for s, b in rows], kind)
