"""A read-only front for SQL texts over temporary views.

A text is parsed first, and every logical node of what the parser makes of it must be a query's; commands, writes and
reads of files by path are refused before anything runs. The whole text is refused if a part of it is.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from itertools import islice

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

#: Exit codes by what went wrong.
EXIT_REFUSED, EXIT_SYNTAX, EXIT_BINDING, EXIT_RUNTIME = 2, 3, 4, 5
CELL = 120


class Refused(Exception):
    code = EXIT_REFUSED


def gate(spark: SparkSession, text: str) -> None:
    """Raise unless ``text`` is one query over named relations."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        if "ParseException" in type(e).__name__ or "PARSE" in str(e):
            raise
        raise Refused(str(e)) from e
    stack = [plan]
    while stack:
        node = stack.pop()
        name = node.nodeName().strip("'")
        if any(c.getName().endswith((".Command", ".ParsedStatement")) for c in _ancestors(node)):
            raise Refused(f"{name} is not a query")
        if name == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
            raise Refused("only the catalog's views can be read")
        if name == "UnresolvedTableValuedFunction":
            _check_function(spark, node.name())
        expressions = [node.expressions().apply(i) for i in range(node.expressions().size())]
        while expressions:
            e = expressions.pop()
            if e.getClass().getSimpleName() == "UnresolvedFunction":
                _check_function(spark, e.nameParts())
            expressions += [e.children().apply(i) for i in range(e.children().size())]
        for children in (node.children(), node.innerChildren()):
            for i in range(children.size()):
                child = children.apply(i)
                if hasattr(child, "nodeName"):
                    stack.append(child)


#: Functions that call into the JVM or tell of the machine.
DENIED = {"reflect", "try_reflect", "java_method", "input_file_name", "input_file_block_start", "input_file_block_length", "current_catalog", "session_user", "current_user", "user", "version"}


def _check_function(spark: SparkSession, parts) -> None:
    """Only functions that are built in or that this session has registered, by a plain name, and none that is denied."""
    name = ".".join(parts.apply(i) for i in range(parts.size())).lower()
    if parts.size() > 1 or name in DENIED:
        raise Refused(f"the function {name} is not allowed")
    registry = spark._jsparkSession.sessionState().functionRegistry()
    tables = spark._jsparkSession.sessionState().tableFunctionRegistry()
    identifier = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name)
    if not (registry.functionExists(identifier) or tables.functionExists(identifier)):
        raise Refused(f"the function {name} is not known")


_QUOTED = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)


def _ancestors(node) -> Iterator:
    todo = [node.getClass()]
    while todo:
        c = todo.pop()
        if c is None:
            continue
        yield c
        todo.append(c.getSuperclass())
        todo.extend(c.getInterfaces())


def run(spark: SparkSession, text: str) -> DataFrame:
    """The query's result. Nothing of the session is changed."""
    text = text.strip().rstrip(";")
    if ";" in _QUOTED.sub(" ", text):
        raise Refused("one statement at a time")
    gate(spark, text)
    return spark.sql(text)


def exit_code(error: Exception) -> int:
    if isinstance(error, Refused):
        return error.code
    if isinstance(error, ParseException):
        return EXIT_SYNTAX
    return EXIT_BINDING if isinstance(error, AnalysisException) else EXIT_RUNTIME


def names(columns: list[str]) -> list[str]:
    """Repeated names get _1, _2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for c in columns:
        k = seen.get(c, 0)
        seen[c] = k + 1
        out.append(f"{c}_{k}" if k else c)
    return out


def emit(df: DataFrame, form: str = "json", batch: int = 10_000) -> Iterator[str]:
    """Pieces of text of a result, read a batch at a time, so that the driver never holds the whole of it."""
    rows, columns = df.toLocalIterator(prefetchPartitions=True), names(df.columns)
    if form == "json":
        yield "["
        first = True
        while part := list(islice(rows, batch)):
            yield ("" if first else ",") + ",".join(json.dumps(dict(zip(columns, r, strict=True)), default=str, ensure_ascii=False) for r in part)
            first = False
        yield "]\n"
    elif form == "csv":
        out = io.StringIO()
        csv.writer(out).writerow(columns)
        while part := list(islice(rows, batch)):
            csv.writer(out).writerows(part)
            yield out.getvalue()
            out.seek(0)
            out.truncate()
        yield out.getvalue()
    else:
        cut = lambda v: (s if len(s := str(v)) <= CELL else s[: CELL - 1] + "…")
        yield " | ".join(columns) + "\n"
        while part := list(islice(rows, batch)):
            yield "".join(" | ".join(map(cut, r)) + "\n" for r in part)
