"""JSON text in columns: it stays text in source order, and parts of it are taken out by path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_at(column: Column | str, path: str) -> Column:
    return F.get_json_object(column, path)


def elements(column: Column | str, path: str) -> Column:
    """The elements of an array as JSON texts; null if there is no array."""
    return F.from_json(F.get_json_object(column, path), "array<string>")
