"""Column names for values that an operator needs on its way."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(name: str, *tables: DataFrame) -> str:
    """`name`, longer where one of the tables has a column of that name in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
