"""Column expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where lambdas inside body use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unused(columns: list[str], name: str) -> str:
    """A column name that is not among the columns."""
    taken = {c.lower() for c in columns}
    while f"_{name}".lower() in taken:
        name = f"_{name}"
    return f"_{name}"
