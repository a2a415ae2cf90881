"""Helpers for higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` to a name inside one expression, so that it is computed once per row.

    A column used inside a lambda may be inlined by the optimizer and then run once per element;
    a lambda variable cannot.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def first_n(col: Column, n: int) -> Column:
    return F.slice(col, 1, n)


def add_distinct(col: Column, item: Column) -> Column:
    """Append `item` unless the list already holds it."""
    return F.array_union(col, F.array(item))
