"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    An expression used in several places is otherwise copied into each of them, and into
    every step of a lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
