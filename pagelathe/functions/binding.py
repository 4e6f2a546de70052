"""Binding an expression to a name inside a row, so that it is evaluated once.

A lambda of a higher-order function evaluates whatever it refers to for each element, and projections
are collapsed into it. A bound value is a variable there, which costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
