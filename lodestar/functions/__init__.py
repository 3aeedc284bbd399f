"""Scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once and standing once in the expression, however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)
