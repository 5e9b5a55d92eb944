"""Scalar functions over columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body uses it.

    Inside the lambdas of higher-order functions Spark does not share common subexpressions.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
