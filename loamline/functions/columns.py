"""Helpers for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row: inside other lambdas a plain reference may be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
