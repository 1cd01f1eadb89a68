"""A name for a value within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body uses it: interpreted higher-order functions
    don't share what an expression repeats."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
