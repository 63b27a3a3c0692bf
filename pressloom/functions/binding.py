"""Values bound to a name within one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value used many times in one expression, so that the plan holds and computes it once."""
    return F.transform(F.array(value), body)[0]
