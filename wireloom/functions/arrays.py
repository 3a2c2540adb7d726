"""Helpers for array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A length that takes all of an array (the greatest integer would overflow).
ALL = 1 << 30


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where it stands inside other lambdas."""
    return F.transform(F.array(value), body)[0]
