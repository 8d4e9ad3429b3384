"""Bind an expression to a name inside one Column expression.

A Column used twice is a tree copied twice; chains of labels would grow
exponentially. A one-element ``transform`` evaluates the value once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)
