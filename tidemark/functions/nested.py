"""Arrays, maps and structs, with nulls where an element or key is missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_item(items: Column) -> Column:
    return F.get(items, F.lit(0))


def last_item(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))

