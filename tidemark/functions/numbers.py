"""Arithmetic with the null rules the jobs rely on."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (zero point, size of one degree in degrees Celsius) of each temperature scale.
SCALES = {"C": (0.0, 1.0), "F": (32.0, 5 / 9), "K": (273.15, 1.0), "R": (491.67, 5 / 9)}


def convert_temperature(column: Column, source: str, target: str) -> Column:
    """Between Celsius, Fahrenheit, Kelvin and Rankine; scale names in either case."""
    source, target = source.upper(), target.upper()
    unknown = {source, target} - SCALES.keys()
    if unknown:
        raise ValueError(f"unknown temperature scale: {sorted(unknown)}")
    if source == target:
        return column
    (zero_in, step_in), (zero_out, step_out) = SCALES[source], SCALES[target]
    return (column - zero_in) * (step_in / step_out) + zero_out


def ratio(part: Column, whole: Column) -> Column:
    """Null when the whole is zero or null, instead of an error."""
    return F.try_divide(part, whole)


def capped(column: Column, bound) -> Column:
    """At most the bound; null stays null (plain least would return the bound)."""
    return F.when(column.isNotNull(), F.least(column, F.lit(bound)))


def clipped(column: Column, floor, cap) -> Column:
    return F.when(column > cap, F.lit(cap)).when(column < floor, F.lit(floor)).otherwise(column)


def gibibytes(column: Column) -> Column:
    return column / F.pow(F.lit(1024), 3)


def coded(column: Column, codes: dict) -> Column:
    """The code of a value by dictionary, null for an unknown value."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])
    return F.try_element_at(literal, column)


def range_scaled(column: Column, low: Column, high: Column) -> Column:
    """(x - low) / (high - low), and 0.5 where the range is empty."""
    return F.when(low == high, F.lit(0.5)).otherwise(F.try_divide(column - low, high - low))
