"""Working with many columns by name."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What becomes of the punctuation in a column name; other marks are dropped.
NAME_MARKS = {" ": "_", "-": "_", "/": "_", "&": "and"}


def tidy_name(name: str) -> str:
    return re.sub(r"\W", "", name.translate(str.maketrans(NAME_MARKS)))


def with_tidy_names(df: DataFrame) -> DataFrame:
    names = [tidy_name(c) for c in df.columns]
    clashes = [n for n, times in Counter(n.lower() for n in names).items() if times > 1]
    if clashes:
        raise ValueError(f"columns fall together after tidying: {clashes}")
    return df.toDF(*names)


def with_lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def in_name_order(df: DataFrame) -> DataFrame:
    return df.select(sorted(df.columns))


def without_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.select([c for c in df.columns if not c.endswith(suffix)])


def column_chunks(df: DataFrame, about: int = 3) -> list[list[str]]:
    """The column names in order, cut into near-equal groups; the longer ones come first."""
    names = df.columns
    groups = max(1, len(names) // about)
    size, longer = divmod(len(names), groups)
    cuts = [i * size + min(i, longer) for i in range(groups + 1)]
    return [names[a:b] for a, b in zip(cuts, cuts[1:])]


def cast_by_prefix(df: DataFrame, prefix: str, to: str) -> DataFrame:
    """Cast every column with the prefix; what does not parse becomes null."""
    return df.select([F.col(c).try_cast(to).alias(c) if c.startswith(prefix) else F.col(c) for c in df.columns])


def common_columns(frames: Sequence[DataFrame], required: Sequence[str] = ()) -> list[str]:
    shared = sorted(set.intersection(*[set(f.columns) for f in frames]))
    missing = set(required) - set(shared)
    if missing:
        raise ValueError(f"not in every frame: {sorted(missing)}")
    return shared


def union_common(frames: Sequence[DataFrame], required: Sequence[str] = ()) -> DataFrame:
    """Positional union over the shared columns, in sorted order so that it is the same each run."""
    shared = common_columns(frames, required)
    first, *rest = [f.select(shared) for f in frames]
    for other in rest:
        first = first.union(other)
    return first


def flat_fields(schema: T.StructType, prefix: str = "") -> list[tuple[str, str, bool]]:
    """(path, type, nullable) of every field, going through structs and arrays."""
    rows = []
    for field in schema.fields:
        path = prefix + field.name
        rows.append((path, field.dataType.simpleString(), field.nullable))
        inner = field.dataType
        while isinstance(inner, T.ArrayType):
            inner = inner.elementType
        if isinstance(inner, T.StructType):
            rows += flat_fields(inner, path + ".")
    return rows


def columns_as_rows(one_row: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """Turn the columns of a one-row aggregate into rows."""
    return one_row.unpivot([], one_row.columns, name, value)


def filled_counts(df: DataFrame) -> DataFrame:
    """(name, type, nullable, filled) per top-level column, counted in one pass."""
    counts = columns_as_rows(df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]), "name", "filled")
    kinds = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields],
        "name string, type string, nullable boolean",
    )
    return counts.join(F.broadcast(kinds), "name")
