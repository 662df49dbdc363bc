"""Column naming helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df_or_columns: DataFrame | Iterable[str], base: str) -> str:
    """A column name that does not clash (case-insensitively) with those given."""
    columns = df_or_columns.columns if isinstance(df_or_columns, DataFrame) else list(df_or_columns)
    taken = {c.lower() for c in columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def ref(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, each computed exactly once per row.

    A plain projection may be merged into the ones above it, which repeats a
    long expression wherever it is used; a generator of one row is a boundary
    the optimizer does not merge across.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
