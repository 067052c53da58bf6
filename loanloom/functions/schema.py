"""Column-list helpers resolved once on the driver from a schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns in schema order."""
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in exclude
    ]


def other_columns(df: DataFrame, listed: list[str]) -> list[str]:
    """Complement of a column list, in schema order."""
    known = set(listed)
    return [c for c in df.columns if c not in known]


def first_numeric(df: DataFrame, n: int, exclude: tuple[str, ...]) -> list[str]:
    """The first n numeric columns that are not keys."""
    return numeric_columns(df, exclude)[:n]


def with_prefix(columns: list[str], prefixes: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(tuple(prefixes))]


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Columns of ``after`` that ``before`` does not have."""
    return other_columns(after, before.columns)


def prefix_counts(columns: list[str], prefixes: list[str]) -> dict[str, int]:
    return {p: len(with_prefix(columns, [p])) for p in prefixes}


def integer_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)}


def plain_name(name: str) -> str:
    """Column name with brackets, separators and spaces replaced by ``_``."""
    return re.sub(r"[\[\]()<>,:/ ]", "_", name)


def clean_names(df: DataFrame) -> DataFrame:
    """Replace special characters in column names; refuses ambiguous results."""
    names = [plain_name(c) for c in df.columns]
    lowered = [n.lower() for n in names]
    clashes = sorted({n for n in lowered if lowered.count(n) > 1})
    if clashes:
        raise ValueError(f"column names collide after cleaning: {clashes}")
    return df.toDF(*names)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def to_long(
    df: DataFrame,
    columns: list[str],
    keep: list[str] | None = None,
    cell: str = "CAST({0} AS DOUBLE)",
    drop_null: bool = True,
) -> DataFrame:
    """One row per (input row, column): ``keep..., feature, value``.

    ``cell`` is the SQL text of a value, with ``{0}`` for the column; all cells
    need one type. An aggregation by feature straight after this runs inside
    the scanning tasks, so the multiplied rows are never shuffled.
    """
    kept = [f"`{k}`" for k in keep or []]
    cells = df.selectExpr(*kept, *[f"{cell.format(f'`{c}`')} AS `{c}`" for c in columns])
    long = cells.unpivot(kept, [f"`{c}`" for c in columns], "feature", "value")
    return long.where("value IS NOT NULL") if drop_null else long


AS_TEXT = "CAST({0} AS STRING)"
