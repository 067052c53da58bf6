"""Null- and zero-safe column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(value) -> Column:
    """A column (or number) as double."""
    col = value if isinstance(value, Column) else F.lit(value)
    return col.cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / (den + 1); NULL instead of a division by zero."""
    return F.try_divide(dbl(num), dbl(den) + F.lit(1.0))


def safe_div(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0."""
    return F.try_divide(dbl(num), dbl(den))


def flag(condition: Column) -> Column:
    """0/1 indicator in which an unknown comparison counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), F.lit(None)).otherwise(col)


def total(cols: Iterable[Column]) -> Column:
    return reduce(add, cols)


def row_sum(cols: list[Column]) -> Column:
    """Sum across columns that skips NULLs; 0 when all are NULL."""
    return total([F.coalesce(c, F.lit(0)) for c in cols])


def row_count(cols: list[Column]) -> Column:
    """How many of the columns are not NULL."""
    return total([c.isNotNull().cast("int") for c in cols])


def row_mean(cols: list[Column]) -> Column:
    """Mean of the available values; NULL when there is none."""
    return F.try_divide(row_sum([dbl(c) for c in cols]), row_count(cols).cast("double"))


def row_std(cols: list[Column]) -> Column:
    """Sample deviation of the available values; NULL below two values."""
    mean, n = row_mean(cols), row_count(cols)
    squares = [F.coalesce((dbl(c) - mean) * (dbl(c) - mean), F.lit(0.0)) for c in cols]
    return F.when(n >= 2, F.sqrt(F.try_divide(total(squares), (n - 1).cast("double"))))


def row_min(cols: list[Column]) -> Column:
    return F.least(*cols) if len(cols) > 1 else cols[0]


def row_max(cols: list[Column]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else cols[0]


def round_even_long(col: Column) -> Column:
    """Nearest integer, halves to the even neighbour."""
    return F.bround(finite(dbl(col)), 0).cast("long")


# Rounding for comparison across engines: means of prices fall exactly half-way
# between two rounded values, where the last bit of a sum would decide. The
# shift moves every such case to one side.
HALF_SHIFT = 1e-8


def rounded(df, digits: int = 6):
    """Round every double column; used where results are compared across engines."""
    return df.selectExpr(
        *[
            f"round(`{f.name}` + {HALF_SHIFT!r}D, {digits}) AS `{f.name}`"
            if f.dataType.typeName() in ("double", "float")
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def double_array(values: Iterable[float]) -> Column:
    """Array literal of doubles, built in one call."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")
