"""Population profiles: missing values, distributions, correlations, ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.ordered import quantiles


def column_stats(
    df: DataFrame,
    columns: list[str],
    stats: dict[str, Callable[[Column], Column]],
    by: list[str] | None = None,
    cell: str = "CAST({0} AS DOUBLE)",
) -> DataFrame:
    """One row per (by, feature) with the given statistics of every column.

    Aggregating the long form keeps the generated code small whatever the
    number of columns; each task sends one partial row per feature and group.
    """
    long = S.to_long(df, columns, by, cell, drop_null=False)
    return long.groupBy(*(by or []), "feature").agg(
        *[build(F.col("value")).alias(name) for name, build in stats.items()]
    )


# --------------------------------------------------------------- missing values


def null_report(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows, missing values and their share for every column."""
    columns = columns or S.other_columns(df, by or [])
    rows = column_stats(
        df,
        columns,
        {"rows": lambda c: F.count(F.lit(1)), "missing": F.sum},
        by,
        cell="CAST({0} IS NULL AS BIGINT)",
    )
    return rows.withColumn("missing_pct", G.safe_div(F.col("missing"), F.col("rows")) * 100)


def columns_with_nulls(df: DataFrame, n: int | None = None) -> DataFrame:
    """Columns that have missing values, most affected first."""
    rows = null_report(df).where(F.col("missing") > 0)
    ordered = rows.orderBy(F.col("missing_pct").desc(), "feature")
    return ordered if n is None else ordered.limit(n)


def missing_share(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table."""
    cells = null_report(df).agg(F.sum("rows").alias("cells"), F.sum("missing").alias("missing"))
    return cells.withColumn("missing_pct", G.safe_div(F.col("missing"), F.col("cells")) * 100)


def null_ratios(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Share of missing values per column, as numbers on the driver (one row per column)."""
    found = {r["feature"]: r["missing_pct"] / 100 for r in null_report(df, columns).collect()}
    return {c: found.get(c, 0.0) for c in columns}


# ----------------------------------------------------------------- distributions


def class_distribution(df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """Rows and share of each class, and how many times the rarer class it is."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    whole = counts.agg(F.sum("rows").alias("n"), F.min("rows").alias("least"))
    return counts.select(
        label,
        "rows",
        (G.safe_div(F.col("rows"), whole.select("n").scalar()) * 100).alias("pct"),
        G.safe_div(F.col("rows"), whole.select("least").scalar()).alias("times_rarest"),
    )


def describe_numeric(
    df: DataFrame, columns: list[str], by: list[str] | None = None, method: str = "exact"
) -> DataFrame:
    """count, mean, std, min, quartiles and max of every column."""
    by = by or []
    stats = column_stats(
        df,
        columns,
        {
            "count": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": F.min,
            "max": F.max,
        },
        by,
    )
    quarts = quantiles(df, columns, [0.25, 0.5, 0.75], by, method)
    return stats.join(quarts, [*by, "feature"], "left").select(
        *by, "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def category_counts(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows per (feature, value) of text columns; NULLs are left out."""
    long = S.to_long(df, columns, by, S.AS_TEXT)
    return long.groupBy(*(by or []), "feature", "value").agg(F.count(F.lit(1)).alias("rows"))


def describe_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-missing rows, distinct values, the most frequent value and its rows."""
    counts = category_counts(df, columns)
    most = F.min_by(F.struct("value", "rows"), F.struct(-F.col("rows"), F.col("value")))
    return (
        counts.groupBy("feature")
        .agg(
            F.sum("rows").alias("count"), F.count(F.lit(1)).alias("unique"), most.alias("most")
        )
        .select(
            "feature",
            "count",
            "unique",
            F.col("most.value").alias("top"),
            F.col("most.rows").alias("freq"),
        )
    )


def describe_all(df: DataFrame, method: str = "exact") -> DataFrame:
    """Numeric and categorical description in one table, with missing counts."""
    numeric, text = S.numeric_columns(df), S.string_columns(df)
    left = describe_numeric(df, numeric, method=method).withColumns(
        {
            "unique": F.lit(None).cast("bigint"),
            "top": F.lit(None).cast("string"),
            "freq": F.lit(None).cast("bigint"),
        }
    )
    empty = {c: F.lit(None).cast("double") for c in ["mean", "std", "min", "q25", "q50", "q75", "max"]}
    right = describe_categories(df, text).withColumns(empty)
    missing = null_report(df, numeric + text).select("feature", "missing")
    return left.unionByName(right).join(missing, "feature")


def table_summary(df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """Rows, columns and class counts of a table."""
    y = F.col(label)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(y == 0).alias("target_0"),
        F.count_if(y == 1).alias("target_1"),
    ).withColumn("n_columns", F.lit(len(df.columns)).cast("bigint"))


def type_counts(df: DataFrame) -> DataFrame:
    """Rows of the table and how many columns each type has."""
    types: dict[str, int] = {}
    for field in df.schema.fields:
        name = field.dataType.simpleString()
        types[name] = types.get(name, 0) + 1
    cells = F.array(
        *[
            F.struct(F.lit(t).alias("type"), F.lit(n).cast("bigint").alias("columns"))
            for t, n in sorted(types.items())
        ]
    )
    whole = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return whole.select("n_rows", F.explode(cells).alias("c")).select("n_rows", "c.*")


def distinct_categories(
    df: DataFrame, columns: list[str], approximate: bool = False
) -> DataFrame:
    """Distinct values per text column."""
    if approximate:
        return column_stats(df, columns, {"categories": F.approx_count_distinct}, cell=S.AS_TEXT)
    return category_counts(df, columns).groupBy("feature").agg(
        F.count(F.lit(1)).alias("categories")
    )


def default_rate_by(df: DataFrame, columns: list[str], label: str = K.TARGET) -> DataFrame:
    """Default rate and labelled rows of every category of the columns."""
    long = S.to_long(df, columns, [label], S.AS_TEXT)
    return long.groupBy("feature", "value").agg(
        F.avg(label).alias("default_rate"), F.count(label).alias("rows")
    )


def top_categories(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values; ties in value order."""
    counts = df.where(S.quoted(column).isNotNull()).groupBy(S.quoted(column).cast("string").alias("value"))
    return counts.agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "value").limit(k)


# -------------------------------------------------------------------- correlation


def correlation(x: Column, y: Column) -> Column:
    """Pearson over rows that have both values; NULL for a constant column."""
    x, y = G.dbl(x), G.dbl(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def target_correlations(
    df: DataFrame, columns: list[str], label: str = K.TARGET, by: list[str] | None = None
) -> DataFrame:
    """Correlation of every column with the label, in one pass."""
    by = by or []
    long = S.to_long(df, columns, [*by, label], drop_null=False)
    return long.groupBy(*by, "feature").agg(
        correlation(F.col("value"), F.col(label)).alias("correlation")
    )


_MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def _pair_moments(columns: int, means: np.ndarray):
    """Task: sums over its rows for every pair of columns, each over the rows that have both values.

    Four products of matrices a batch, whatever the number of pairs.
    """
    left, right = np.triu_indices(columns, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = (np.zeros((columns, columns)) for _ in range(4))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, columns) - means
            known = ~np.isnan(x)
            x, there = np.where(known, x, 0.0), known.astype(float)
            n += there.T @ there
            sx += x.T @ there
            sxx += (x * x).T @ there
            sxy += x.T @ x
        sums = (n, sx, sx.T, sxx, sxx.T, sxy)
        cells = [pa.array(left), pa.array(right), *(pa.array(m[left, right]) for m in sums)]
        yield pa.RecordBatch.from_arrays(cells, names=["l", "r", *_MOMENTS])

    return run


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlations (upper triangle) over the rows that have both values.

    One scan for the means, one for the moments around them, for any number of columns: a task
    sums products of column blocks and gives one row per pair, which Spark adds up. NULL for a pair of which
    one column is constant where both are known.
    """
    found = {r["feature"]: r["mean"] for r in column_stats(df, columns, {"mean": F.avg}).collect()}  # one row per column
    means = np.array([found.get(c) or 0.0 for c in columns])
    rows = df.select(F.array(*[S.quoted(c).cast("double") for c in columns]).alias("x"))
    schema = "l long, r long, " + ", ".join(f"{m} double" for m in _MOMENTS)
    parts = rows.mapInArrow(_pair_moments(len(columns), means), schema)
    sums = parts.groupBy("l", "r").agg(*[F.sum(m).alias(m) for m in _MOMENTS])

    def spread(square: str, total: str) -> Column:
        rest = F.col(square) - F.try_divide(F.col(total) * F.col(total), F.col("n"))
        # what rounding leaves of a constant column
        return F.when(rest > F.col(square) * 1e-13, rest)

    shared = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    value = shared / F.sqrt(spread("sxx", "sx") * spread("syy", "sy"))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.get(names, F.col("l").cast("int")).alias("left"),
        F.get(names, F.col("r").cast("int")).alias("right"),
        value.alias("correlation"),
    )


def strongest_correlations(correlations: DataFrame, n: int = 15) -> DataFrame:
    """The n lowest and the n highest correlations, one below the other.

    Correlations that agree to nine digits count as tied and go by name.
    """
    known = correlations.where(F.col("correlation").isNotNull())
    size = F.round("correlation", 9)
    head = known.orderBy(size, "feature").limit(n).withColumn("end", F.lit("head"))
    tail = known.orderBy(size.desc(), "feature").limit(n).withColumn("end", F.lit("tail"))
    return head.unionByName(tail)


# ------------------------------------------------------------------- ranges, kinds


def numeric_ranges(df: DataFrame, columns: list[str], method: str = "exact") -> DataFrame:
    """min, max, 5 % and 95 % quantile, and whether all values are whole numbers."""
    stats = column_stats(
        df,
        columns,
        {
            "min": F.min,
            "max": F.max,
            "is_int": lambda c: F.bool_and(c == F.floor(c)),
        },
    )
    ends = quantiles(df, columns, [0.05, 0.95], method=method)
    return stats.join(ends, "feature").select(
        "feature", "min", "max", F.col("q5").alias("p5"), F.col("q95").alias("p95"), "is_int"
    )


def reference_stats(df: DataFrame, method: str = "exact") -> DataFrame:
    """Typical values: median of numeric columns, most frequent value of the others."""
    numeric = S.numeric_columns(df)
    medians = quantiles(df, numeric, [0.5], method=method).select(
        "feature", F.col("q50").alias("median"), F.lit(None).cast("string").alias("mode")
    )
    modes = describe_categories(df, S.string_columns(df)).select(
        "feature", F.lit(None).cast("double").alias("median"), F.col("top").alias("mode")
    )
    return medians.unionByName(modes)


def dataset_kpis(df: DataFrame, label: str = K.TARGET, method: str = "exact") -> DataFrame:
    """Headline figures of the population, one row."""
    columns = df.columns
    medians = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", *K.EXTERNAL_SCORES]
    medians = [c for c in medians if c in columns]
    cells = G.total([F.count_if(S.quoted(c).isNull()) for c in columns])
    head = df.agg(
        F.count(F.lit(1)).alias("clients"),
        F.avg(label).alias("default_rate"),
        cells.alias("missing"),
    )
    points = quantiles(df, medians, [0.5], method=method)
    typical = points.agg(
        *[F.max(F.when(F.col("feature") == c, F.col("q50"))).alias(f"median_{c}") for c in medians]
    )
    n_numeric = len(S.numeric_columns(df))
    return head.select(
        "clients",
        "default_rate",
        F.lit(len(columns)).cast("bigint").alias("columns"),
        F.lit(n_numeric).cast("bigint").alias("numeric_columns"),
        F.lit(len(columns) - n_numeric).cast("bigint").alias("categorical_columns"),
        (G.safe_div(F.col("missing"), F.col("clients") * len(columns)) * 100).alias("missing_pct"),
        *[typical.select(f"median_{c}").scalar().alias(f"median_{c}") for c in medians],
    )


def column_kinds(ranges: DataFrame) -> DataFrame:
    """Which numeric columns are yes/no flags and which have a small bounded range."""
    name = F.upper("feature")
    whole = F.col("is_int")
    low, high = F.col("min"), F.col("max")
    ratio_named = name.rlike(K.RATIO_NAME_PATTERN)
    return ranges.select(
        "feature",
        (name.startswith("FLAG_") | (whole & (low >= 0) & (high <= 1))).alias("is_boolean"),
        (
            ((low >= 0) & (high <= 1))
            | (ratio_named & (low >= 0) & (high <= 100))
            | (whole & (low >= 0) & (high <= 5))
        ).alias("is_bounded"),
    )
