"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions import guards as G
from loanloom.functions import schema as S


def histogram(
    df: DataFrame,
    column: str,
    bins: int = 50,
    by: list[str] | None = None,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Counts and density of every bin; each group spans its own range.

    One pass finds the ranges, a second counts. The last bin includes its
    upper edge; a group with a single value gets a range of width 1 around it.
    """
    by = by or []
    values = df.select(*by, S.quoted(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    ends = values.groupBy(*by).agg(
        F.coalesce(F.lit(low).cast("double"), F.min("x")).alias("a"),
        F.coalesce(F.lit(high).cast("double"), F.max("x")).alias("b"),
        F.count("x").alias("n"),
    )
    flat = F.col("a") == F.col("b")
    ends = ends.select(
        *by,
        F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"),
        "n",
    ).withColumn("width", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    ends = ends.where(F.col("width").isNotNull())
    if by:
        # one row per group of a chart: classes or sides
        placed = values.join(F.broadcast(ends), by)
    else:
        span = ends.select(F.struct("lo", "hi", "width").alias("s")).scalar()
        placed = values.withColumn("s", span).select("x", "s.*")
    index = F.least(F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("width"))), F.lit(bins - 1))
    counted = (
        placed.where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
        .groupBy(*by, index.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    frame = ends.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    rows = F.coalesce(F.col("rows"), F.lit(0))
    return frame.join(counted, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        rows.alias("rows"),
        G.safe_div(rows, F.col("n") * F.col("width")).alias("density"),
    )
