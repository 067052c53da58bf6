"""Drift of features while a stream runs: histograms per window against a stored reference.

State is one row of counters per open window and feature; the watermark closes and drops it. Tasks count
before anything is shuffled, so a busy feature or window sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.ordered import add_bucket, quantiles

BINS = 10
PSI_LIMIT = 0.2


def _counters(bins: int) -> list[Column]:
    known = F.col("value").isNotNull()
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~known).alias("missing"),
        *[F.count_if(known & (F.col("bucket") == i)).alias(f"in{i}") for i in range(bins)],
    ]


def _shares(bins: int) -> Column:
    """Share per bin, half a row added to each so that none is 0."""
    known = F.col("rows") - F.col("missing")
    cells = [(F.col(f"in{i}") + 0.5) / (known + 0.5 * bins) for i in range(bins)]
    return F.when(known > 0, F.array(*cells))


def _binned(df: DataFrame, bounds: DataFrame, bins: int) -> DataFrame:
    # one row per feature
    return add_bucket(df.join(F.broadcast(bounds), "feature"), "value", "bounds", bins)


def reference_profile(reference: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """One row per feature: equi-depth bounds, share per bin, share of missing values.

    A feature without values has neither bounds nor shares. Write it once; monitors read it.
    """
    cuts = quantiles(reference, features, [i / bins for i in range(1, bins)])
    bounds = cuts.select("feature", F.array(*cuts.columns[1:]).alias("bounds"))
    every = reference.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    bounds = every.join(bounds, "feature", "left")
    long = S.to_long(reference, features, drop_null=False)
    counts = _binned(long, bounds, bins).groupBy("feature").agg(*_counters(bins))
    return bounds.join(counts, "feature", "left").select(
        "feature",
        "bounds",
        _shares(bins).alias("shares"),
        G.safe_div(F.col("missing"), F.col("rows")).alias("null_rate"),
    )


def feature_drift(
    df: DataFrame,
    profile: DataFrame,
    features: list[str],
    event_time: str = "ts",
    window: str = "1 day",
    delay: str | None = None,
    bins: int = BINS,
    psi_limit: float = PSI_LIMIT,
    null_tolerance: float = 0.1,
) -> DataFrame:
    """Per window and feature: rows, missing share now and in the reference, stability index and alert.

    With ``delay`` the rows may be a stream: a window is emitted once the watermark has closed it, and rows
    that come later are left out. The index is the sum of (p - q) ln(p / q) over the bins; it is NULL where one side
    has no value. An alert is an index above ``psi_limit`` or a missing share that moved by more than
    ``null_tolerance``. Rows without a time belong to no window.
    """
    long = S.to_long(df, features, [event_time], drop_null=False)
    if delay is not None:
        long = long.withWatermark(event_time, delay)
    binned = _binned(long, profile.select("feature", "bounds"), bins)
    counts = binned.groupBy(F.window(event_time, window).alias("w"), "feature").agg(*_counters(bins))
    now = counts.select(
        F.col("w.start").alias("window_start"),
        "feature",
        "rows",
        G.safe_div(F.col("missing"), F.col("rows")).alias("null_rate"),
        _shares(bins).alias("now"),
    )
    before = profile.select("feature", F.col("null_rate").alias("reference_null_rate"), "shares")
    term = F.zip_with("now", "shares", lambda p, q: (p - q) * F.log(p / q))
    psi = F.aggregate(term, F.lit(0.0), lambda a, t: a + t)
    # one row per feature
    rows = now.join(F.broadcast(before), "feature").withColumn("psi", psi)
    moved = F.abs(F.col("null_rate") - F.col("reference_null_rate")) > null_tolerance
    alert = F.coalesce(F.col("psi") > psi_limit, F.lit(False)) | F.coalesce(moved, F.lit(False))
    return rows.select(
        "window_start", "feature", "rows", "null_rate", "reference_null_rate", "psi", alert.alias("alert")
    )
