"""Reference against current population: distributions, missing values, tests, alerts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.histogram import histogram
from loanloom.operators.ordered import running_totals
from loanloom.operators.profile import describe_numeric, null_report, target_correlations

REFERENCE, CURRENT = "reference", "current"


def pair(reference: DataFrame, current: DataFrame) -> DataFrame:
    """Both populations below each other with a ``side`` column; common columns only."""
    have = set(current.columns)
    common = [c for c in reference.columns if c in have]
    left = reference.select(*[S.quoted(c) for c in common]).withColumn("side", F.lit(REFERENCE))
    right = current.select(*[S.quoted(c) for c in common]).withColumn("side", F.lit(CURRENT))
    return left.unionByName(right)


def _side(value: str) -> Column:
    return F.col("side") == value


def distribution_comparison(both: DataFrame, columns: list[str], method: str = "exact") -> DataFrame:
    """Description of every column, per side."""
    return describe_numeric(both, columns, ["side"], method)


def histogram_comparison(both: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Histograms of both sides."""
    return histogram(both, column, bins, ["side"])


def _counts_by_side(
    both: DataFrame, columns: list[str], cell: str = "CAST({0} AS DOUBLE)"
) -> DataFrame:
    """Rows of either side per (feature, value), combined before the shuffle.

    The sides are unpivoted separately (each filter leaves one input of the
    pair): an unpivot that carries the side along would not let Spark share
    the counts between the uses.
    """

    def leg(side: str) -> DataFrame:
        return S.to_long(both.where(_side(side)), columns, cell=cell).withColumns(
            {"r": F.lit(int(side == REFERENCE)), "c": F.lit(int(side == CURRENT))}
        )

    legs = leg(REFERENCE).unionByName(leg(CURRENT))
    return legs.groupBy("feature", "value").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))


def _across(rows: DataFrame, value: str) -> DataFrame:
    """Per feature: the value on either side and the change."""
    wide = rows.groupBy("feature").agg(
        F.max(F.when(_side(REFERENCE), F.col(value))).alias(REFERENCE),
        F.max(F.when(_side(CURRENT), F.col(value))).alias(CURRENT),
    )
    return wide.withColumn("change", F.col(CURRENT) - F.col(REFERENCE))


def missing_drift(both: DataFrame, columns: list[str]) -> DataFrame:
    """Share of missing values per side and its change, in percent points."""
    return _across(null_report(both, columns, ["side"]), "missing_pct")


def correlation_drift(both: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Correlation with the label per side and its change."""
    return _across(target_correlations(both, columns, label, ["side"]), "correlation")


def ks_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    n, m = G.dbl(n), G.dbl(m)
    scaled = F.sqrt(F.try_divide(n * m, n + m)) * statistic
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0)
        * F.exp(F.lit(-2.0) * G.dbl(k) * G.dbl(k) * scaled * scaled),
    )
    series = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    # the series does not converge near 0, where the p-value is 1
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    return F.when(scaled < 0.2, 1.0).when(scaled.isNotNull(), bounded)


def ks_test(both: DataFrame, columns: list[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and p-value of every numeric column.

    Rows are counted per distinct value first; both distribution functions
    are then accumulated in buckets, so no task orders a whole column. A column
    without values on one side has no statistic.
    """
    counts = _counts_by_side(both, columns)
    ranked = running_totals(counts, ["feature"], "value", ["r", "c"])
    gap = F.abs(
        G.safe_div(F.col("r_upto"), F.col("r_all")) - G.safe_div(F.col("c_upto"), F.col("c_all"))
    )
    tested = ranked.groupBy("feature").agg(
        F.max(gap).alias("statistic"), F.max("r_all").alias("n"), F.max("c_all").alias("m")
    )
    return tested.withColumn("p_value", ks_p_value(F.col("statistic"), F.col("n"), F.col("m")))


TERMS = 300  # of the series and the continued fraction below
LARGE = 2000.0  # half the degrees of freedom beyond which a normal tail is used


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series at z + 8, carried back."""
    up = z + 8
    series = 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7)
    back = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda a, k: a + F.log(z + k))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - back


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    # the arguments are computed once and named inside, not repeated wherever they occur
    both = F.array(F.struct(a.alias("a"), x.alias("x")))
    return F.transform(both, lambda p: _upper_gamma(p["a"], p["x"]))[0]


def _upper_gamma(a: Column, x: Column) -> Column:
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    front = F.exp(a * F.log(x) - x - log_gamma(a))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * x / (a + k)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    first = F.struct((1 / a).alias("term"), (1 / a).alias("total"))
    lower = F.aggregate(steps, first, add, lambda s: s["total"])

    def fraction(s: Column, k: Column) -> Column:
        top, b = -k * (k - a), x + 1 - a + 2 * k
        d = 1 / (top * s["d"] + b)
        c = b + top / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    d0 = F.try_divide(F.lit(1.0), x + 1 - a)
    begin = F.struct(F.lit(1e300).alias("c"), d0.alias("d"), d0.alias("h"))
    upper = F.aggregate(steps, begin, fraction, lambda s: s["h"])
    return F.when(x < a + 1, 1 - front * lower).otherwise(front * upper)


def chi2_tail(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-squared distribution as column expressions.

    Beyond 2 * LARGE degrees of freedom by the cube-root normal approximation.
    """
    x, k = G.dbl(statistic), F.greatest(G.dbl(dof), F.lit(1.0))
    z = (F.cbrt(x / k) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k))
    # both are tails of one function, built once: the expression is long
    many = k / 2 > LARGE
    shape = F.when(many, 0.5).otherwise(k / 2)
    found = upper_gamma(shape, F.when(many, F.greatest(z * z / 2, F.lit(1e-300))).otherwise(x / 2))
    tail = F.when(many & (z >= 0), found / 2).when(many, 1 - found / 2).otherwise(found)
    return F.when((dof <= 0) | (x <= 0), 1.0).when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def chi2_test(both: DataFrame, columns: list[str]) -> DataFrame:
    """Chi-squared homogeneity test of every categorical column across the sides."""
    cells = _counts_by_side(both, columns, S.AS_TEXT)
    whole = cells.groupBy("feature").agg(
        F.sum("r").alias("r_all"), F.sum("c").alias("c_all"), F.count(F.lit(1)).alias("categories")
    )
    # one row per feature
    joined = cells.join(F.broadcast(whole), "feature")
    n = G.dbl(F.col("r_all") + F.col("c_all"))

    def term(observed: str, margin: str) -> Column:
        expected = G.dbl(F.col("r") + F.col("c")) * G.dbl(F.col(margin)) / n
        gap = G.dbl(F.col(observed)) - expected
        return F.try_divide(gap * gap, expected)

    tested = (
        joined.groupBy("feature")
        .agg(
            F.sum(term("r", "r_all") + term("c", "c_all")).alias("statistic"),
            (F.max("categories") - 1).alias("dof"),
            F.max("r_all").alias("n"),
            F.max("c_all").alias("m"),
        )
    )
    one_sided = (F.col("n") == 0) | (F.col("m") == 0)
    statistic = F.when(~one_sided, F.col("statistic"))
    return tested.select(
        "feature", statistic.alias("statistic"), "dof", "n", "m", chi2_tail(statistic, F.col("dof")).alias("p_value")
    )


TESTED, LOST, NEW, EMPTY = "tested", "lost", "new", "empty"


def drift_report(
    both: DataFrame, numeric: list[str], categorical: list[str], p_limit: float = 0.05
) -> DataFrame:
    """Test, statistic, p-value, status and verdict of every feature.

    A feature with values on one side only cannot be tested and counts as
    drifted: ``lost`` has none in the current side, ``new`` none in the
    reference. One without any value is ``empty`` and did not drift.
    """
    parts = []
    if numeric:
        parts.append(ks_test(both, numeric).withColumn("test", F.lit("kolmogorov_smirnov")))
    if categorical:
        parts.append(chi2_test(both, categorical).withColumn("test", F.lit("chi_squared")))
    columns = ["feature", "test", "statistic", "p_value", "n", "m"]
    rows = parts[0].select(*columns)
    for part in parts[1:]:
        rows = rows.unionByName(part.select(*columns))
    asked = [(c, "kolmogorov_smirnov") for c in numeric] + [(c, "chi_squared") for c in categorical]
    every = both.sparkSession.createDataFrame(asked, "feature string, test string")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    status = F.when((n == 0) & (m == 0), EMPTY).when(m == 0, LOST).when(n == 0, NEW).otherwise(TESTED)
    # one row per feature
    full = every.join(rows, ["feature", "test"], "left").withColumn("status", status)
    drifted = F.when(F.col("status") == TESTED, F.col("p_value") < F.lit(p_limit)).otherwise(
        F.col("status").isin(LOST, NEW)
    )
    return full.select("feature", "test", "statistic", "p_value", "status", drifted.alias("drifted"))


def drift_alert(report: DataFrame, share_limit: float = 0.5) -> DataFrame:
    """Features with values and drifted ones, their share, lost ones, and whether to alert.

    A feature that was lost or is new calls for an alert by itself.
    """
    share = G.safe_div(F.col("drifted_features"), F.col("features"))
    return report.agg(
        F.count_if(F.col("status") != EMPTY).alias("features"),
        F.count_if("drifted").alias("drifted_features"),
        F.count_if(F.col("status").isin(LOST, NEW)).alias("one_sided_features"),
    ).select(
        "features",
        "drifted_features",
        "one_sided_features",
        share.alias("drift_share"),
        (F.coalesce(share >= F.lit(share_limit), F.lit(False)) | (F.col("one_sided_features") > 0)).alias("alert"),
    )


def prediction_drift(reference: DataFrame, current: DataFrame, proba: str = "proba") -> DataFrame:
    """Kolmogorov-Smirnov test of the scores."""
    both = pair(reference.select(proba), current.select(proba))
    return ks_test(both, [proba])


def common_features(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical columns to test."""
    skip = (K.CLIENT_KEY, K.TARGET, "side", "split")
    return S.numeric_columns(df, skip), S.string_columns(df, skip)
