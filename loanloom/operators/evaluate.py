"""Classifier evaluation: business cost, threshold sweep, AUC, curves, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.operators.ordered import count_below, running_totals


def default_grid() -> list[float]:
    """0.01, 0.02, ... 0.98 as the nearest doubles."""
    return [i / 100 for i in range(1, 99)]


def stepped_grid() -> list[float]:
    """The same 98 points built as start + i * step; a quarter of them differ in the last bit."""
    return [0.01 + i * 0.01 for i in range(98)]


def predict_class(proba: Column, threshold: float) -> Column:
    return (proba >= F.lit(float(threshold))).cast("int")


def _require_rows(n: Column, value: Column) -> Column:
    """``value``, or an error when there are no rows to evaluate."""
    message = F.lit("no rows to evaluate")
    return F.when(n == 0, F.raise_error(message).cast("double")).otherwise(value)


def confusion(
    df: DataFrame, label: str = K.TARGET, pred: str = "prediction", by: list[str] | None = None
) -> DataFrame:
    """Counts TP, TN, FP, FN and n in one aggregation."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*(by or [])).agg(
        F.count_if((y == 1) & (p == 1)).alias("TP"),
        F.count_if((y == 0) & (p == 0)).alias("TN"),
        F.count_if((y == 0) & (p == 1)).alias("FP"),
        F.count_if((y == 1) & (p == 0)).alias("FN"),
        F.count(F.lit(1)).alias("n"),
    )


def _cost(cost_fn: float, cost_fp: float) -> Column:
    return G.dbl(F.col("FN")) * F.lit(float(cost_fn)) + G.dbl(F.col("FP")) * F.lit(float(cost_fp))


def _share(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0."""
    return F.coalesce(G.safe_div(num, den), F.lit(0.0))


def _precision() -> Column:
    return _share(F.col("TP"), F.col("TP") + F.col("FP"))


def _recall() -> Column:
    return _share(F.col("TP"), F.col("TP") + F.col("FN"))


def _f1() -> Column:
    return _share(2 * F.col("TP"), 2 * F.col("TP") + F.col("FP") + F.col("FN"))


def business_cost(
    df: DataFrame,
    label: str = K.TARGET,
    pred: str = "prediction",
    cost_fn: float = K.COST_FN,
    cost_fp: float = K.COST_FP,
) -> DataFrame:
    """Total and per-row business cost; an empty input is an error."""
    counts = confusion(df, label, pred)
    cost = _require_rows(F.col("n"), _cost(cost_fn, cost_fp))
    return counts.select(
        cost.alias("business_cost"), G.safe_div(cost, F.col("n")).alias("normalized_cost")
    )


def cost_matrix(
    df: DataFrame,
    label: str = K.TARGET,
    pred: str = "prediction",
    cost_fn: float = K.COST_FN,
    cost_fp: float = K.COST_FP,
) -> DataFrame:
    """Confusion counts, cost by error kind, precision, recall, specificity."""
    total = _require_rows(F.col("n"), _cost(cost_fn, cost_fp))
    return confusion(df, label, pred).select(
        "TP",
        "TN",
        "FP",
        "FN",
        (G.dbl(F.col("FN")) * F.lit(float(cost_fn))).alias("cost_FN"),
        (G.dbl(F.col("FP")) * F.lit(float(cost_fp))).alias("cost_FP"),
        total.alias("total_cost"),
        G.safe_div(total, F.col("n")).alias("normalized_cost"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        _share(F.col("TN"), F.col("TN") + F.col("FP")).alias("specificity"),
    )


def _grid_position(proba: Column, grid: list[float]) -> Column:
    """How many thresholds of an ascending grid are <= the score."""
    points = G.double_array(grid)
    return count_below(proba, points, len(grid), inclusive=True)


def threshold_curve(
    df: DataFrame,
    label: str = K.TARGET,
    proba: str = "proba",
    thresholds: list[float] | None = None,
    cost_fn: float = K.COST_FN,
    cost_fp: float = K.COST_FP,
    by: list[str] | None = None,
) -> DataFrame:
    """Confusion counts, cost, precision, recall and F1 at every threshold.

    One pass over the rows: each row is counted at its grid position, so at
    most ``len(thresholds) + 1`` rows per group leave the aggregation. These are
    gathered into one small array per group and summed from every threshold up.
    """
    by = by or []
    grid = default_grid() if thresholds is None else sorted(thresholds)
    y = F.col(label)
    at = df.select(*by, label, _grid_position(F.col(proba), grid).alias("position"))
    hits = at.groupBy(*by, "position").agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")
    )
    gathered = hits.groupBy(*by).agg(
        F.sum("pos").alias("P"),
        F.sum("neg").alias("N"),
        F.collect_list(F.struct("position", "pos", "neg")).alias("hits"),
    )
    points = G.double_array(grid)

    def from_here_up(name: str, position: Column) -> Column:
        def add(found: Column, h: Column) -> Column:
            return found + F.when(h["position"] >= position, h[name]).otherwise(F.lit(0))

        return F.aggregate("hits", F.lit(0).cast("bigint"), add)

    rows = F.transform(
        points,
        lambda g, i: F.struct(
            g.alias("threshold"),
            from_here_up("pos", i + 1).alias("TP"),
            from_here_up("neg", i + 1).alias("FP"),
        ),
    )
    counted = (
        gathered.where(F.col("P").isNotNull())
        .select(*by, "P", "N", F.explode(rows).alias("r"))
        .select(*by, "P", "N", "r.*")
    )
    counted = counted.withColumns(
        {"FN": F.col("P") - F.col("TP"), "TN": F.col("N") - F.col("FP")}
    )
    cost = _cost(cost_fn, cost_fp)
    return counted.select(
        *by,
        "threshold",
        "TP",
        "TN",
        "FP",
        "FN",
        cost.alias("cost"),
        G.safe_div(cost, F.col("P") + F.col("N")).alias("normalized_cost"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1_score"),
    )


def optimal_threshold(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The cheapest row of a curve; ties go to the smallest threshold."""
    best = F.min_by(F.struct(*[c for c in curve.columns if c not in (by or [])]),
                    F.struct("cost", "threshold"))
    return curve.groupBy(*(by or [])).agg(best.alias("best")).select(*(by or []), "best.*")


def score_counts(
    df: DataFrame, label: str = K.TARGET, proba: str = "proba", by: list[str] | None = None
) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label)
    scores = df.select(
        *(by or []),
        F.col(proba).cast("double").alias("score"),
        G.flag(y == 1).alias("pos"),
        G.flag(y == 0).alias("neg"),
    )
    return scores.groupBy(*(by or []), "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )


def roc_auc(
    df: DataFrame, label: str = K.TARGET, proba: str = "proba", by: list[str] | None = None
) -> DataFrame:
    """Area under the ROC curve with ties averaged; NULL when only one class is present."""
    by = by or []
    ranked = running_totals(score_counts(df, label, proba, by), by, "score", ["pos", "neg"])
    wins = F.sum(G.dbl(F.col("pos")) * (G.dbl(F.col("neg_below")) + G.dbl(F.col("neg")) / 2))
    pairs = F.max(G.dbl(F.col("pos_all"))) * F.max(G.dbl(F.col("neg_all")))
    return ranked.groupBy(*by).agg(F.try_divide(wins, pairs).alias("auc"))


def roc_points(df: DataFrame, label: str = K.TARGET, proba: str = "proba") -> DataFrame:
    """False and true positive rate at every distinct score taken as threshold."""
    ranked = running_totals(score_counts(df, label, proba), [], "score", ["pos", "neg"])
    return ranked.select(
        F.col("score").alias("threshold"),
        G.safe_div(F.col("neg_all") - F.col("neg_below"), F.col("neg_all")).alias("fpr"),
        G.safe_div(F.col("pos_all") - F.col("pos_below"), F.col("pos_all")).alias("tpr"),
    )


def nearest_roc_point(points: DataFrame, threshold: float) -> DataFrame:
    """The curve point whose threshold is closest; ties go to the larger threshold."""
    gap = F.abs(F.col("threshold") - F.lit(float(threshold)))
    return points.orderBy(gap, F.col("threshold").desc()).limit(1)


def all_metrics(
    df: DataFrame,
    threshold: float = 0.5,
    label: str = K.TARGET,
    proba: str = "proba",
    cost_fn: float = K.COST_FN,
    cost_fp: float = K.COST_FP,
) -> DataFrame:
    """One row with AUC, accuracy, precision, recall, F1, cost and confusion counts."""
    return metrics_at(df, F.lit(float(threshold)), label, proba, cost_fn, cost_fp)


def metrics_at(
    df: DataFrame,
    threshold: Column,
    label: str = K.TARGET,
    proba: str = "proba",
    cost_fn: float = K.COST_FN,
    cost_fp: float = K.COST_FP,
) -> DataFrame:
    """:func:`all_metrics` at a threshold given as a column, e.g. a scalar subquery."""
    classed = df.select(label, (F.col(proba) >= threshold).cast("int").alias("prediction"))
    counts = confusion(classed, label, "prediction")
    cost = _require_rows(F.col("n"), _cost(cost_fn, cost_fp))
    return counts.select(
        threshold.alias("threshold"),
        roc_auc(df, label, proba).scalar().alias("auc"),
        _share(F.col("TP") + F.col("TN"), F.col("n")).alias("accuracy"),
        _precision().alias("precision"),
        _recall().alias("recall"),
        _f1().alias("f1_score"),
        cost.alias("business_cost"),
        G.safe_div(cost, F.col("n")).alias("normalized_cost"),
        "TP",
        "TN",
        "FP",
        "FN",
    )


def metrics_report(
    df: DataFrame,
    label: str = K.TARGET,
    proba: str = "proba",
    cost_fn: float = K.COST_FN,
    cost_fp: float = K.COST_FP,
    thresholds: list[float] | None = None,
) -> DataFrame:
    """Metrics at 0.5 and at the optimum, and what the optimum saves."""
    grid = default_grid() if thresholds is None else sorted(thresholds)
    # one sweep that includes 0.5 gives both rows
    curve = threshold_curve(df, label, proba, sorted({*grid, 0.5}), cost_fn, cost_fp)
    asked = F.col("threshold").isin([float(x) for x in grid])
    found = curve.agg(
        F.min_by(F.struct(*curve.columns), F.when(asked, F.struct("cost", "threshold"))).alias("optimal"),
        F.max(F.when(F.col("threshold") == 0.5, F.struct(*curve.columns))).alias("default"),
    )
    auc = roc_auc(df, label, proba).scalar()
    both = F.array(
        F.struct(F.lit("default").alias("setting"), F.col("default").alias("at")),
        F.struct(F.lit("optimal").alias("setting"), F.col("optimal").alias("at")),
    )
    rows = found.select(F.inline(both), F.col("default.cost").alias("base"))
    rows = rows.select("setting", "at.*", "base")
    n = F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN")
    cost = _require_rows(F.coalesce(n, F.lit(0)), F.col("cost"))
    return rows.select(
        "threshold",
        auc.alias("auc"),
        _share(F.col("TP") + F.col("TN"), n).alias("accuracy"),
        "precision",
        "recall",
        "f1_score",
        cost.alias("business_cost"),
        "normalized_cost",
        "TP",
        "TN",
        "FP",
        "FN",
        "setting",
        (F.col("base") - F.col("cost")).alias("cost_reduction"),
        (G.safe_div(F.col("base") - F.col("cost"), F.col("base")) * 100).alias("relative_reduction_pct"),
    )


def confusion_table(
    df: DataFrame,
    label: str = K.TARGET,
    pred: str = "prediction",
    cost_fn: float = K.COST_FN,
    cost_fp: float = K.COST_FP,
) -> DataFrame:
    """All four (label, prediction) cells with count and cost, empty cells included."""
    cells = [("TN", 0, 0, 0.0), ("FP", 0, 1, cost_fp), ("FN", 1, 0, cost_fn), ("TP", 1, 1, 0.0)]
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("cell"),
                F.lit(y).alias("label"),
                F.lit(p).alias("prediction"),
                F.col(name).alias("rows"),
                (G.dbl(F.col(name)) * F.lit(float(c))).alias("cost"),
            )
            for name, y, p, c in cells
        ]
    )
    return confusion(df, label, pred).select(F.explode(rows).alias("r")).select("r.*")


def cross_validation_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over fold rows (auc, accuracy, business_cost, threshold)."""
    return folds.agg(
        F.avg("auc").alias("auc_mean"),
        F.stddev_pop("auc").alias("auc_std"),
        F.avg("accuracy").alias("accuracy_mean"),
        F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("business_cost").alias("cost_mean"),
        F.stddev_pop("business_cost").alias("cost_std"),
        F.avg("threshold").alias("threshold_mean"),
    )


def fold_metrics(
    df: DataFrame,
    fold: str = "fold",
    label: str = K.TARGET,
    proba: str = "proba",
    thresholds: list[float] | None = None,
) -> DataFrame:
    """Per fold: best threshold, its accuracy and cost, and the AUC; all folds in one job."""
    curve = threshold_curve(df, label, proba, thresholds, by=[fold])
    best = optimal_threshold(curve, [fold])
    auc = roc_auc(df, label, proba, by=[fold])
    n = F.col("TP") + F.col("TN") + F.col("FP") + F.col("FN")
    return best.join(auc, fold).select(
        fold,
        "auc",
        _share(F.col("TP") + F.col("TN"), n).alias("accuracy"),
        F.col("cost").alias("business_cost"),
        "threshold",
    )
