"""Evaluation queries over labelled scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom.catalog.base import r6, register, with_tables
from loanloom.catalog.features import md5_rank
from loanloom.operators import evaluate as E
from loanloom.operators import sampling

GRID = "SELECT CAST(i AS DOUBLE) / 100 AS threshold FROM range(1, 99) t(i)"
STEPPED = "SELECT CAST(0.01 AS DOUBLE) + CAST(i AS DOUBLE) * CAST(0.01 AS DOUBLE) AS threshold FROM range(0, 98) t(i)"
CLASSED = "SELECT *, CASE WHEN proba >= 0.44 THEN 1 ELSE 0 END AS prediction FROM scored"
CONFUSION = """
SELECT count(*) FILTER (WHERE TARGET = 1 AND prediction = 1) AS TP,
  count(*) FILTER (WHERE TARGET = 0 AND prediction = 0) AS TN,
  count(*) FILTER (WHERE TARGET = 0 AND prediction = 1) AS FP,
  count(*) FILTER (WHERE TARGET = 1 AND prediction = 0) AS FN, count(*) AS n FROM classed"""
CURVE = """
SELECT threshold, count(*) FILTER (WHERE TARGET = 1 AND proba >= threshold) AS TP,
  count(*) FILTER (WHERE TARGET = 0 AND proba < threshold) AS TN,
  count(*) FILTER (WHERE TARGET = 0 AND proba >= threshold) AS FP,
  count(*) FILTER (WHERE TARGET = 1 AND proba < threshold) AS FN, count(*) AS n
FROM scored, grid GROUP BY threshold"""
AUC = """
SELECT sum(CASE WHEN TARGET = 1 THEN CAST(r AS DOUBLE) ELSE 0 END) AS rank_sum,
  CAST(sum(TARGET) AS DOUBLE) AS pos_n, CAST(count(*) - sum(TARGET) AS DOUBLE) AS neg_n
FROM (SELECT TARGET, rank() OVER (ORDER BY proba) + (count(*) OVER (PARTITION BY proba) - 1) / 2 AS r FROM scored)"""
AUC_VALUE = "(rank_sum - pos_n * (pos_n + 1) / 2) / (pos_n * neg_n)"


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


PRECISION, RECALL = _div("TP", "TP + FP"), _div("TP", "TP + FN")
F1 = _div("2 * TP", "2 * TP + FP + FN")
COST = "CAST(FN * 10 + FP AS DOUBLE)"


def _classed(t):
    return t.scored.withColumn("prediction", E.predict_class(F.col("proba"), 0.44))


@register(
    "e1_business_cost",
    with_tables(f"SELECT {r6(COST, 'business_cost')} FROM cm", "scored", classed=CLASSED, cm=CONFUSION),
)
def e1(t):
    return E.business_cost(_classed(t)).select("business_cost")


@register(
    "e2_normalized_cost",
    with_tables(f"SELECT {r6(COST + ' / n', 'normalized_cost')} FROM cm", "scored", classed=CLASSED, cm=CONFUSION),
)
def e2(t):
    return E.business_cost(_classed(t)).select("normalized_cost")


@register(
    "e3_cost_matrix",
    with_tables(
        f"""
SELECT TP, TN, FP, FN, {r6('FN * 10', 'cost_FN')}, {r6('FP', 'cost_FP')}, {r6(COST, 'total_cost')},
  {r6(COST + ' / n', 'normalized_cost')}, {r6(PRECISION, 'precision')}, {r6(RECALL, 'recall')},
  {r6(_div('TN', 'TN + FP'), 'specificity')} FROM cm""",
        "scored",
        classed=CLASSED,
        cm=CONFUSION,
    ),
)
def e3(t):
    return E.cost_matrix(_classed(t))


def _curve_sql(grid: str) -> str:
    return with_tables(
        f"SELECT {r6('threshold', 'threshold', 9)}, TP, TN, FP, FN, {r6(COST, 'cost')},"
        f" {r6(COST + ' / n', 'normalized_cost')} FROM curve",
        "scored",
        grid=grid,
        curve=CURVE,
    )


def _curve_columns(curve):
    return curve.select(
        F.round(F.col("threshold") + F.lit(1e-8), 9).alias("threshold"),
        "TP",
        "TN",
        "FP",
        "FN",
        *[F.round(F.col(c) + F.lit(1e-8), 6).alias(c) for c in ("cost", "normalized_cost")],
    )


@register("e4_threshold_sweep", _curve_sql(GRID), digits=None)
def e4(t):
    return _curve_columns(E.threshold_curve(t.scored))


@register("e4_threshold_sweep_stepped_grid", _curve_sql(STEPPED), digits=None)
def e4_stepped(t):
    return _curve_columns(E.threshold_curve(t.scored, thresholds=E.stepped_grid()))


BEST = "SELECT * FROM curve ORDER BY FN * 10 + FP, threshold LIMIT 1"


@register(
    "e4_optimal_threshold",
    with_tables(
        f"""
SELECT {r6('threshold', 'threshold')}, TP, TN, FP, FN, {r6(COST, 'cost')}, {r6(COST + ' / n', 'normalized_cost')},
  {r6(PRECISION, 'precision')}, {r6(RECALL, 'recall')}, {r6(F1, 'f1_score')} FROM best""",
        "scored",
        grid=GRID,
        curve=CURVE,
        best=BEST,
    ),
)
def e4_best(t):
    return E.optimal_threshold(E.threshold_curve(t.scored))


METRIC_COLUMNS = f"""{r6(AUC_VALUE, 'auc')}, {r6(_div('TP + TN', 'n'), 'accuracy')},
  {r6(PRECISION, 'precision')}, {r6(RECALL, 'recall')}, {r6(F1, 'f1_score')}, {r6(COST, 'business_cost')},
  {r6(COST + ' / n', 'normalized_cost')}, TP, TN, FP, FN"""


@register(
    "e5_all_metrics",
    with_tables(
        f"SELECT {r6('0.44', 'threshold')}, {METRIC_COLUMNS} FROM cm, ranks",
        "scored",
        classed=CLASSED,
        cm=CONFUSION,
        ranks=AUC,
    ),
)
def e5(t):
    return E.all_metrics(t.scored, 0.44)


@register("e6_roc_auc", with_tables(f"SELECT {r6(AUC_VALUE, 'auc')} FROM ranks", "scored", ranks=AUC))
def e6(t):
    return E.roc_auc(t.scored)


ROC = """
SELECT s AS threshold, count(*) FILTER (WHERE TARGET = 0 AND proba >= s) / CAST(count(*) FILTER (WHERE TARGET = 0) AS DOUBLE) AS fpr,
  count(*) FILTER (WHERE TARGET = 1 AND proba >= s) / CAST(count(*) FILTER (WHERE TARGET = 1) AS DOUBLE) AS tpr
FROM scored, (SELECT DISTINCT proba AS s FROM scored) GROUP BY s"""


@register(
    "e7_roc_points",
    with_tables(
        f"SELECT {r6('threshold', 'threshold')}, {r6('fpr', 'fpr')}, {r6('tpr', 'tpr')} FROM roc",
        "scored",
        roc=ROC,
    ),
)
def e7(t):
    return E.roc_points(t.scored)


@register(
    "e7_nearest_roc_point",
    with_tables(
        f"""SELECT {r6('threshold', 'threshold')}, {r6('fpr', 'fpr')}, {r6('tpr', 'tpr')} FROM roc
ORDER BY abs(threshold - 0.447), threshold DESC LIMIT 1""",
        "scored",
        roc=ROC,
    ),
)
def e7_nearest(t):
    return E.nearest_roc_point(E.roc_points(t.scored), 0.447)


@register(
    "e8_metric_curves",
    with_tables(
        f"""SELECT {r6('threshold', 'threshold')}, {r6(PRECISION, 'precision')}, {r6(RECALL, 'recall')},
  {r6(F1, 'f1_score')} FROM curve""",
        "scored",
        grid=GRID,
        curve=CURVE,
    ),
)
def e8(t):
    return E.threshold_curve(t.scored).select("threshold", "precision", "recall", "f1_score")


_AT = """
SELECT '{setting}' AS setting, {cut} AS threshold,
  count(*) FILTER (WHERE TARGET = 1 AND proba >= {cut}) AS TP, count(*) FILTER (WHERE TARGET = 0 AND proba < {cut}) AS TN,
  count(*) FILTER (WHERE TARGET = 0 AND proba >= {cut}) AS FP, count(*) FILTER (WHERE TARGET = 1 AND proba < {cut}) AS FN,
  count(*) AS n FROM scored"""
_TWO = (
    _AT.format(setting="default", cut="0.5")
    + " UNION ALL "
    + _AT.format(setting="optimal", cut="(SELECT threshold FROM best)")
)
_BASE = "(SELECT CAST(FN * 10 + FP AS DOUBLE) FROM two WHERE setting = 'default')"


@register(
    "e9_metrics_report",
    with_tables(
        f"""
SELECT setting, {r6('threshold', 'threshold')}, {METRIC_COLUMNS},
  {r6(_BASE + ' - ' + COST, 'cost_reduction')},
  {r6('(' + _BASE + ' - ' + COST + ') / ' + _BASE + ' * 100', 'relative_reduction_pct')} FROM two, ranks""",
        "scored",
        grid=GRID,
        curve=CURVE,
        best=BEST,
        two=_TWO,
        ranks=AUC,
    ),
)
def e9(t):
    return E.metrics_report(t.scored)


@register(
    "e10_confusion_table",
    with_tables(
        f"""
SELECT cell, label, prediction, rows, {r6('cost', 'cost')} FROM (
  SELECT 'TN' AS cell, 0 AS label, 0 AS prediction, TN AS rows, 0 AS cost FROM cm
  UNION ALL SELECT 'FP', 0, 1, FP, FP FROM cm UNION ALL SELECT 'FN', 1, 0, FN, FN * 10 FROM cm
  UNION ALL SELECT 'TP', 1, 1, TP, 0 FROM cm)""",
        "scored",
        classed=CLASSED,
        cm=CONFUSION,
    ),
)
def e10(t):
    return E.confusion_table(_classed(t))


FOLDED = f"""
SELECT *, (SELECT count(*) FROM range(1, 5) t(i) WHERE floor(n * CAST(i AS DOUBLE) / 5) < rk AND floor(n * CAST(i AS DOUBLE) / 5) > 0) AS fold FROM (
  SELECT *, {md5_rank(42, 'TARGET')} AS rk, count(*) OVER (PARTITION BY TARGET) AS n FROM scored)"""
FOLD_CURVE = CURVE.replace("SELECT threshold,", "SELECT fold, threshold,").replace(
    "FROM scored, grid GROUP BY threshold", "FROM folded, grid GROUP BY fold, threshold"
)
FOLD_BEST = """
SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY fold ORDER BY FN * 10 + FP, threshold) = 1"""
FOLD_AUC = """
SELECT fold, (sum(CASE WHEN TARGET = 1 THEN CAST(r AS DOUBLE) ELSE 0 END) - sum(TARGET) * (sum(TARGET) + 1.0) / 2)
  / (CAST(sum(TARGET) AS DOUBLE) * (count(*) - sum(TARGET))) AS auc
FROM (SELECT fold, TARGET, rank() OVER (PARTITION BY fold ORDER BY proba)
  + (count(*) OVER (PARTITION BY fold, proba) - 1) / 2 AS r FROM folded) GROUP BY fold"""


@register(
    "e11_cross_validation_summary",
    with_tables(
        f"""
SELECT {r6('avg(auc)', 'auc_mean')}, {r6('stddev_pop(auc)', 'auc_std')},
  {r6('avg((TP + TN) / CAST(n AS DOUBLE))', 'accuracy_mean')}, {r6('stddev_pop((TP + TN) / CAST(n AS DOUBLE))', 'accuracy_std')},
  {r6('avg(FN * 10 + FP)', 'cost_mean')}, {r6('stddev_pop(FN * 10 + FP)', 'cost_std')},
  {r6('avg(threshold)', 'threshold_mean')} FROM best JOIN aucs USING (fold)""",
        "scored",
        folded=FOLDED,
        grid=GRID,
        curve=FOLD_CURVE,
        best=FOLD_BEST,
        aucs=FOLD_AUC,
    ),
)
def e11(t):
    folds = sampling.stratified_folds(t.scored, "SK_ID_CURR", "TARGET", 5)
    return E.cross_validation_summary(E.fold_metrics(folds))
