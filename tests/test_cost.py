"""Business cost, threshold sweep and metrics on small literal cases."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from loanloom.operators import evaluate as E


def classes(spark, y, p):
    return spark.createDataFrame(list(zip(y, p)), "TARGET int, prediction int")


def scores(spark, y, p):
    return spark.createDataFrame(
        [(int(a), float(b)) for a, b in zip(y, p)], "TARGET int, proba double"
    )


@pytest.mark.parametrize(
    "y, p, cost",
    [
        ([0, 0, 0, 1, 1, 1], [0, 0, 0, 1, 1, 1], 0),
        ([1] * 4, [0] * 4, 40),
        ([0] * 4, [1] * 4, 4),
        ([0, 0, 1, 1], [1, 0, 0, 1], 11),
        ([1], [0], 10),
    ],
)
def test_cost(spark, y, p, cost):
    assert E.business_cost(classes(spark, y, p)).first()["business_cost"] == cost


def test_cost_weights(spark):
    df = classes(spark, [0, 1], [1, 0])
    assert E.business_cost(df, cost_fn=20, cost_fp=5).first()["business_cost"] == 25


def test_normalized_cost(spark):
    df = classes(spark, [0, 0, 1, 1], [1, 0, 0, 1])
    assert E.business_cost(df).first()["normalized_cost"] == 2.75


def test_cost_matrix(spark):
    row = E.cost_matrix(classes(spark, [0, 0, 0, 1, 1], [0, 0, 1, 0, 1])).first()
    assert (row.TN, row.FP, row.FN, row.TP, row.total_cost) == (2, 1, 1, 1, 11)


def test_empty_input_is_an_error(spark):
    with pytest.raises(PySparkException):
        E.business_cost(classes(spark, [], [])).collect()


SWEEP_Y = [0] * 5 + [1] * 5
SWEEP_P = [0.1, 0.2, 0.3, 0.4, 0.45, 0.55, 0.6, 0.7, 0.8, 0.9]


@pytest.mark.parametrize("grid", [E.default_grid(), E.stepped_grid()])
def test_sweep_takes_the_first_minimum(spark, grid):
    best = E.optimal_threshold(E.threshold_curve(scores(spark, SWEEP_Y, SWEEP_P), thresholds=grid))
    row = best.first()
    assert row["cost"] == 0
    assert row["threshold"] == pytest.approx(0.46)


@pytest.mark.parametrize("grid", [E.default_grid(), E.stepped_grid(), [0.3], [0.9, 0.1, 0.25]])
def test_sweep_equals_brute_force(spark, grid):
    rng = np.random.default_rng(7)
    y = rng.binomial(1, 0.2, 300)
    p = np.round(np.clip(y * 0.3 + rng.uniform(0, 0.7, 300), 0, 1), 2)
    curve = {r["threshold"]: r for r in E.threshold_curve(scores(spark, y, p), thresholds=grid).collect()}
    assert len(curve) == len(grid)
    for t in grid:
        pred = p >= t
        fn, fp = int(((y == 1) & ~pred).sum()), int(((y == 0) & pred).sum())
        assert (curve[t]["FN"], curve[t]["FP"], curve[t]["cost"]) == (fn, fp, 10 * fn + fp)
    best = E.optimal_threshold(E.threshold_curve(scores(spark, y, p), thresholds=grid)).first()
    assert best["cost"] == min(r["cost"] for r in curve.values())


def test_perfect_auc(spark):
    assert E.roc_auc(scores(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first()["auc"] == 1.0


def test_auc_equals_the_evaluator(spark, tables):
    df = tables.scored.select("TARGET", "proba")
    expected = BinaryClassificationEvaluator(
        rawPredictionCol="proba", labelCol="TARGET", numBins=0
    ).evaluate(df.withColumn("TARGET", F.col("TARGET").cast("double")))
    assert E.roc_auc(df).first()["auc"] == pytest.approx(expected, abs=1e-12)


def test_one_class_has_no_auc(spark):
    row = E.all_metrics(scores(spark, [0] * 4, [0.1, 0.2, 0.3, 0.4]), 0.5).first()
    assert (row["TN"], row["TP"], row["auc"]) == (4, 0, None)


def test_metrics_are_shares(spark):
    row = E.all_metrics(scores(spark, [0, 0, 1, 1], [0.2, 0.3, 0.7, 0.8]), 0.5).first()
    for name in ("auc", "accuracy", "precision", "recall", "f1_score"):
        assert 0 <= row[name] <= 1


# recorded totals of a published run: threshold, TP, FP, FN, TN, accuracy, precision, recall, F1, cost
RECORDED = [
    (0.44, 1042, 5003, 441, 11965, 0.7049, 0.1724, 0.7026, 0.2768, 9413),
    (0.5, 927, 3964, 556, 13004, 0.7550, 0.1895, 0.6251, 0.2909, 9524),
]


@pytest.mark.parametrize("t, tp, fp, fn, tn, acc, prec, rec, f1, cost", RECORDED)
def test_recorded_run(spark, t, tp, fp, fn, tn, acc, prec, rec, f1, cost):
    counts = [(1, t, tp), (0, t, fp), (1, t - 0.01, fn), (0, t - 0.01, tn)]
    cells = spark.createDataFrame(counts, "TARGET int, proba double, n int")
    df = cells.select("TARGET", "proba", F.explode(F.sequence(F.lit(1), "n"))).drop("col")
    row = E.all_metrics(df, t).first()
    assert (row["TP"], row["FP"], row["FN"], row["TN"]) == (tp, fp, fn, tn)
    assert round(row["accuracy"], 4) == acc
    assert round(row["precision"], 4) == prec
    assert round(row["recall"], 4) == rec
    assert round(row["f1_score"], 4) == f1
    assert row["business_cost"] == cost


def test_folds_are_evaluated_separately(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), int(rng.random() < 0.3), float(np.round(rng.random(), 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "fold int, TARGET int, proba double")
    together = {r["fold"]: r for r in E.fold_metrics(df).collect()}
    for fold in range(3):
        part = df.where(F.col("fold") == fold)
        best = E.optimal_threshold(E.threshold_curve(part)).first()
        assert together[fold]["threshold"] == best["threshold"]
        assert together[fold]["business_cost"] == best["cost"]
        assert together[fold]["auc"] == pytest.approx(E.roc_auc(part).first()["auc"])
