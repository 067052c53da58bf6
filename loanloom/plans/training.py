"""Training, cross-validation and the model card."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.operators import evaluate as E
from loanloom.operators import sampling
from loanloom.plans.leafwise import LeafwiseScorer, load_trees, save_trees, train_leafwise
from loanloom.plans.scoring import VectorScorer
from loanloom.session import ensure_checkpoint_dir, materialize


def balanced_weights(df: DataFrame, label: str = K.TARGET) -> DataFrame:
    """Adds ``weight`` = n / (classes * rows of the class)."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n, k = sum(counts.values()), len(counts)
    weight = F.lit(None).cast("double")
    for value, rows in counts.items():  # one entry per class
        weight = F.when(F.col(label) == value, F.lit(n / (k * rows))).otherwise(weight)
    return df.withColumn("weight", weight)


def train_boosted(
    df: DataFrame,
    features: list[str],
    label: str = K.TARGET,
    validation: str | None = None,
    **overrides,
) -> VectorScorer:
    """Boosted trees with balanced class weights.

    With ``validation`` (a 0/1 column) the rows it marks are not fitted but scored
    after every round, in one pass. The model keeps the rounds up to the best one: that
    with the lowest loss before ``patience`` rounds brought none lower. More and
    more rounds are tried, twice as many each time, until that is decided. A fit
    repeats exactly, so the kept rounds are fitted again rather than cut out of a model.
    """
    settings = {**K.BOOSTING, **overrides}
    ensure_checkpoint_dir(df.sparkSession)
    assembled = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    rows = assembled.select(
        "_features",
        F.col(label).cast("double").alias("label"),
        *([F.col(validation).cast("boolean").alias("is_validation")] if validation else []),
    )
    checked = rows.where("is_validation") if validation else None
    fitted = rows.where("not is_validation") if validation else rows
    fitted = balanced_weights(fitted, "label").select("_features", "label", "weight")
    booster = GBTClassifier(
        featuresCol="_features",
        labelCol="label",
        weightCol="weight",
        maxIter=settings["trees"],
        stepSize=settings["learning_rate"],
        maxDepth=settings["max_depth"],
        subsamplingRate=settings["row_fraction"],
        featureSubsetStrategy=settings["feature_fraction"],
        minInstancesPerNode=settings["min_rows_per_leaf"],
        checkpointInterval=10,
        seed=settings["seed"],
    )
    kept = fitted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = _boost(booster, kept, checked, settings)
    finally:
        kept.unpersist()
    return VectorScorer(model, features, len(model.trees))


def _boost(booster: GBTClassifier, rows: DataFrame, checked: DataFrame | None, settings: dict):
    if checked is None:
        return booster.fit(rows)
    checked, patience, rounds = balanced_weights(checked, "label"), settings["patience"], 0
    while True:
        rounds = min(settings["trees"], max(2 * rounds, 2 * patience))
        model = booster.setMaxIter(rounds).fit(rows)
        losses = model.evaluateEachIteration(checked)
        best = best_round(losses, patience)
        if rounds == settings["trees"] or rounds - best >= patience:
            return model if best == rounds else booster.setMaxIter(best).fit(rows)


def best_round(losses: list[float], patience: int) -> int:
    """The round (from 1) with the lowest loss, until ``patience`` rounds did not beat it."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def _fit(estimator, rows: DataFrame):
    """Fit over rows that are kept in memory (or spilled) for the passes of the fit."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(kept)
    finally:
        kept.unpersist()


def train_logistic(
    df: DataFrame, features: list[str], label: str = K.TARGET, reg: float = 0.01
) -> VectorScorer:
    """Regularised logistic regression with balanced class weights."""
    assembled = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    rows = assembled.select("_features", F.col(label).cast("double").alias("label"))
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="weight", regParam=reg, maxIter=50
    )
    return VectorScorer(_fit(learner, balanced_weights(rows, "label")), features)


TRAINERS = {"boosted": train_boosted, "leafwise": train_leafwise, "logistic": train_logistic}
STOPS_EARLY = {"boosted", "leafwise"}
FOLDS_AT_ONCE = 5  # fits whose jobs share the executors


@dataclass
class TrainingResult:
    scorer: VectorScorer | LeafwiseScorer
    threshold: float
    train_metrics: dict
    valid_metrics: dict
    config: dict
    valid_scores: DataFrame


def train_and_evaluate(
    prepared: DataFrame,
    features: list[str],
    kind: str = "boosted",
    holdout: float = 0.2,
    name: str = "credit_default_model",
    **overrides,
) -> TrainingResult:
    """Stratified hold-out, fit, best threshold on the held-out rows, metrics on both parts."""
    labelled = prepared.where(F.col(K.TARGET).isNotNull())
    parts = sampling.stratified_holdout(labelled, K.CLIENT_KEY, K.TARGET, holdout)
    # the split is a predicate on the stored wide table, not a copy of it
    parts = parts.select(K.CLIENT_KEY, K.TARGET, "part", *features)
    if kind in STOPS_EARLY:
        marked = parts.withColumn("_valid", F.col("part") == "valid")
        scorer = TRAINERS[kind](marked, features, validation="_valid", **overrides)
    else:
        scorer = TRAINERS[kind](parts.where("part = 'train'"), features, **overrides)
    scored = scorer.with_probability(parts).select(
        K.CLIENT_KEY, K.TARGET, "part", F.col("probability").alias("proba")
    )
    scored = materialize(scored, "scores")
    valid = scored.where("part = 'valid'")
    best = E.optimal_threshold(E.threshold_curve(valid)).first()
    threshold = float(best["threshold"])
    valid_metrics = E.all_metrics(valid, threshold).first().asDict()
    train_metrics = E.all_metrics(scored.where("part = 'train'"), threshold).first().asDict()
    config = {
        "optimal_threshold": threshold,
        "cost_fn": K.COST_FN,
        "cost_fp": K.COST_FP,
        "model_name": name,
        "n_features": len(features),
        "best_iteration": scorer.rounds,
        "metrics": {k: valid_metrics[k] for k in ("auc", "accuracy", "business_cost")},
    }
    return TrainingResult(scorer, threshold, train_metrics, valid_metrics, config, valid)


def cross_validate(
    prepared: DataFrame, features: list[str], kind: str = "boosted", k: int = 5, **overrides
) -> DataFrame:
    """Per fold: AUC, accuracy, cost and best threshold of a model fitted on the other folds.

    Boosted fits stop early on the fold that is left out. A fit is many short jobs, so
    ``FOLDS_AT_ONCE`` of them run at the same time over one stored table.
    """
    spark = prepared.sparkSession
    ensure_checkpoint_dir(spark)
    labelled = prepared.where(F.col(K.TARGET).isNotNull())
    folded = sampling.stratified_folds(labelled, K.CLIENT_KEY, K.TARGET, k)
    folded = materialize(folded.select(K.CLIENT_KEY, K.TARGET, "fold", *features), "folds")

    def held_out(fold: int) -> DataFrame:
        if kind in STOPS_EARLY:
            marked = folded.withColumn("_valid", F.col("fold") == fold)
            scorer = TRAINERS[kind](marked, features, validation="_valid", **overrides)
        else:
            scorer = TRAINERS[kind](folded.where(F.col("fold") != fold), features, **overrides)
        return scorer.with_probability(folded.where(F.col("fold") == fold)).select(
            K.CLIENT_KEY, K.TARGET, "fold", F.col("probability").alias("proba")
        )

    with ThreadPoolExecutor(min(k, FOLDS_AT_ONCE)) as pool:  # one model per fold
        parts = list(pool.map(inheritable_thread_target(spark)(held_out), range(k)))
    return E.fold_metrics(materialize(reduce(DataFrame.unionByName, parts), "fold-scores"))


def save_scorer(spark, scorer: VectorScorer | LeafwiseScorer, path: str) -> None:
    """Fitted classifier and the order of its features."""
    kept = {"kind": type(scorer.model).__name__, "features": scorer.features}
    if isinstance(scorer, LeafwiseScorer):
        save_trees(spark, scorer, f"{path}/model")
        kept["base"] = scorer.model.base
    else:
        scorer.model.write().overwrite().save(f"{path}/model")
    text = json.dumps(kept)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(f"{path}/features")


MODEL_CLASSES = {
    "GBTClassificationModel": GBTClassificationModel,
    "LogisticRegressionModel": LogisticRegressionModel,
}


def load_scorer(spark, path: str) -> VectorScorer | LeafwiseScorer:
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/features").collect())
    kept = json.loads(text)
    if kept["kind"] == "BoostedTrees":
        return load_trees(spark, f"{path}/model", kept["base"], kept["features"])
    return VectorScorer(MODEL_CLASSES[kept["kind"]].load(f"{path}/model"), kept["features"])


def model_card(spark, config: dict, features: list[str], trained_on: str | None = None) -> DataFrame:
    """One row describing a model: name, threshold, costs, features, metrics, date."""
    metrics = {k: float(v) for k, v in config.get("metrics", {}).items()}
    row = (
        config.get("model_name", "credit_default_model"),
        str(config.get("model_version", "1.0.0")),
        float(config.get("optimal_threshold", K.BATCH_FALLBACK_THRESHOLD)),
        float(config.get("cost_fn", K.COST_FN)),
        float(config.get("cost_fp", K.COST_FP)),
        len(features),
        list(features),
        metrics,
        trained_on or config.get("training_date"),
    )
    return spark.createDataFrame(
        [row],
        "model_name string, model_version string, threshold double, cost_fn double, cost_fp double,"
        " n_features int, features array<string>, metrics map<string,double>, training_date string",
    )
