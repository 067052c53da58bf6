"""Whole jobs over a folder of loan tables; run with ``spark-submit`` or ``python -m loanloom``."""

from __future__ import annotations

import argparse
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.operators import drift as D
from loanloom.operators import evaluate as E
from loanloom.operators import explain as X
from loanloom.operators.profile import describe_all, table_summary
from loanloom.operators.reshape import check_threshold
from loanloom.plans import training as T
from loanloom.plans.preprocessor import ClientPreprocessorModel, prepare_train_test
from loanloom.plans.scoring import VectorScorer, decision_summary, score
from loanloom.plans.spine import build_spine
from loanloom.sources import readers as I
from loanloom.sources import sinks as O


def train_job(
    spark: SparkSession,
    data: str,
    out: str,
    kind: str = "leafwise",
    sample: float | None = None,
    supplementary: bool = True,
    **overrides,
) -> dict:
    """Tables to model: wide table, preprocessing, fit, threshold, reports, test predictions."""
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    spine = build_spine(I.read_loan_tables(spark, data), supplementary, sample)
    prepared, preprocessor = prepare_train_test(spine.table)
    features = preprocessor.feature_names
    done = T.train_and_evaluate(prepared, features, kind, **overrides)
    run_id = uuid.uuid4().hex
    config = {**done.config, "run_id": run_id, "training_date": started.strftime("%Y-%m-%d")}
    preprocessor.save(spark, f"{out}/preprocessor")
    T.save_scorer(spark, done.scorer, f"{out}/scorer")
    O.write_settings(spark, config, f"{out}/settings")
    if kind in T.STOPS_EARLY:
        importance = X.global_importance(spark, done.scorer)
        O.write_table(importance.select("feature", "importance"), f"{out}/importance", "csv")
    scored = done.scorer.with_probability(prepared).withColumnRenamed("probability", "proba")
    report = E.metrics_report(done.valid_scores.select(K.TARGET, "proba"))
    O.write_table(O.report_lines(report), f"{out}/report", "csv")
    test = scored.where("split = 'test'")
    O.write_table(O.predictions(test, done.threshold), f"{out}/test_predictions", "csv")
    O.write_table(O.submission(test), f"{out}/submission", "csv")
    metrics = {f"val_{k}": v for k, v in done.valid_metrics.items()}
    metrics |= {f"train_{k}": v for k, v in done.train_metrics.items()}
    metrics["optimal_threshold"] = done.threshold
    metrics["best_iteration"] = done.scorer.rounds
    params = {**K.BOOSTING, **overrides, "kind": kind, "n_features": len(features), "skipped": spine.skipped}
    O.append_run(spark, f"{out}/runs", run_id, started, params, metrics)
    return config


def load_model(spark: SparkSession, out: str) -> tuple[ClientPreprocessorModel, VectorScorer, dict]:
    """What a training run left behind."""
    return (
        ClientPreprocessorModel.load(spark, f"{out}/preprocessor"),
        T.load_scorer(spark, f"{out}/scorer"),
        O.read_settings(spark, f"{out}/settings"),
    )


def score_job(
    spark: SparkSession, model: str, clients: str, target: str, threshold: float | None = None
) -> DataFrame:
    """Score a file of clients with a trained model; gives the decision summary."""
    check_threshold(threshold)
    preprocessor, scorer, config = load_model(spark, model)
    rows = I.read_source(spark, clients)
    O.write_table(score(rows, scorer, threshold, preprocessor, config), target, "csv")
    return decision_summary(I.read_csv(spark, target, overrides={"prediction": "int"}))


def describe_job(spark: SparkSession, source: str | None, target: str, default: str | None = None) -> DataFrame:
    """Description of every column of a table; gives its size and class counts."""
    df = I.read_source(spark, I.resolve_source(spark, source, default))
    O.write_table(describe_all(df), target, "csv")
    return table_summary(df) if K.TARGET in df.columns else df.agg(F.count(F.lit(1)).alias("n_rows"))


def drift_job(spark: SparkSession, reference: str, current: str, target: str) -> DataFrame:
    """Drift tests between two tables; gives the alert row."""
    both = D.pair(I.read_source(spark, reference), I.read_source(spark, current))
    report = D.drift_report(both, *D.common_features(both))
    O.write_table(report, target)
    return D.drift_alert(spark.read.parquet(target))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loanloom")
    jobs = parser.add_subparsers(dest="job", required=True)
    train = jobs.add_parser("train", help="train on a folder of loan tables")
    train.add_argument("data")
    train.add_argument("out")
    train.add_argument("--kind", choices=sorted(T.TRAINERS), default="leafwise")
    train.add_argument("--sample", type=float)
    train.add_argument("--no-supplementary", action="store_true")
    scoring = jobs.add_parser("score", help="score a file of clients")
    scoring.add_argument("model")
    scoring.add_argument("clients")
    scoring.add_argument("target")
    scoring.add_argument("--threshold", type=float)
    describe = jobs.add_parser("describe", help="describe a table")
    describe.add_argument("source")
    describe.add_argument("target")
    drift = jobs.add_parser("drift", help="compare two tables")
    drift.add_argument("reference")
    drift.add_argument("current")
    drift.add_argument("target")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"loanloom-{args.job}").getOrCreate()
    if args.job == "train":
        print(train_job(spark, args.data, args.out, args.kind, args.sample, not args.no_supplementary))
    elif args.job == "score":
        score_job(spark, args.model, args.clients, args.target, args.threshold).show()
    elif args.job == "describe":
        describe_job(spark, args.source, args.target).show()
    else:
        drift_job(spark, args.reference, args.current, args.target).show()
