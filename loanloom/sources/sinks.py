"""Writing predictions, submissions, importances, settings, reports and run records."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import decision as D


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def write_bucketed(df: DataFrame, table: str, path: str, key: str = K.CLIENT_KEY, buckets: int = 200) -> None:
    """A catalog table bucketed by a key: later aggregations and joins on it need no shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).saveAsTable(table)


def predictions(
    scored: DataFrame, threshold: float, proba: str = "proba", key: str = K.CLIENT_KEY, bands: bool = True
) -> DataFrame:
    """``key, TARGET_PROBA, TARGET_PRED`` and, if wanted, the right-closed risk band."""
    p = F.col(proba)
    columns = [key, p.alias("TARGET_PROBA"), D.predicted(p, threshold).alias("TARGET_PRED")]
    if bands:
        columns.append(D.risk_band_right_closed(p).alias("RISK_CATEGORY"))
    return scored.select(*columns)


def submission(scored: DataFrame, proba: str = "proba", key: str = K.CLIENT_KEY) -> DataFrame:
    """``key, TARGET`` with the probability as TARGET."""
    return scored.select(key, F.col(proba).alias(K.TARGET))


def read_first(spark: SparkSession, paths: list[str], schema: str) -> DataFrame | None:
    """The first of several csv locations that exists and has the expected columns."""
    for path in paths:
        try:
            header = spark.read.option("header", True).csv(path).columns
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        names = [part.split()[0] for part in schema.split(",")]
        if set(names) <= set(header):
            full = ", ".join(
                f"`{c}` {dict(p.split() for p in schema.split(',')).get(c, 'string')}" for c in header
            )
            return spark.read.option("header", True).schema(full).csv(path).select(*names)
    return None


def write_settings(spark: SparkSession, config: dict, path: str) -> None:
    """Threshold and metrics of a training as one JSON text."""
    text = json.dumps(config, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def report_lines(report: DataFrame) -> DataFrame:
    """Text lines of a two-row metrics report, in order."""
    title = F.when(F.col("setting") == "default", "SEUIL PAR DÉFAUT").otherwise("SEUIL OPTIMAL")
    lines = F.array(
        F.concat(title, F.format_string(" (%.2f)", "threshold")),
        F.format_string("  AUC:       %.4f", "auc"),
        F.format_string("  Accuracy:  %.4f", "accuracy"),
        F.format_string("  Precision: %.4f", "precision"),
        F.format_string("  Recall:    %.4f", "recall"),
        F.format_string("  F1-Score:  %.4f", "f1_score"),
        F.format_string("  TP: %,d | FP: %,d", "TP", "FP"),
        F.format_string("  FN: %,d | TN: %,d", "FN", "TN"),
        F.format_string("  Coût métier: %,.0f", "business_cost"),
        F.format_string("  Réduction du coût: %,.0f (%.1f%%)", "cost_reduction", "relative_reduction_pct"),
    )
    return (
        report.select("setting", F.posexplode(lines).alias("line", "text"))
        .orderBy("setting", "line")
        .select("setting", "line", "text")
    )


RUN_SCHEMA = "run_id string, started timestamp, params map<string,string>, metrics map<string,double>"


def append_run(spark: SparkSession, path: str, run_id: str, started, params: dict, metrics: dict) -> None:
    """One record per training run."""
    row = (
        run_id,
        started,
        {k: str(v) for k, v in params.items()},
        {k: float(v) for k, v in metrics.items() if v is not None},
    )
    spark.createDataFrame([row], RUN_SCHEMA).write.mode("append").parquet(path)


def last_runs(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    """The most recent runs with their headline metrics."""
    runs = spark.read.schema(RUN_SCHEMA).parquet(path)
    metric = lambda name: F.try_element_at("metrics", F.lit(name)).alias(name)
    return (
        runs.orderBy(F.desc("started"), "run_id")
        .limit(n)
        .select("run_id", "started", metric("val_auc"), metric("val_business_cost"), metric("optimal_threshold"))
    )
