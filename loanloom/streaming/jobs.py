"""Streaming scoring, prediction log and decision monitor.

Each is a thin layer over the batch operators; state and progress live in the
checkpoint location, so a restarted query continues where it stopped.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.plans.scoring import score


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a parquet folder, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def score_stream(clients: DataFrame, scorer, threshold: float, preprocessor=None) -> DataFrame:
    """Scores of an application stream; the same stateless plan as in batch."""
    return score(clients, scorer, threshold, preprocessor)


def prediction_log(
    events: DataFrame, key: str, event_time: str = "ts", delay: str = "1 day"
) -> DataFrame:
    """Each prediction once, however often it is delivered within the delay."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def monitor_aggregates(predicted: DataFrame, event_time: str = "ts", window: str = "1 day") -> DataFrame:
    """Per window: rows, refusal rate, mean score and share of missing scores."""
    return (
        predicted.groupBy(F.window(event_time, window).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg("prediction").alias("refusal_rate"),
            F.avg("proba").alias("mean_score"),
            F.avg(F.col("proba").isNull().cast("int")).alias("null_rate"),
        )
        .select(F.col("w.start").alias("window_start"), "rows", "refusal_rate", "mean_score", "null_rate")
    )


def decision_monitor(
    predicted: DataFrame, event_time: str = "ts", window: str = "1 day", delay: str = "10 minutes"
) -> DataFrame:
    """:func:`monitor_aggregates` over a stream; a window is emitted once it is closed."""
    return monitor_aggregates(predicted.withWatermark(event_time, delay), event_time, window)


def monitor_alerts(
    windows: DataFrame,
    reference_rate: float,
    reference_score: float,
    tolerance: float = 0.1,
    reference_nulls: float = 0.0,
) -> DataFrame:
    """Windows whose refusal rate, mean score or share of missing scores left the tolerance around the reference.

    A window without any score has neither rate nor mean; its missing share alone decides. Windows that
    carry no ``null_rate`` are judged by the other two.
    """
    expected = {"refusal_rate": reference_rate, "mean_score": reference_score}
    if "null_rate" in windows.columns:
        expected["null_rate"] = reference_nulls
    far = [F.coalesce(F.abs(F.col(c) - value) > tolerance, F.lit(False)) for c, value in expected.items()]
    return windows.withColumn("alert", reduce(or_, far))
