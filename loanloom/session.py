"""Session set-up and the shared scratch location."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# where sessions of one machine keep intermediate data; clusters set their own
LOCAL_SCRATCH = "file:///tmp/checkpoints/loanloom"


def local_session(
    cpus: str = "*", app: str = "loanloom", memory: str = "8g", scratch: str = LOCAL_SCRATCH
) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", scratch)
        # the wide client table has ~250 columns; keep it inside generated code
        .config("spark.sql.codegen.maxFields", "400")
        # no call-site lookup for each of the thousands of column expressions
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``.

    Where that is unset, a folder below the warehouse, which all executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable; keeps a folder that is already set."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch folder and read it back.

    Used where several jobs follow on the same expensive plan: it is computed
    once, later jobs read only their columns, and nothing is lost with an
    executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
