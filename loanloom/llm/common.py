"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.session import scratch_path

# the white space of all contracts: space and the five ASCII controls
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """crc32(id as text) mod folds = fold; a null id counts as the empty text."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(key), F.lit(folds)) == fold


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """Write to the shared folder in buckets, so that grouping by ``column`` moves nothing.

    The table's name is only needed to read the buckets; the files stay, the name goes.
    """
    spark = df.sparkSession
    named = f"{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    df.write.bucketBy(shuffle_partitions(spark), column).option("path", path).saveAsTable(named)
    stored = spark.table(named)
    stored.schema  # resolved while the name exists
    spark.sql(f"DROP TABLE {named}")
    return stored
