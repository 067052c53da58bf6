"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put in identifier order by a range exchange of (id, size, checksum)
only. Each range adds up its own bytes; the totals of the ranges, one row per
task, give every range its start, and a window inside the range does the rest.
The global prefix is cut at equal targets. Only DataFrame functions are used.

Law ``bytes``: a row belongs to the shard that holds the middle of its bytes,
so a shard misses its target by less than one row's size at either end.

Defined results: a null text has no bytes and size 1. Rows with equal
identifiers are ordered by checksum, size and place in the input; null identifiers come
first. An empty table gives no rows. Equal texts need not share a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.llm.common import shuffle_partitions, text_of
from loanloom.session import materialize


def byte_shards(
    docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(text_of(text)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text)).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["doc_id", "text_crc32", "size", "place"]
    # the exchange samples its input: keep that second pass away from the texts
    skinny = materialize(sized, "shard-sizes")
    ranges = skinny.repartitionByRange(shuffle_partitions(spark), *order)
    placed = materialize(ranges.withColumn("part", F.spark_partition_id()), "shard-ranges")

    # one row per range, so these windows see as many rows as there are tasks
    totals = placed.groupBy("part").agg(
        F.sum("size").alias("part_bytes"), F.count(F.lit(1)).alias("part_rows")
    )
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(W.partitionBy(F.lit(0))).alias("all_bytes"),
    )
    upto = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "part",
        (F.sum("size").over(upto) - F.col("size")).alias("before"),
        (F.row_number().over(upto) - 1).alias("index"),
    ).join(F.broadcast(starts), "part")
    cut = summed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"cast(({shards} * (2 * (bytes_before + before) + size)) div (2 * all_bytes) as int)").alias(
            "shard"
        ),
        (F.col("rows_before") + F.col("index")).alias("position"),
    )
    first = cut.groupBy("shard").agg(F.min("position").alias("first_position"))
    # one row per shard
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("first_position")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
