"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition writes one run: the digests of its texts, sorted. In
each round FAN_IN neighbouring runs are merged into one, and a digest keeps the
smallest identifier and the number of its copies. A merge is an aggregation by
(run, digest): a run is spread over all tasks by digest, and a digest with a
third of all rows is one row per run before anything is shuffled. The answer
goes back down the same tree, so its rows meet the answer run by run.

Only DataFrame functions are used. Digests are SHA-256; every merge also
compares length and a second hash, so texts are only joined when all three agree.

Defined results: a null text is empty. Of rows that share text and identifier
exactly one stays. A null identifier is larger than any other; ``keep_id`` is
null only if no copy has an identifier. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import WHITE, fresh, text_of
from loanloom.session import materialize

FAN_IN = 8
KEY = ["digest", "n_bytes", "second"]


def _digested(docs: DataFrame, text: str) -> list:
    normal = F.regexp_replace(text_of(text), WHITE, " ")
    return [
        F.unhex(F.sha2(normal, 256)).alias("digest"),
        F.octet_length(normal).alias("n_bytes"),
        F.xxhash64(normal).alias("second"),
    ]


def sorted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One sorted run per input partition, written to the shared folder."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        *_digested(docs, text),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    return materialize(rows.sortWithinPartitions("digest", "doc_id"), "digest-runs")


def _up(runs: DataFrame) -> DataFrame:
    """One round: FAN_IN neighbouring runs become one."""
    return runs.groupBy(F.floor(F.col("run") / FAN_IN).cast("int").alias("run"), *KEY).agg(
        F.min("least").alias("least"), F.sum("copies").alias("copies")
    )


def _down(below: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    """Give each row of a level the answer of the run it was merged into."""
    above = answers.select(F.col("run").alias("parent"), *KEY, "least", "copies")
    rows = below.withColumn("parent", F.floor(F.col("run") / FAN_IN).cast("int"))
    return rows.join(above, ["parent", *KEY], how).drop("parent")


def mark_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    runs = sorted_runs(docs, doc_id, text)
    last = runs.agg(F.max("run")).first()[0] or 0
    me = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    levels = [_up(runs.select("run", *KEY, me.alias("least"), F.lit(1).cast("long").alias("copies")))]
    last //= FAN_IN
    while last > 0:
        levels.append(_up(levels[-1]))
        last //= FAN_IN
    # a text without copies is its own answer, so only groups travel down
    answers = levels[-1].where("copies > 1")
    for level in reversed(levels[:-1]):
        answers = _down(level.select("run", *KEY), answers, "inner")
    found = _down(runs, answers, "left")
    alone = F.col("copies").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("least.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_bytes",
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Stayers are found again by (identifier, digest); where a row is repeated
    with its identifier, one of the repetitions is taken.
    """
    marks = mark_duplicates(docs, doc_id, text)
    own_id, own_digest, ties = fresh(docs, "keeper_id", "keeper_digest", "keeper_rows")
    keepers = (
        marks.where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .groupBy(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_digest))
        .agg(F.count(F.lit(1)).alias(ties))
    )
    (digest,) = fresh(docs, "text_digest")
    normal = F.regexp_replace(text_of(text), WHITE, " ")
    joined = docs.withColumn(digest, F.sha2(normal, 256)).join(
        keepers,
        F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.col(digest) == F.col(own_digest)),
    )
    once = joined.where(F.col(ties) == 1)
    repeated = joined.where(F.col(ties) > 1).dropDuplicates([own_id, own_digest])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
