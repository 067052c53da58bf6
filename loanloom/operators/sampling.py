"""Repeatable samples and splits.

Rows are ordered by a hash of their key. The n rows with the smallest hashes
are found by comparing with a cut-off, so taking a sample needs no shuffle of
the rows themselves: one small count per hash bucket locates the bucket the
cut-off lies in, and only that bucket's keys are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_HEX_DIGITS = 3  # 16^3 = 4096 hash buckets


def key_hash(key: str, seed: int = 42) -> Column:
    """Hex digest that orders rows independently of their position."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))


def _order(key: str, seed: int) -> Column:
    return F.struct(key_hash(key, seed).alias("h"), F.col(key).alias("k"))


def hash_cutoffs(
    df: DataFrame, key: str, ranks: Column, strata: list[str], seed: int = 42
) -> DataFrame:
    """Per stratum, the hash order value at each of the wanted ranks.

    ``ranks`` is an array of 1-based ranks computed from ``n``, the rows of
    the stratum. Gives one row per stratum with ``cuts``, an array of
    (digest, key) in rank order; a rank of 0 or beyond ``n`` has no entry. The
    rows of a repeated key always fall on the same side of a cut-off.
    """
    bucket = F.substring(key_hash(key, seed), 1, BUCKET_HEX_DIGITS)
    keyed = df.select(*strata, key, bucket.alias("bucket"))
    counts = keyed.groupBy(*strata, "bucket").agg(F.count(F.lit(1)).alias("rows"))
    # at most 4096 rows per stratum from here on
    upto = W.partitionBy(*strata).orderBy("bucket")
    placed = counts.select(
        *strata,
        "bucket",
        F.sum("rows").over(upto).alias("last"),
        (F.sum("rows").over(upto) - F.col("rows")).alias("before"),
        F.sum("rows").over(W.partitionBy(*strata)).alias("n"),
    )
    wanted = placed.withColumn("rank", F.explode(F.array_distinct(ranks))).where(
        (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("last"))
    )
    # one bucket per (stratum, rank): keys / 4096 on average
    buckets = wanted.groupBy(*strata, "bucket").agg(
        F.collect_list("rank").alias("ranks"), F.max("before").alias("before")
    )
    buckets = buckets.select(
        *[F.col(c).alias(f"_s_{c}") for c in strata],
        F.col("bucket").alias("_s_bucket"),
        "ranks",
        "before",
    )
    same = [F.col("bucket") == F.col("_s_bucket")]
    same += [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in strata]
    inside = keyed.join(F.broadcast(buckets), same, "inner")
    # a key that occurs often is one row from here on
    per_key = inside.groupBy(*strata, "bucket", key).agg(
        F.count(F.lit(1)).alias("rows"), F.max("before").alias("before"), F.first("ranks").alias("ranks")
    )
    upto_key = W.partitionBy(*strata, "bucket").orderBy(_order(key, seed))
    upto_key = upto_key.rowsBetween(W.unboundedPreceding, W.currentRow)
    at_cut = (
        per_key.withColumn("last", F.col("before") + F.sum("rows").over(upto_key))
        .select("*", F.explode("ranks").alias("rank"))
        .where((F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("rows")))
        .select(*strata, "rank", _order(key, seed).alias("cut"))
    )
    return at_cut.groupBy(*strata).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "cut"))), lambda x: x["cut"]
        ).alias("cuts")
    )


def with_segments(
    df: DataFrame, key: str, ranks: Column, strata: list[str], seed: int
) -> DataFrame:
    """Adds ``segment``: how many cut-offs lie before the row in hash order.

    NULL in a stratum that has no cut-off at all.
    """
    cuts = hash_cutoffs(df, key, ranks, strata, seed)
    if strata:
        cuts = cuts.select(*[F.col(c).alias(f"_s_{c}") for c in strata], "cuts")
        same = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in strata]
        joined = df.join(F.broadcast(cuts), same, "left").drop(*[f"_s_{c}" for c in strata])
    else:
        joined = df.withColumn("cuts", cuts.select("cuts").scalar())
    below = F.size(F.filter(F.col("cuts"), lambda c: c < _order(key, seed)))
    segment = F.when(F.size("cuts") > 0, below)
    return joined.withColumn("segment", segment).drop("cuts")


def _share(fraction: float) -> Column:
    return F.array(F.bround(F.col("n") * F.lit(float(fraction)), 0).cast("bigint"))


def sample_fraction(
    df: DataFrame, key: str, fraction: float, seed: int = 42, strata: list[str] | None = None
) -> DataFrame:
    """Exactly round(fraction * n) rows (of each stratum), the same ones on every run."""
    placed = with_segments(df, key, _share(fraction), strata or [], seed)
    return placed.where(F.col("segment") == 0).drop("segment")


def sample_cut(
    df: DataFrame, key: str, fraction: float, seed: int = 42, strata: list[str] | None = None
) -> Column:
    """The largest cut-off of :func:`sample_fraction`, to pre-filter other tables with."""
    cuts = hash_cutoffs(df, key, _share(fraction), strata or [], seed)
    return cuts.select(F.max(F.try_element_at("cuts", F.lit(1))).alias("cut")).scalar()


def keys_up_to(key: str, cut: Column, seed: int = 42) -> Column:
    """Predicate for any table with the key: can the key be in the sample?"""
    return _order(key, seed) <= cut


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A random cap of n rows (n is a constant of the report, kept per task)."""
    return df.orderBy(key_hash(key, seed), key).limit(n)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Approximate sample without any counting."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def stratified_holdout(
    df: DataFrame, key: str, label: str, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``part``: 'valid' for round(fraction * n) rows of each class, else 'train'."""
    placed = with_segments(df, key, _share(fraction), [label], seed)
    part = F.when(F.col("segment") == 0, "valid").otherwise("train")
    return placed.withColumn("part", part).drop("segment")


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Adds ``fold`` in 0..k-1; every class is spread evenly over the folds."""
    ranks = F.array(*[F.floor(F.col("n") * F.lit(i) / F.lit(k)) for i in range(1, k)])
    placed = with_segments(df, key, ranks, [label], seed)
    fold = F.coalesce(F.col("segment"), F.lit(0)).cast("int")
    return placed.withColumn("fold", fold).drop("segment")
