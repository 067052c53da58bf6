"""A stored order of a population, searched by later clients without reading the population again.

The index holds one row per distinct value of a feature with the rows below and up to it, cut into equi-depth buckets,
and one row per feature with the bucket bounds, the rows below each bucket and the usual statistics. It is extended by
merging counts, so rows that came later are counted once and earlier ones are not read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.ordered import add_bucket, bucket_count, running_totals, sketch_bounds
from loanloom.operators.skew import SHARES, lookup_join
from loanloom.session import materialize

VALUES = "value double, n long, n_below long, n_upto long, bucket int, feature string"
FEATURES = "feature string, n_all long, mean double, median double, bounds array<double>, bases array<long>"
LEAST_SHARE = 1 << 16  # asked values that one task takes in any case


@dataclass
class RankIndex:
    """An index below a path; open one with :func:`open_index`."""

    spark: SparkSession
    path: str
    features: list[str]
    buckets: int

    def values(self, features: list[str] | None = None) -> DataFrame:
        """Distinct values with their counts; only the folders of the wanted features are read."""
        rows = self.spark.read.schema(VALUES).parquet(f"{self.path}/values")
        return rows if features is None else rows.where(F.col("feature").isin(features))

    def summary(self) -> DataFrame:
        """One row per feature: rows, mean, median, bucket bounds, rows below each bucket.

        A feature without values has 0 rows and nothing else.
        """
        return self.spark.read.schema(FEATURES).parquet(f"{self.path}/features")

    def extend(self, more: DataFrame, path: str) -> RankIndex:
        """A new index that also counts further rows; the rows behind this one are not read."""
        counts = self.values().select("feature", "value", "n").unionByName(_counts(more, self.features))
        return _write(counts.groupBy("feature", "value").agg(F.sum("n").alias("n")), self.features, path)

    def positions(
        self, asked: DataFrame, features: list[str] | None = None, least_share: int = LEAST_SHARE
    ) -> DataFrame:
        """Share of the population strictly below each asked value: feature, value, asks, percentile.

        Values need not occur in the population. Only buckets with an asked value are read on; a bucket
        with many asked values is copied to several tasks, which share these.
        A feature without values in the population gives no row.
        """
        features = self._known(features)
        asks = S.to_long(asked, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("asks"))
        # one row per feature, each with one bound per bucket
        info = F.broadcast(self.summary().where("n_all > 0").select("feature", "n_all", "bounds", "bases"))
        placed = add_bucket(asks.join(info, "feature"), "value", "bounds", self.buckets)
        placed = placed.withColumn("base", F.get("bases", F.col("bucket"))).drop("bases")
        load = placed.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("load"))
        parts = SHARES * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        share = F.greatest(F.lit(least_share), load.select(F.ceil(F.sum("load") / parts)).scalar())
        salts = load.select("feature", "bucket", F.ceil(F.col("load") / share).cast("int").alias("_salts"))
        # at most as many rows as the index has buckets
        index = self.values(features).join(salts, ["feature", "bucket"])
        index = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        salt = F.pmod(F.xxhash64("value"), F.col("_salts")).cast("int")
        wanted = placed.join(salts, ["feature", "bucket"]).withColumn("_salt", salt)
        both = wanted.drop("_salts").withColumns({"n_upto": F.lit(None).cast("long"), "stored": F.lit(1)})
        both = both.unionByName(
            index.select("feature", "bucket", "_salt", "value", "n_upto", F.lit(2).alias("stored")),
            allowMissingColumns=True,
        )
        # an asked value comes before the equal stored one, so what precedes it is strictly below
        upto = W.partitionBy("feature", "bucket", "_salt").orderBy("value", "stored")
        below = F.last("n_upto", ignorenulls=True).over(upto.rowsBetween(W.unboundedPreceding, W.currentRow))
        found = both.withColumn("below", F.coalesce(below, "base")).where(F.col("stored") == 1)
        percentile = G.safe_div(F.col("below"), F.col("n_all")) * 100
        return found.select("feature", "value", "asks", percentile.alias("percentile"))

    def compare(self, clients: DataFrame, features: list[str] | None = None, key: str = K.CLIENT_KEY) -> DataFrame:
        """Per client and feature: value, percentile, population mean and median."""
        features = self._known(features)
        placed = lookup_join(
            S.to_long(clients, features, [key]), self.positions(clients, features), ["feature", "value"], "asks"
        )
        # one row per feature
        typical = F.broadcast(self.summary().where("n_all > 0").select("feature", "mean", "median"))
        return placed.join(typical, "feature").select(key, "feature", "value", "percentile", "mean", "median")

    def quantiles(self, probabilities: list[float], features: list[str] | None = None) -> DataFrame:
        """Interpolated quantiles, read off the stored ranks: feature, probability, value."""
        rows = self.values(self._known(features))
        points = self.summary().where("n_all > 0").select(
            "feature", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability"),
            (F.col("probability") * (F.col("n_all") - 1)).alias("spot"),
        )
        spot = F.col("spot")
        held = (F.col("n_below") <= F.ceil(spot)) & (F.floor(spot) < F.col("n_upto"))
        # as many rows as features and probabilities
        near = rows.join(F.broadcast(points), "feature").where(held)
        found = near.groupBy("feature", "probability").agg(
            F.min("value").alias("low"), F.max("value").alias("high"), F.max(spot - F.floor(spot)).alias("part")
        )
        value = F.col("low") + (F.col("high") - F.col("low")) * F.col("part")
        return found.select("feature", "probability", value.alias("value"))

    def _known(self, features: list[str] | None) -> list[str]:
        absent = sorted(set(features or []) - set(self.features))
        if absent:
            raise ValueError(f"the index has no feature {absent}")
        return list(features) if features else self.features


def build_index(population: DataFrame, features: list[str], path: str) -> RankIndex:
    """Count and order a population's values and store them below ``path``."""
    return _write(_counts(population, features), features, path)


def open_index(spark: SparkSession, path: str) -> RankIndex:
    """An index written before."""
    rows = spark.read.schema(FEATURES).parquet(f"{path}/features")
    # one row per feature
    found = rows.select("feature", F.size("bases").alias("buckets")).orderBy("feature").collect()
    return RankIndex(spark, path, [r["feature"] for r in found], max(r["buckets"] or 1 for r in found))


def _counts(df: DataFrame, features: list[str]) -> DataFrame:
    return S.to_long(df, features).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _write(counts: DataFrame, features: list[str], path: str) -> RankIndex:
    spark, buckets = counts.sparkSession, bucket_count(counts)
    ranked = materialize(running_totals(counts, ["feature"], "value", ["n"]), "ranked-values")
    middle = (F.col("n_all") - 1) / 2

    def value_at(rank):
        return F.max(F.when((F.col("n_below") <= rank) & (rank < F.col("n_upto")), F.col("value")))

    stats = ranked.groupBy("feature").agg(
        F.max("n_all").alias("n_all"),
        (F.sum(F.col("value") * F.col("n")) / F.max("n_all")).alias("mean"),
        ((value_at(F.floor(middle)) + value_at(F.ceil(middle))) / 2).alias("median"),
        sketch_bounds(F.col("value"), buckets).alias("bounds"),
    )
    # one row per feature
    stats = materialize(stats.coalesce(1), "feature-stats")
    bounds = F.broadcast(stats.select("feature", "bounds"))
    placed = add_bucket(ranked.join(bounds, "feature"), "value", "bounds", buckets)
    rows = placed.select("value", "n", "n_below", "n_upto", "bucket", "feature")
    # ranges of (feature, bucket): few files per feature, row groups that a bucket can skip
    rows = rows.repartitionByRange("feature", "bucket").sortWithinPartitions("feature", "bucket", "value")
    rows.write.mode("errorifexists").partitionBy("feature").parquet(f"{path}/values")
    totals = spark.read.schema(VALUES).parquet(f"{path}/values").groupBy("feature", "bucket").agg(F.sum("n").alias("n"))
    grid = stats.select("feature", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    earlier = W.partitionBy("feature").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(earlier), F.lit(0))
    # one entry per bucket
    bases = grid.join(totals, ["feature", "bucket"], "left").select("feature", "bucket", base.alias("base"))
    bases = bases.groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("bucket", "base"))).alias("b"))
    info = stats.join(bases.select("feature", F.col("b.base").alias("bases")), "feature")
    every = spark.createDataFrame([(f,) for f in features], "feature string").join(info, "feature", "left")
    rows = F.coalesce("n_all", F.lit(0)).alias("n_all")
    every.select("feature", rows, "mean", "median", "bounds", "bases").coalesce(1).write.parquet(f"{path}/features")
    return open_index(spark, path)
