"""Ordering of feature tables (one row per feature, so bounded by the schema)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G


def importance_ranking(importance: DataFrame, top_n: int | None = None) -> DataFrame:
    """Position and share of the total by falling importance; ties by name."""
    by_importance = W.orderBy(F.desc("importance"), "feature")
    ranked = importance.select(
        "feature",
        "importance",
        F.row_number().over(by_importance).alias("rank"),
        (
            G.safe_div(F.col("importance"), F.sum("importance").over(W.partitionBy())) * 100
        ).alias("importance_pct"),
    )
    return ranked if top_n is None else ranked.where(F.col("rank") <= top_n)


def with_importance_rank(features: DataFrame, importance: DataFrame) -> DataFrame:
    """Attach each feature's rank; unknown features come last."""
    ranks = importance_ranking(importance).select("feature", F.col("rank").cast("bigint").alias("rank"))
    return features.join(F.broadcast(ranks), "feature", "left").withColumn(
        "rank", F.coalesce("rank", F.lit(10**9).cast("bigint"))
    )


def feature_category(feature: Column) -> Column:
    """Category of a feature from its name; the first matching pattern decides."""
    name = F.upper(feature)
    first, *others = K.CATEGORY_PATTERNS
    category = F.when(name.rlike(first[1]), first[0])
    for label, pattern in others:
        category = category.when(name.rlike(pattern), label)
    return category.otherwise(K.OTHER_CATEGORY)


def features_by_category(features: DataFrame, importance: DataFrame) -> DataFrame:
    """Features in display order: category, then importance, then name."""
    order = F.array_position(F.array(*[F.lit(c) for c in K.CATEGORY_ORDER]), F.col("category"))
    placed = (
        with_importance_rank(features, importance)
        .withColumn("category", feature_category(F.col("feature")))
        .withColumn("category_order", order.cast("bigint"))
    )
    display = W.orderBy("category_order", "rank", "feature")
    return placed.select(
        "category", "category_order", "feature", "rank", F.row_number().over(display).alias("position")
    )


def top_contributions(
    df: DataFrame, key: str, cells: Column, n: int = 10, keep: list[str] | None = None
) -> DataFrame:
    """The n cells of each row with the largest absolute contribution.

    ``cells`` is an array of structs with ``feature`` and ``contribution``.
    Sorting happens inside the row, so nothing is shuffled.
    """

    def order(a: Column, b: Column) -> Column:
        gap = F.abs(b["contribution"]) - F.abs(a["contribution"])
        by_name = F.when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
        return F.when(gap > 0, 1).when(gap < 0, -1).otherwise(by_name)

    best = F.slice(F.array_sort(cells, order), 1, n)
    kept = keep or []
    # the outer form: a plain explode would add a "not empty" filter that is
    # pushed down and sorts every array a second time
    rows = df.select(key, *kept, F.posexplode_outer(best).alias("pos", "cell"))
    return rows.where(F.col("pos").isNotNull()).select(
        key, *kept, (F.col("pos") + 1).alias("rank"), "cell.*"
    )
