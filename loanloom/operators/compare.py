"""One client, or every client, against a reference population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.ordered import quantiles, running_totals
from loanloom.operators.profile import category_counts
from loanloom.operators.skew import lookup_join
from loanloom.session import materialize


def comparison_group(df: DataFrame, group: str = "Tous les clients", label: str = K.TARGET) -> DataFrame:
    """All clients, or those of one class."""
    if group not in K.COMPARISON_GROUPS:
        raise ValueError(f"unknown comparison group: {group!r}")
    wanted = K.COMPARISON_GROUPS[group]
    return df if wanted is None else df.where(F.col(label) == wanted)


def without_outliers(
    df: DataFrame, column: str, q: float = 0.99, by: list[str] | None = None, positive: bool = False
) -> DataFrame:
    """Rows strictly below a quantile of the column, optionally only positive ones."""
    by = by or []
    if positive:
        df = df.where(S.quoted(column) > 0)
    cut = quantiles(df, [column], [q], by).drop("feature")
    name = cut.columns[-1]
    if not by:
        return df.where(S.quoted(column) < cut.select(name).scalar())
    cut = cut.select(*by, F.col(name).alias("_cut"))
    # one cut-off per class
    return df.join(F.broadcast(cut), by).where(S.quoted(column) < F.col("_cut")).drop("_cut")


def _ranked(population: DataFrame, asked: DataFrame, features: list[str]) -> DataFrame:
    """Running totals of the population and of the asked values, per (feature, value).

    Population and asked values are merged before counting, so one ordered
    pass answers for any number of clients and no client is compared with every row.
    """
    both = S.to_long(population, features).withColumns({"n": F.lit(1), "asks": F.lit(0)})
    both = both.unionByName(S.to_long(asked, features).withColumns({"n": F.lit(0), "asks": F.lit(1)}))
    counts = both.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum("asks").alias("asks"))
    return running_totals(counts, ["feature"], "value", ["n", "asks"])


def _positions(ranked: DataFrame) -> DataFrame:
    asked_for = (F.col("asks") > 0) & (F.col("asks_all") > 0)
    return ranked.where(asked_for & (F.col("n_all") > 0)).select(
        "feature",
        "value",
        "asks",
        (G.safe_div(F.col("n_below"), F.col("n_all")) * 100).alias("percentile"),
    )


def value_positions(population: DataFrame, asked: DataFrame, features: list[str]) -> DataFrame:
    """Share of the population strictly below each asked value, per feature.

    ``asked`` holds the client rows whose values are looked up.
    """
    return _positions(_ranked(population, asked, features))


def compare_clients(
    clients: DataFrame, population: DataFrame, features: list[str], key: str = K.CLIENT_KEY
) -> DataFrame:
    """Per client and feature: value, percentile, population mean and median.

    All three come from the same counts per value, which are written once.
    """
    ranked = materialize(_ranked(population, clients, features), "ranked-values")
    facts = S.to_long(clients, features, [key])
    placed = lookup_join(facts, _positions(ranked), ["feature", "value"], "asks")
    middle = (F.col("n_all") - 1) / 2

    def value_at(rank: Column) -> Column:
        holds = (F.col("n_below") <= rank) & (rank < F.col("n_upto"))
        return F.max(F.when(holds, F.col("value")))

    # one row per feature
    typical = (
        ranked.where("n > 0")
        .groupBy("feature")
        .agg(
            (F.sum(F.col("value") * F.col("n")) / F.max("n_all")).alias("mean"),
            ((value_at(F.floor(middle)) + value_at(F.ceil(middle))) / 2).alias("median"),
        )
    )
    return placed.join(F.broadcast(typical), "feature").select(
        key, "feature", "value", "percentile", "mean", "median"
    )


def quartile_text(percentile: Column) -> Column:
    return (
        F.when(percentile < 25, K.LOW_QUARTER_TEXT)
        .when(percentile > 75, K.HIGH_QUARTER_TEXT)
        .otherwise(K.MIDDLE_TEXT)
    )


def position_mark(feature: Column, percentile: Column) -> Column:
    """Good, average or alert; high is good for scores, low for ratios."""
    good = ((percentile > 50) & feature.contains("SOURCE")) | (
        (percentile < 50) & feature.contains("RATIO")
    )
    middle = (percentile > 25) & (percentile < 75)
    return F.when(good, K.GOOD_MARK).when(middle, K.AVERAGE_MARK).otherwise(K.ALERT_MARK)


def scaled_profile(
    clients: DataFrame,
    population: DataFrame,
    features: list[str],
    key: str = K.CLIENT_KEY,
    at_least: int = 3,
) -> DataFrame:
    """Client and population mean on a 0-1 scale per feature.

    Clients with fewer than ``at_least`` known values are left out. A
    constant feature sits at 0.5.
    """
    stats = population.agg(
        *[
            F.struct(
                F.min(S.quoted(c).cast("double")).alias("lo"),
                F.max(S.quoted(c).cast("double")).alias("hi"),
                F.avg(S.quoted(c).cast("double")).alias("mean"),
            ).alias(c)
            for c in features
        ]
    )
    known = clients.withColumn("_p", stats.select(F.struct("*").alias("p")).scalar())

    def scale(value: Column, c: str) -> Column:
        lo, hi = F.col(f"_p.`{c}`.lo"), F.col(f"_p.`{c}`.hi")
        spread = F.try_divide(value - lo, hi - lo)
        return F.when(hi > lo, spread).otherwise(F.lit(0.5))

    cells = F.array_compact(
        F.array(
            *[
                F.when(
                    S.quoted(c).isNotNull() & F.col(f"_p.`{c}`.lo").isNotNull(),
                    F.struct(
                        F.lit(c).alias("feature"),
                        scale(S.quoted(c).cast("double"), c).alias("client_scaled"),
                        scale(F.col(f"_p.`{c}`.mean"), c).alias("mean_scaled"),
                    ),
                )
                for c in features
            ]
        )
    )
    usable = G.total(
        [(S.quoted(c).isNotNull() & F.col(f"_p.`{c}`.lo").isNotNull()).cast("int") for c in features]
    )
    rows = known.where(usable >= at_least).select(key, F.explode_outer(cells).alias("cell"))
    return rows.where(F.col("cell").isNotNull()).select(key, "cell.*")


def compare_categories(
    clients: DataFrame,
    population: DataFrame,
    features: list[str],
    key: str = K.CLIENT_KEY,
    max_categories: int | None = None,
) -> DataFrame:
    """Per client and text feature: share of the client's value, the mode and its share.

    With ``max_categories`` (the chart takes ``MAX_CHART_CATEGORIES``) features
    with more distinct values are skipped.
    """
    counts = category_counts(population, features)
    most = F.min_by("value", F.struct(-F.col("rows"), F.col("value")))
    per_feature = counts.groupBy("feature").agg(
        F.sum("rows").alias("known"),
        F.count(F.lit(1)).alias("unique"),
        most.alias("mode"),
        F.max("rows").alias("mode_rows"),
    )
    if max_categories is not None:
        per_feature = per_feature.where(F.col("unique") <= max_categories)
    per_feature = per_feature.withColumn(
        "mode_pct", G.safe_div(F.col("mode_rows"), F.col("known")) * 100
    ).select("feature", "known", "mode", "mode_pct")
    facts = S.to_long(clients, features, [key], S.AS_TEXT).join(
        F.broadcast(per_feature), "feature"
    )
    if max_categories is not None:
        # at most max_categories rows per feature
        few = counts.join(F.broadcast(per_feature.select("feature")), "feature")
        placed = facts.join(F.broadcast(few), ["feature", "value"], "left")
    else:
        weighted = counts.withColumn("w", F.col("rows"))
        placed = lookup_join(facts, weighted, ["feature", "value"], "w")
    share = G.safe_div(F.coalesce(F.col("rows"), F.lit(0)), F.col("known")) * 100
    return placed.select(key, "feature", "value", share.alias("client_pct"), "mode", "mode_pct")
