"""Score explanations: global importance, per-client contributions, fallback, normaliser."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.ranking import importance_ranking, top_contributions
from loanloom.operators.shapley import shapley_cells
from loanloom.plans.leafwise import LeafwiseScorer
from loanloom.plans.scoring import LinearScorer, VectorScorer

UP, DOWN = "augmente", "diminue"


def global_importance(spark, scorer: VectorScorer | LeafwiseScorer, top_n: int | None = None) -> DataFrame:
    """Importance of every model feature, ranked (one row per feature)."""
    values = scorer.model.featureImportances.toArray()
    rows = [(name, float(v)) for name, v in zip(scorer.features, values)]
    return importance_ranking(spark.createDataFrame(rows, "feature string, importance double"), top_n)


# ------------------------------------------------------------ linear contributions


def linear_cells(df: DataFrame, scorer: LinearScorer, reference: DataFrame) -> DataFrame:
    """Adds ``base_value`` and ``cells``: weight * (value - reference mean) per feature.

    base_value plus all contributions is the model's margin.
    """
    names = list(scorer.weights)
    means = reference.agg(*[F.avg(scorer.value(n)).alias(n) for n in names])
    joined = df.withColumn("_m", means.select(F.struct("*").alias("m")).scalar())

    def mean(n: str) -> Column:
        return F.col(f"_m.`{n}`")

    base = G.total(
        [F.lit(float(scorer.intercept)), *[mean(n) * F.lit(float(w)) for n, w in scorer.weights.items()]]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                scorer.value(n).alias("value"),
                ((scorer.value(n) - mean(n)) * F.lit(float(w))).alias("contribution"),
            )
            for n, w in scorer.weights.items()
        ]
    )
    return joined.withColumns({"base_value": base, "cells": cells}).drop("_m")


def _with_direction(rows: DataFrame) -> DataFrame:
    return rows.withColumn("direction", F.when(F.col("contribution") > 0, UP).otherwise(DOWN))


def explain_linear(
    df: DataFrame, scorer: LinearScorer, reference: DataFrame, key: str = K.CLIENT_KEY, n: int = 10
) -> DataFrame:
    """The n strongest contributions of every client."""
    cells = linear_cells(df, scorer, reference)
    return _with_direction(
        top_contributions(cells, key, F.col("cells"), n, keep=["base_value"])
    )


# -------------------------------------------------------------- tree contributions


def _flat_tree(tree) -> dict[str, np.ndarray]:
    """Nodes of one fitted regression tree as arrays in visiting order."""
    feature, threshold, left, right, value = [], [], [], [], []

    def visit(node) -> int:
        at = len(value)
        value.append(float(node.prediction()))
        inner = node.subtreeDepth() > 0
        feature.append(int(node.split().featureIndex()) if inner else -1)
        threshold.append(float(node.split().threshold()) if inner else 0.0)
        left.append(at)
        right.append(at)
        if inner:
            left[at] = visit(node.leftChild())
            right[at] = visit(node.rightChild())
        return at

    visit(tree._call_java("rootNode"))
    return {
        "feature": np.array(feature),
        "threshold": np.array(threshold),
        "left": np.array(left),
        "right": np.array(right),
        "value": np.array(value),
    }


def tree_cells(df: DataFrame, scorer: VectorScorer, key: str = K.CLIENT_KEY) -> DataFrame:
    """``key, base_value, margin, cells`` of a boosted-tree model.

    Each split on a row's path credits its feature with the change of the
    node's mean; base_value plus all contributions is the ensemble's margin.
    The trees (bounded by the model's settings) travel to the tasks once per
    batch; rows stay where they are.
    """
    names = scorer.features
    trees = [(w, _flat_tree(t)) for w, t in zip(scorer.model.treeWeights, scorer.model.trees)]
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.vstack(pdf["_x"].to_numpy()) if len(pdf) else np.empty((0, len(names)))
            rows = np.arange(len(x))
            parts = np.zeros((len(x), len(names)))
            base = 0.0
            for weight, t in shared.value:
                base += weight * t["value"][0]
                at = np.zeros(len(x), dtype=int)
                while True:
                    split = t["feature"][at]
                    inner = split >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.maximum(split, 0)] <= t["threshold"][at]
                    after = np.where(inner, np.where(go_left, t["left"][at], t["right"][at]), at)
                    change = weight * (t["value"][after] - t["value"][at])
                    np.add.at(parts, (rows[inner], split[inner]), change[inner])
                    at = after
            yield pd.DataFrame(
                {
                    key: pdf[key],
                    "_x": list(x),
                    "base_value": base,
                    "margin": base + parts.sum(axis=1),
                    "_parts": list(parts),
                }
            )

    inputs = df.select(key, F.array(*[S.quoted(n).cast("double") for n in names]).alias("_x"))
    kind = inputs.schema[key].dataType.simpleString()
    out = inputs.mapInPandas(
        attribute,
        f"{key} {kind}, _x array<double>, base_value double, margin double, _parts array<double>",
    )
    feature_names = F.array(*[F.lit(n) for n in names])
    cells = F.zip_with(
        F.arrays_zip(feature_names.alias("feature"), F.col("_x").alias("value")),
        F.col("_parts"),
        lambda a, c: F.struct(
            a["feature"].alias("feature"), a["value"].alias("value"), c.alias("contribution")
        ),
    )
    return out.select(key, "base_value", "margin", cells.alias("cells"))


def explain_trees(
    df: DataFrame, scorer: VectorScorer | LeafwiseScorer, key: str = K.CLIENT_KEY, n: int = 10
) -> DataFrame:
    """The n strongest contributions: Shapley values of leaf-wise trees, node-mean changes of others."""
    exact = isinstance(scorer, LeafwiseScorer)
    cells = shapley_cells(df, scorer, key) if exact else tree_cells(df, scorer, key)
    return _with_direction(
        top_contributions(cells, key, F.col("cells"), n, keep=["base_value"])
    )


# ------------------------------------------------------------- summary and fallback


def contribution_summary(cells: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature."""
    long = cells.select(F.explode("cells").alias("c")).select("c.feature", "c.contribution")
    return long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def fallback_explanation(
    df: DataFrame,
    importance: DataFrame,
    features: list[str],
    key: str = K.CLIENT_KEY,
    n: int = 10,
    digits: int | None = 4,
) -> DataFrame:
    """Globally important features with the client's own values.

    The direction only follows the value's sign; a missing value counts as 0.
    """

    def shown(value: Column) -> Column:
        return value if digits is None else F.bround(value, digits)

    top = importance_ranking(importance.where(F.col("feature").isin(features)), n)
    long = S.to_long(df, features, [key], "coalesce(CAST({0} AS DOUBLE), 0D)")
    rows = long.join(F.broadcast(top.select("feature", "importance", "rank")), "feature")
    return rows.select(
        key,
        "rank",
        "feature",
        shown(F.col("value")).alias("value"),
        shown(G.dbl(F.col("importance"))).alias("contribution"),
        F.when(F.col("value") > 0, K.RAISES_RISK).otherwise(K.LOWERS_RISK).alias("direction"),
    )


# ------------------------------------------------------------------- normaliser

_ITEM = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in ("feature", "name", "value", "shap_value", "contribution", "shap", "direction")
    ]
)
_BODY = [
    T.StructField("probability", T.StringType()),
    T.StructField("decision", T.StringType()),
    T.StructField("base_value", T.StringType()),
    T.StructField("expected_value", T.StringType()),
    T.StructField("baseline", T.StringType()),
    T.StructField("shap_values", T.MapType(T.StringType(), T.StringType())),
    T.StructField("feature_values", T.MapType(T.StringType(), T.StringType())),
    T.StructField("values", T.MapType(T.StringType(), T.StringType())),
    T.StructField("contributions", T.ArrayType(_ITEM)),
    T.StructField("top_features", T.ArrayType(_ITEM)),
]
_NESTED = ["explanation", "shap", "shap_explanation", "local_explanation"]
PAYLOAD = T.StructType([*_BODY, *[T.StructField(n, T.StructType(_BODY)) for n in _NESTED]])


def _number(text: Column) -> Column:
    return G.finite(text.try_cast("double"))


def _direction_sign(direction: Column) -> Column:
    text = F.lower(direction)
    return (
        F.when(text.rlike("|".join(K.LOWERING_WORDS)), -1)
        .when(text.rlike("|".join(K.RAISING_WORDS)), 1)
        .otherwise(0)
    )


def _direction_of(impact: Column) -> Column:
    return (
        F.when(impact > 0, K.RAISES_RISK).when(impact < 0, K.LOWERS_RISK).otherwise(K.NEUTRAL_RISK)
    )


def normalize_explanations(df: DataFrame, body: str, key: str) -> DataFrame:
    """One shape for explanation payloads given as JSON text.

    Accepts a map of contributions, a ``contributions`` list or a
    ``top_features`` list, flat or nested one level. Non-finite entries are
    dropped, the sign follows the direction words, entries are sorted by size.
    """
    parsed = df.select(key, F.from_json(S.quoted(body), PAYLOAD).alias("p"))

    def pick(name: str) -> Column:
        """The first nested block decides; what it lacks comes from the outer level."""
        chosen = F.col(f"p.{name}")
        for block in reversed(_NESTED):
            inner = F.col(f"p.{block}")
            chosen = F.when(inner.isNotNull(), F.coalesce(inner[name], F.col(f"p.{name}"))).otherwise(chosen)
        return chosen

    flat = parsed.select(key, *[pick(f.name).alias(f.name) for f in _BODY])
    values = F.coalesce("feature_values", "values")

    def cell(feature: Column, value: Column, impact: Column, direction: Column) -> Column:
        return F.struct(
            feature.alias("feature"),
            value.alias("value"),
            impact.alias("impact"),
            direction.alias("direction"),
        )

    def from_entry(e: Column) -> Column:
        impact = _number(e["value"])
        return cell(e["key"], F.try_element_at(values, e["key"]), impact, _direction_of(impact))

    def from_item(raw: Column, item: Column) -> Column:
        # NULLIF: an empty name counts as no name
        feature = F.coalesce(F.nullif(item["feature"], F.lit("")), F.nullif(item["name"], F.lit("")))
        sign = _direction_sign(item["direction"])
        size = _number(raw)
        impact = F.when((sign != 0) & (size >= 0), size * sign).otherwise(size)
        direction = F.coalesce(F.nullif(item["direction"], F.lit("")), _direction_of(impact))
        return cell(feature, item["value"], impact, direction)

    by_map = F.transform(F.map_entries("shap_values"), from_entry)
    by_list = F.transform(
        "contributions",
        lambda i: from_item(F.coalesce(i["shap_value"], i["contribution"], i["shap"]), i),
    )
    by_top = F.transform("top_features", lambda i: from_item(i["contribution"], i))
    from_values = F.col("shap_values").isNotNull() | F.coalesce(
        F.exists("contributions", lambda i: i["shap_value"].isNotNull()), F.lit(False)
    )
    cells = F.filter(
        F.coalesce(by_map, by_list, by_top),
        lambda c: c["feature"].isNotNull() & c["impact"].isNotNull(),
    )

    def by_size(a: Column, b: Column) -> Column:
        gap = F.abs(b["impact"]) - F.abs(a["impact"])
        return F.when(gap > 0, 1).when(gap < 0, -1).otherwise(0)

    return flat.select(
        key,
        _number(F.col("probability")).alias("probability"),
        "decision",
        _number(F.coalesce("base_value", "expected_value", "baseline")).alias("base_value"),
        F.when(from_values, "Valeur SHAP").otherwise("Contribution").alias("impact_label"),
        F.coalesce(F.array_sort(cells, by_size), F.array().cast(
            "array<struct<feature:string,value:string,impact:double,direction:string>>"
        )).alias("contributions"),
    )


def explanation_rows(normalized: DataFrame, key: str) -> DataFrame:
    """One row per contribution of a normalised explanation.

    The outer form of explode: the plain one adds a "not empty" filter that is
    pushed down to the source and would parse every payload many times.
    """
    rows = normalized.select(
        key, "impact_label", "base_value", F.explode_outer("contributions").alias("c")
    )
    return rows.where(F.col("c").isNotNull()).select(key, "impact_label", "base_value", "c.*")
