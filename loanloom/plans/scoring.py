"""Batch scoring: features, preprocessing, probability, decision."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import decision as D
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.applicant import application_features


@dataclass
class LinearScorer:
    """Logistic model as a column expression; missing features take ``fills``."""

    intercept: float
    weights: dict[str, float]
    fills: dict[str, float] = field(default_factory=dict)

    def value(self, name: str, have: list[str] | None = None) -> Column:
        """A feature's value; the fill where it is NULL or the column is absent."""
        fill = F.lit(float(self.fills[name])) if name in self.fills else None
        if have is not None and name not in have and fill is not None:
            return fill
        col = S.quoted(name).cast("double")
        return col if fill is None else F.coalesce(col, fill)

    def margin(self, have: list[str] | None = None) -> Column:
        terms = [self.value(n, have) * F.lit(float(w)) for n, w in self.weights.items()]
        return G.total([F.lit(float(self.intercept)), *terms])

    def with_probability(self, df: DataFrame) -> DataFrame:
        proba = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin(df.columns)))
        return df.withColumn("probability", proba)

    @classmethod
    def from_model(cls, model, features: list[str]) -> LinearScorer:
        """From a fitted logistic regression over the named features."""
        weights = dict(zip(features, (float(w) for w in model.coefficients)))
        return cls(float(model.intercept), weights)


@dataclass
class VectorScorer:
    """Any fitted classifier over an assembled vector of the named features."""

    model: object
    features: list[str]
    rounds: int | None = None  # boosting rounds kept

    def assemble(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.features, outputCol="_features").transform(df)

    def with_probability(self, df: DataFrame) -> DataFrame:
        model = self.model.copy()
        model.setFeaturesCol("_features")
        model.setProbabilityCol("_probability")
        model.setRawPredictionCol("_raw")
        model.setPredictionCol("_prediction")
        scored = model.transform(self.assemble(df))
        proba = vector_to_array("_probability")[1]
        return scored.withColumn("probability", proba).drop(
            "_features", "_probability", "_raw", "_prediction"
        )


def decide(df: DataFrame, threshold: float, proba: str = "probability") -> DataFrame:
    """Class, decision, band and threshold; the class is taken before rounding."""
    p = F.col(proba)
    prediction = D.predicted(p, threshold)
    return df.withColumns(
        {
            "prediction": prediction,
            "decision": D.decision(prediction),
            "risk_category": D.risk_band(p),
            "threshold": F.lit(float(threshold)),
        }
    )


def score(
    df: DataFrame,
    scorer,
    threshold: float | None = None,
    preprocessor=None,
    config: dict | None = None,
    fallback: float = K.BATCH_FALLBACK_THRESHOLD,
    digits: int | None = 4,
) -> DataFrame:
    """Scored rows ``client_id, probability, prediction, decision, risk_category, threshold``.

    Derived columns are computed first, the fitted preprocessing (if any)
    aligns, encodes and fills. A stateless plan, usable on streams too.
    """
    rows = application_features(df)
    rows = preprocessor.transform(rows) if preprocessor is not None else rows
    used = D.resolve_threshold(threshold, config, fallback)
    scored = decide(scorer.with_probability(rows), used)
    shown = F.col("probability") if digits is None else F.bround("probability", digits)
    return scored.select(
        F.col(K.CLIENT_KEY).alias("client_id"),
        shown.alias("probability"),
        "prediction",
        "decision",
        "risk_category",
        "threshold",
    )


def decision_summary(scored: DataFrame) -> DataFrame:
    """Clients, accepted and refused counts and the refused share."""
    return scored.agg(
        F.count(F.lit(1)).alias("total_clients"),
        F.count_if(F.col("prediction") == 0).alias("accepted_count"),
        F.count_if(F.col("prediction") == 1).alias("refused_count"),
    ).withColumn(
        "refused_pct", G.safe_div(F.col("refused_count"), F.col("total_clients")) * 100
    )


def what_if(
    clients: DataFrame, scenarios: list[dict], scorer, key: str = K.CLIENT_KEY
) -> DataFrame:
    """Every client under every scenario: base and changed probability and the change.

    A scenario has a ``name``, additive changes (``deltas``) and replaced inputs
    (``values``) by column. The scenarios are unrolled inside the row;
    dependent ratios are recomputed for each of them.
    """
    names = [s["name"] for s in scenarios]
    changed = sorted({c for s in scenarios for c in [*s.get("deltas", {}), *s.get("values", {})]})

    def moved_value(column: str) -> Column:
        moves = G.double_array(s.get("deltas", {}).get(column, 0.0) for s in scenarios)
        fixed = F.array(
            *[F.lit(s.get("values", {}).get(column)).cast("double") for s in scenarios]
        )
        shifted = S.quoted(column).cast("double") + F.get(moves, F.col("_i"))
        return F.coalesce(F.get(fixed, F.col("_i")), shifted)

    base = scorer.with_probability(application_features(clients))
    base = base.select(*clients.columns, F.col("probability").alias("_base"))
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("_i"))
    moved = rows.withColumns({c: moved_value(c) for c in changed})
    scored = scorer.with_probability(application_features(moved))
    name = F.get(F.array(*[F.lit(n) for n in names]), F.col("_i"))
    return scored.select(
        key,
        name.alias("scenario"),
        F.col("_base").alias("base_probability"),
        "probability",
        (F.col("probability") - F.col("_base")).alias("delta"),
    )
