"""Wording and bands derived from a default probability."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loanloom import constants as K


def resolve_threshold(
    override: float | None = None,
    config: dict | None = None,
    fallback: float = K.SINGLE_FALLBACK_THRESHOLD,
) -> float:
    """Explicit threshold, else the configured optimum, else the fallback."""
    if override is not None:
        return override
    if config is not None:
        return config.get("optimal_threshold", fallback)
    return fallback


def predicted(proba: Column, threshold: float) -> Column:
    return (proba >= F.lit(float(threshold))).cast("int")


def decision(prediction: Column) -> Column:
    return F.when(prediction == 1, K.REFUSED).otherwise(K.ACCEPTED)


def risk_band(proba: Column) -> Column:
    """Five bands, each including its lower edge."""
    band = F.when(proba < K.RISK_EDGES[0], K.RISK_LABELS[0])
    for edge, label in zip(K.RISK_EDGES[1:], K.RISK_LABELS[1:]):
        band = band.when(proba < edge, label)
    return band.when(proba.isNotNull(), K.RISK_LABELS[-1])


def risk_band_right_closed(proba: Column) -> Column:
    """Five bands over (0, 1], each including its upper edge; NULL outside."""
    edges = [*K.RISK_EDGES, 1.0]
    band = F.when(proba <= 0, F.lit(None).cast("string"))
    for edge, label in zip(edges, K.RISK_LABELS):
        band = band.when(proba <= edge, label)
    return band


def _percent(value: Column) -> Column:
    return F.format_string("%.1f%%", value * 100)


def interpretation(proba: Column, threshold: float, detailed: bool = False) -> Column:
    """Decision, confidence and explanation texts as a struct.

    The short form has two confidence levels on each side of the threshold,
    the detailed form three and the distance to the threshold.
    """
    cut = F.lit(float(threshold))
    granted = proba < cut
    texts = K.LONG_TEXTS if detailed else K.SHORT_TEXTS

    def level(high: Column, good: Column | None) -> Column:
        key = F.when(high, "high")
        return (key.when(good, "good") if good is not None else key).otherwise("mid")

    below = level(proba < cut * (0.3 if detailed else 0.5), proba < cut * 0.6 if detailed else None)
    above = level(proba > cut * 1.5, proba > cut * 1.2 if detailed else None)
    grade = F.when(granted, F.concat(F.lit("granted_"), below)).otherwise(
        F.concat(F.lit("refused_"), above)
    )
    explanation = F.lit(None).cast("string")
    for key, text in texts.items():
        explanation = F.when(grade == key, text).otherwise(explanation)
    confidence = (
        F.when(grade.endswith("high"), K.CONFIDENCE_HIGH)
        .when(grade.endswith("good"), K.CONFIDENCE_GOOD)
        .otherwise(K.CONFIDENCE_MID)
    )
    fields = [
        F.when(granted, K.GRANTED_WORD).otherwise(K.REFUSED).alias("decision"),
        confidence.alias("confidence"),
        explanation.alias("explanation"),
        _percent(proba).alias("probability_text"),
        _percent(cut).alias("threshold_text"),
    ]
    if detailed:
        gap = F.format_string("%.1f points", F.abs(proba - cut) * 100)
        fields.append(gap.alias("distance_text"))
    return F.struct(*fields)
