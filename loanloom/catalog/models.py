"""Sampling, ranking, preprocessing, scoring, training and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.catalog import sqltext as Q
from loanloom.catalog.base import r6, register, with_tables
from loanloom.catalog.features import (
    FEATURE_SELECT,
    SPINE_VIEWS,
    md5_rank,
    spine_columns,
    spine_ctes,
)
from loanloom.functions import decision as D
from loanloom.operators import evaluate as E
from loanloom.operators import explain as X
from loanloom.operators import ranking as R
from loanloom.operators import sampling
from loanloom.operators.applicant import application_features
from loanloom.operators.profile import column_stats
from loanloom.operators.sampling import stratified_holdout
from loanloom.operators.shapley import shapley_cells
from loanloom.plans import preprocessor as M
from loanloom.plans import training as T
from loanloom.plans.scoring import LinearScorer, decision_summary, score, what_if
from loanloom.plans.spine import build_spine
from loanloom.session import scratch_path

ID = K.CLIENT_KEY
TRAIN = "SELECT * FROM app WHERE split = 'train'"
NUM = [c for c in Q.APP_NUMERIC if c != "OWN_CAR_AGE"]

# ------------------------------------------------------------- sampling and splits


@register(
    "w5_sample_fraction",
    with_tables(
        "SELECT SK_ID_CURR FROM r WHERE rk <= round_even(n * 0.3, 0)",
        "app",
        r=f"SELECT SK_ID_CURR, {md5_rank(42)} AS rk, count(*) OVER () AS n FROM app",
    ),
)
def w5(t):
    return sampling.sample_fraction(t.app, ID, 0.3).select(ID)


@register(
    "w6_random_cap",
    with_tables(
        "SELECT SK_ID_CURR FROM r WHERE rk <= 1000",
        "app",
        r=f"SELECT SK_ID_CURR, {md5_rank(42)} AS rk FROM app",
    ),
)
def w6(t):
    return sampling.sample_rows(t.app, ID, 1000).select(ID)


_CLASS_RANK = f"SELECT SK_ID_CURR, TARGET, {md5_rank(42, 'TARGET')} AS rk, count(*) OVER (PARTITION BY TARGET) AS n FROM app WHERE TARGET IS NOT NULL"


@register(
    "w7_stratified_holdout",
    with_tables(
        "SELECT SK_ID_CURR, TARGET, CASE WHEN rk <= round_even(n * 0.2, 0) THEN 'valid' ELSE 'train' END AS part FROM r",
        "app",
        r=_CLASS_RANK,
    ),
)
def w7(t):
    return sampling.stratified_holdout(t.train.select(ID, K.TARGET), ID, K.TARGET, 0.2)


@register(
    "w8_stratified_folds",
    with_tables(
        """
SELECT SK_ID_CURR, TARGET, CAST((SELECT count(DISTINCT floor(n * CAST(i AS DOUBLE) / 5)) FROM range(1, 5) t(i)
  WHERE floor(n * CAST(i AS DOUBLE) / 5) < rk AND floor(n * CAST(i AS DOUBLE) / 5) > 0) AS INTEGER) AS fold FROM r""",
        "app",
        r=_CLASS_RANK,
    ),
)
def w8(t):
    return sampling.stratified_folds(t.train.select(ID, K.TARGET), ID, K.TARGET, 5)


# ------------------------------------------------------------------------- ranking

IMPORTANCE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS importance FROM feat" for c in [*Q.APP_NUMERIC, *Q.DERIVED]
)
RANKED = """
SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
  importance * 100.0 / sum(importance) OVER () AS pct FROM importance"""
_RANK_CTES = dict(feat=FEATURE_SELECT, importance=IMPORTANCE, ranked=RANKED)


def _importance(t):
    """Known values per feature, as an importance table computed from the data."""
    df = application_features(t.app)
    stats = column_stats(df, [*Q.APP_NUMERIC, *Q.DERIVED], {"importance": F.count})
    return stats.select("feature", "importance")


@register(
    "w1_importance_ranking",
    with_tables(
        f"SELECT feature, importance, CAST(rank AS INTEGER) AS rank, {r6('pct', 'importance_pct')} FROM ranked WHERE rank <= 20",
        "app",
        **_RANK_CTES,
    ),
)
def w1(t):
    return R.importance_ranking(_importance(t), 20)


@register(
    "j4_importance_lookup",
    with_tables(
        """
SELECT v.feature, coalesce(rank, CAST(1000000000 AS BIGINT)) AS rank FROM
(SELECT feature FROM importance UNION ALL SELECT 'BUREAU_DAYS_CREDIT_MAX') v LEFT JOIN ranked USING (feature)""",
        "app",
        **_RANK_CTES,
    ),
)
def j4(t):
    importance = _importance(t)
    unknown = t.app.agg(F.lit("BUREAU_DAYS_CREDIT_MAX").alias("feature"), F.count(F.lit(1)))
    features = importance.select("feature").unionByName(unknown.select("feature"))
    return R.with_importance_rank(features, importance)


_CATEGORY = "CASE " + " ".join(
    f"WHEN regexp_matches(feature, '{pattern}') THEN '{label}'" for label, pattern in K.CATEGORY_PATTERNS
) + f" ELSE '{K.OTHER_CATEGORY}' END"
_ORDER = "list_position([" + ", ".join(f"'{c}'" for c in K.CATEGORY_ORDER) + "], category)"


@register(
    "w3_features_by_category",
    with_tables(
        f"""
SELECT category, CAST({_ORDER} AS BIGINT) AS category_order, feature, rank,
  CAST(row_number() OVER (ORDER BY {_ORDER}, rank, feature) AS INTEGER) AS position
FROM (SELECT feature, rank, {_CATEGORY} AS category FROM ranked)""",
        "app",
        **_RANK_CTES,
    ),
)
def w3(t):
    importance = _importance(t)
    return R.features_by_category(importance.select("feature"), importance)


# ------------------------------------------------------------------- preprocessing


@register(
    "m1_class_codes",
    with_tables(
        """
SELECT feature, value, n AS rows, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS code FROM (
  SELECT feature, value, count(*) AS n FROM texts GROUP BY 1, 2)""",
        "app",
        train=TRAIN,
        texts=" UNION ALL ".join(
            f"SELECT '{c}' AS feature, coalesce({c}, 'MISSING') AS value FROM train" for c in Q.APP_STRING
        ),
    ),
)
def m1(t):
    return M.class_codes(t.train, Q.APP_STRING).select(
        "feature", "value", "rows", F.col("code").cast("bigint").alias("code")
    )


@register(
    "m1_encoded_columns",
    with_tables(
        "SELECT SK_ID_CURR, " + ", ".join(f"CAST(code_{i} AS DOUBLE) AS {c}" for i, c in enumerate(Q.APP_STRING))
        + " FROM app a " + " ".join(
            f"LEFT JOIN codes{i} ON coalesce(a.{c}, 'MISSING') = value_{i}" for i, c in enumerate(Q.APP_STRING)
        ),
        "app",
        train=TRAIN,
        **{
            f"codes{i}": f"SELECT value_{i}, row_number() OVER (ORDER BY value_{i}) - 1 AS code_{i} FROM (SELECT DISTINCT coalesce({c}, 'MISSING') AS value_{i} FROM train)"
            for i, c in enumerate(Q.APP_STRING)
        },
    ),
)
def m1_encoded(t):
    fitted = M.ClientPreprocessor().fit(t.train.select(ID, *Q.APP_STRING))
    return fitted.transform(t.app.select(ID, *Q.APP_STRING))


@register(
    "m1_encoded_by_join",
    with_tables(
        "SELECT SK_ID_CURR, CAST(code_0 AS DOUBLE) AS OCCUPATION_TYPE FROM app a LEFT JOIN codes0 ON coalesce(a.OCCUPATION_TYPE, 'MISSING') = value_0",
        "app",
        train=TRAIN,
        codes0="SELECT value_0, row_number() OVER (ORDER BY value_0) - 1 AS code_0 FROM (SELECT DISTINCT coalesce(OCCUPATION_TYPE, 'MISSING') AS value_0 FROM train)",
    ),
)
def m1_join(t):
    """One text column by itself."""
    fitted = M.ClientPreprocessor().fit(t.train.select(ID, "OCCUPATION_TYPE"))
    return fitted.transform(t.app.select(ID, "OCCUPATION_TYPE"))


def _filled_sql(fill) -> str:
    return with_tables(
        "SELECT SK_ID_CURR, " + ", ".join(r6(f"coalesce({c}, {fill(c)})", c) for c in NUM) + " FROM app",
        "app",
        train=TRAIN,
    )


def _filled(strategy: str):
    def build(t):
        fitted = M.ClientPreprocessor(impute=strategy).fit(t.train.select(ID, *NUM))
        return fitted.transform(t.app.select(ID, *NUM))

    return build


register("m2_impute_median", _filled_sql(lambda c: f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM train)"))(
    _filled("median")
)
register("m2_impute_mean", _filled_sql(lambda c: f"(SELECT avg({c}) FROM train)"))(_filled("mean"))
register(
    "m2_impute_most_frequent",
    _filled_sql(
        lambda c: f"(SELECT min_by(v, (-n, v)) FROM (SELECT CAST({c} AS DOUBLE) AS v, count(*) AS n FROM train WHERE {c} IS NOT NULL GROUP BY 1))"
    ),
)(_filled("most_frequent"))

_FILLED_TRAIN = "SELECT SK_ID_CURR, split, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM train)) AS {c}" for c in NUM
) + " FROM app"


@register(
    "m3_standardise",
    with_tables(
        "SELECT SK_ID_CURR, "
        + ", ".join(
            r6(
                f"({c} - (SELECT avg({c}) FROM filled WHERE split = 'train')) / coalesce(nullif((SELECT stddev_pop({c}) FROM filled WHERE split = 'train'), 0), 1)",
                c,
            )
            for c in NUM
        )
        + " FROM filled",
        "app",
        train=TRAIN,
        filled=_FILLED_TRAIN,
    ),
)
def m3(t):
    fitted = M.ClientPreprocessor(scale=True).fit(t.train.select(ID, *NUM))
    return fitted.transform(t.app.select(ID, *NUM))


_KEPT_SPINE = [
    n
    for n, _ in spine_columns()
    if n not in ("TARGET", "OWN_CAR_AGE") and not n.startswith(("POS_", "CC_"))
]
_CODE_CTES = {
    f"codes{i}": f"SELECT value_{i}, row_number() OVER (ORDER BY value_{i}) - 1 AS code_{i} FROM (SELECT DISTINCT coalesce({c}, 'MISSING') AS value_{i} FROM app WHERE split = 'train')"
    for i, c in enumerate(Q.APP_STRING)
}
_CODE_JOINS = " ".join(
    f"LEFT JOIN codes{i} ON coalesce({c}, 'MISSING') = value_{i}" for i, c in enumerate(Q.APP_STRING)
)
_MEDIANS = "SELECT " + ", ".join(
    f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS med_{i}" for i, c in enumerate(_KEPT_SPINE)
) + " FROM spine WHERE split = 'train'"


@register(
    "m6_prepared_spine",
    with_tables(
        "SELECT SK_ID_CURR, TARGET, split, "
        + ", ".join(f"CAST(code_{i} AS DOUBLE) AS {c}" for i, c in enumerate(Q.APP_STRING))
        + ", "
        + ", ".join(r6(f"coalesce({c}, med_{i})", c) for i, c in enumerate(_KEPT_SPINE))
        + f" FROM spine CROSS JOIN medians {_CODE_JOINS}",
        *SPINE_VIEWS,
        **spine_ctes(),
        medians=_MEDIANS,
        **_CODE_CTES,
    ),
)
def m6(t):
    prepared, _ = M.prepare_train_test(build_spine(t.loan_tables()).table)
    return prepared


@register(
    "m4_preprocessor_on_requests",
    with_tables(
        "SELECT SK_ID_CURR, CAST((SELECT quantile_cont(code_1, 0.5) FROM app JOIN codes1 ON coalesce(OCCUPATION_TYPE, 'MISSING') = value_1 WHERE split = 'train') AS DOUBLE) AS OCCUPATION_TYPE,"
        f" {r6('AMT_CREDIT', 'AMT_CREDIT')}, {r6('(SELECT quantile_cont(EXT_SOURCE_2, 0.5) FROM app WHERE split = ' + repr('train') + ')', 'EXT_SOURCE_2')} FROM app",
        "app",
        **_CODE_CTES,
    ),
)
def m4(t):
    """Request rows lack columns the fit had: they take the fitted fills."""
    fitted = M.ClientPreprocessor().fit(t.train.select(ID, "OCCUPATION_TYPE", "AMT_CREDIT", "EXT_SOURCE_2"))
    return fitted.transform(t.app.select(ID, "AMT_CREDIT"))


@register("m5_reloaded_preprocessor", _filled_sql(lambda c: f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM train)"))
def m5(t):
    fitted = M.ClientPreprocessor().fit(t.train.select(ID, *NUM))
    path = scratch_path(t.spark, "preprocessor")
    fitted.save(t.spark, path)
    return M.ClientPreprocessorModel.load(t.spark, path).transform(t.app.select(ID, *NUM))


# ------------------------------------------------------------------------- scoring

# Fixed coefficients of the scorer that SQL can recompute
SCORER = LinearScorer(
    intercept=-0.4,
    weights={
        "CREDIT_INCOME_RATIO": 0.05,
        "ANNUITY_INCOME_RATIO": 0.8,
        "EXT_SOURCE_MEAN": -2.5,
        "AGE_YEARS": -0.01,
        "EMPLOYED_YEARS": -0.02,
        "DOCUMENTS_COUNT": 0.3,
    },
    fills={
        "CREDIT_INCOME_RATIO": 3.0,
        "ANNUITY_INCOME_RATIO": 0.17,
        "EXT_SOURCE_MEAN": 0.5,
        "AGE_YEARS": 40.0,
        "EMPLOYED_YEARS": 5.0,
        "DOCUMENTS_COUNT": 1.0,
    },
)


def margin_sql(columns: dict[str, str] | None = None) -> str:
    terms = [str(SCORER.intercept)]
    for name, weight in SCORER.weights.items():
        col = (columns or {}).get(name, name)
        terms.append(f"CAST({weight} AS DOUBLE) * coalesce({col}, {SCORER.fills[name]})")
    return " + ".join(terms)


def proba_sql(columns: dict[str, str] | None = None) -> str:
    return f"1.0 / (1.0 + exp(-({margin_sql(columns)})))"


BAND = (
    "CASE WHEN p < 0.2 THEN 'Très faible' WHEN p < 0.4 THEN 'Faible' WHEN p < 0.6 THEN 'Modéré'"
    " WHEN p < 0.8 THEN 'Élevé' ELSE 'Très élevé' END"
)
SCORED_APP = f"SELECT *, {proba_sql()} AS p FROM feat"


def _scored_sql(threshold: float) -> str:
    return f"""
SELECT SK_ID_CURR AS client_id, {r6('p', 'probability')}, CASE WHEN p >= {threshold} THEN 1 ELSE 0 END AS prediction,
  CASE WHEN p >= {threshold} THEN '{K.REFUSED}' ELSE '{K.ACCEPTED}' END AS decision, {BAND} AS risk_category,
  CAST({threshold} AS DOUBLE) AS threshold FROM sc"""


@register(
    "m10_probability",
    with_tables(f"SELECT SK_ID_CURR, {r6('p', 'probability')} FROM sc", "app", feat=FEATURE_SELECT, sc=SCORED_APP),
)
def m10(t):
    return SCORER.with_probability(application_features(t.app)).select(ID, "probability")


@register(
    "m11_batch_scores",
    with_tables(_scored_sql(0.44).replace("CAST(0.44 AS DOUBLE)", r6("0.44", "x").split(" AS x")[0]), "app", feat=FEATURE_SELECT, sc=SCORED_APP),
)
def m11(t):
    return score(t.app, SCORER, 0.44, digits=None)


@register(
    "a27_decision_summary",
    with_tables(
        f"""
SELECT count(*) AS total_clients, count(*) FILTER (WHERE p < 0.44) AS accepted_count,
  count(*) FILTER (WHERE p >= 0.44) AS refused_count, {r6('count(*) FILTER (WHERE p >= 0.44) * 100.0 / count(*)', 'refused_pct')} FROM sc""",
        "app",
        feat=FEATURE_SELECT,
        sc=SCORED_APP,
    ),
)
def a27(t):
    return decision_summary(score(t.app, SCORER, 0.44))


@register(
    "p20_decisions",
    with_tables(
        f"""SELECT SK_ID_CURR, CASE WHEN proba >= 0.44 THEN 1 ELSE 0 END AS prediction,
CASE WHEN proba >= 0.44 THEN '{K.REFUSED}' ELSE '{K.ACCEPTED}' END AS decision FROM scored""",
        "scored",
    ),
)
def p20(t):
    used = D.resolve_threshold(None, {"optimal_threshold": 0.44})
    prediction = D.predicted(F.col("proba"), used)
    return t.scored.select(ID, prediction.alias("prediction"), D.decision(prediction).alias("decision"))


@register(
    "p21_risk_band",
    with_tables(f"SELECT SK_ID_CURR, {BAND.replace('p <', 'proba <')} AS band FROM scored", "scored"),
)
def p21(t):
    return t.scored.select(ID, D.risk_band(F.col("proba")).alias("band"))


@register(
    "p22_risk_band_right_closed",
    with_tables(
        """
SELECT SK_ID_CURR, CASE WHEN proba <= 0 OR proba > 1 THEN NULL WHEN proba <= 0.2 THEN 'Très faible' WHEN proba <= 0.4 THEN 'Faible'
  WHEN proba <= 0.6 THEN 'Modéré' WHEN proba <= 0.8 THEN 'Élevé' ELSE 'Très élevé' END AS band FROM scored""",
        "scored",
    ),
)
def p22(t):
    return t.scored.select(ID, D.risk_band_right_closed(F.col("proba")).alias("band"))


def _wording_sql(detailed: bool) -> str:
    texts = K.LONG_TEXTS if detailed else K.SHORT_TEXTS
    t = "CAST(0.44 AS DOUBLE)"
    if detailed:
        grade = f"""CASE WHEN proba < {t} THEN CASE WHEN proba < {t} * CAST(0.3 AS DOUBLE) THEN 'granted_high' WHEN proba < {t} * CAST(0.6 AS DOUBLE) THEN 'granted_good' ELSE 'granted_mid' END
  ELSE CASE WHEN proba > {t} * CAST(1.5 AS DOUBLE) THEN 'refused_high' WHEN proba > {t} * CAST(1.2 AS DOUBLE) THEN 'refused_good' ELSE 'refused_mid' END END"""
    else:
        grade = f"""CASE WHEN proba < {t} THEN CASE WHEN proba < {t} * CAST(0.5 AS DOUBLE) THEN 'granted_high' ELSE 'granted_mid' END
  ELSE CASE WHEN proba > {t} * CAST(1.5 AS DOUBLE) THEN 'refused_high' ELSE 'refused_mid' END END"""
    words = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items())
    gap = ", printf('%.1f points', abs(proba - 0.44) * 100) AS distance_text" if detailed else ""
    return with_tables(
        f"""
SELECT SK_ID_CURR, CASE WHEN grade LIKE 'granted%' THEN '{K.GRANTED_WORD}' ELSE '{K.REFUSED}' END AS decision,
  CASE WHEN grade LIKE '%high' THEN '{K.CONFIDENCE_HIGH}' WHEN grade LIKE '%good' THEN '{K.CONFIDENCE_GOOD}' ELSE '{K.CONFIDENCE_MID}' END AS confidence,
  CASE grade {words} END AS explanation, printf('%.1f%%', proba * 100) AS probability_text, printf('%.1f%%', {t} * 100) AS threshold_text{gap}
FROM (SELECT *, {grade} AS grade FROM scored)""",
        "scored",
    )


def _wording(detailed: bool):
    def build(t):
        words = D.interpretation(F.col("proba"), 0.44, detailed)
        return t.scored.select(ID, words.alias("w")).select(ID, "w.*")

    return build


register("p23_score_wording", _wording_sql(False))(_wording(False))
register("p23_score_wording_detailed", _wording_sql(True))(_wording(True))

SCENARIOS = [
    {"name": "higher income", "deltas": {"AMT_INCOME_TOTAL": 20000.0}},
    {"name": "smaller credit", "deltas": {"AMT_CREDIT": -30000.0}},
    {"name": "both", "deltas": {"AMT_INCOME_TOTAL": 20000.0, "AMT_CREDIT": -30000.0}},
]


@register(
    "p30_what_if",
    with_tables(
        f"""
SELECT SK_ID_CURR, scenario, {r6('p', 'base_probability')}, {r6('q', 'probability')}, {r6('q - p', 'delta')} FROM (
  SELECT *, {proba_sql({'CREDIT_INCOME_RATIO': '((AMT_CREDIT + dc) / (AMT_INCOME_TOTAL + di + 1))', 'ANNUITY_INCOME_RATIO': '(AMT_ANNUITY / (AMT_INCOME_TOTAL + di + 1))'})} AS q
  FROM sc, (VALUES ('higher income', 20000, 0), ('smaller credit', 0, -30000), ('both', 20000, -30000)) v(scenario, di, dc))""",
        "app",
        feat=FEATURE_SELECT,
        sc=SCORED_APP,
    ),
)
def p30(t):
    return what_if(t.app, SCENARIOS, SCORER)


@register(
    "j6_scores_by_key",
    with_tables(
        f"SELECT SK_ID_CURR, TARGET, {r6('p', 'probability')} FROM sc WHERE split = 'test'",
        "app",
        feat=FEATURE_SELECT,
        sc=SCORED_APP,
    ),
)
def j6(t):
    """The key travels with the row through scoring; nothing is matched by position."""
    rows = SCORER.with_probability(application_features(t.app.where("split = 'test'")))
    return rows.select(ID, K.TARGET, "probability")


# -------------------------------------------------------------------- explanations

_MEANS = "SELECT " + ", ".join(
    f"avg(coalesce({n}, {SCORER.fills[n]})) AS m_{n}" for n in SCORER.weights
) + " FROM feat WHERE split = 'train'"
_CELLS = " UNION ALL ".join(
    f"""SELECT SK_ID_CURR, '{n}' AS feature, CAST(coalesce({n}, {SCORER.fills[n]}) AS DOUBLE) AS value,
  (coalesce({n}, {SCORER.fills[n]}) - m_{n}) * CAST({w} AS DOUBLE) AS contribution FROM feat, means"""
    for n, w in SCORER.weights.items()
)
_BASE_VALUE = " + ".join(
    [str(SCORER.intercept)] + [f"m_{n} * CAST({w} AS DOUBLE)" for n, w in SCORER.weights.items()]
)
_EXPLAIN = dict(feat=FEATURE_SELECT, means=_MEANS, cells=_CELLS)


def _explained(t):
    df = application_features(t.app)
    return X.linear_cells(df, SCORER, df.where("split = 'train'"))


@register(
    "m13_linear_contributions",
    with_tables(
        f"""
SELECT SK_ID_CURR, feature, {r6('value', 'value')}, {r6('contribution', 'contribution')},
  (SELECT {r6(_BASE_VALUE, 'b').split(' AS b')[0]} FROM means) AS base_value,
  CASE WHEN contribution > 0 THEN 'augmente' ELSE 'diminue' END AS direction FROM cells""",
        "app",
        **_EXPLAIN,
    ),
)
def m13(t):
    df = application_features(t.app)
    return X.explain_linear(df, SCORER, df.where("split = 'train'"), n=6).drop("rank")


@register(
    "w2_top_contributions",
    with_tables(
        f"""
SELECT SK_ID_CURR, feature, {r6('contribution', 'contribution')}, rk AS rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY SK_ID_CURR ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS rk FROM cells) WHERE rk <= 3""",
        "app",
        **_EXPLAIN,
    ),
)
def w2(t):
    return R.top_contributions(_explained(t), ID, F.col("cells"), 3).select(
        ID, "feature", "contribution", "rank"
    )


@register(
    "m15_contribution_summary",
    with_tables(
        f"SELECT feature, {r6('avg(abs(contribution))', 'mean_abs_contribution')} FROM cells GROUP BY feature",
        "app",
        **_EXPLAIN,
    ),
)
def m15(t):
    return X.contribution_summary(_explained(t))


@register(
    "m14_fallback_explanation",
    with_tables(
        f"""
SELECT SK_ID_CURR, CAST(rank AS INTEGER) AS rank, feature, {r6('v', 'value')}, {r6('importance', 'contribution')},
  CASE WHEN v > 0 THEN '{K.RAISES_RISK}' ELSE '{K.LOWERS_RISK}' END AS direction
FROM (SELECT * FROM ranked WHERE rank <= 10) JOIN (
  {' UNION ALL '.join(f"SELECT SK_ID_CURR, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), 0) AS v FROM feat" for c in [*Q.APP_NUMERIC, *Q.DERIVED])}
) USING (feature)""",
        "app",
        **_RANK_CTES,
    ),
)
def m14(t):
    df = application_features(t.app)
    return X.fallback_explanation(df, _importance(t), [*Q.APP_NUMERIC, *Q.DERIVED], digits=None)


_PAYLOAD = """
SELECT SK_ID_CURR AS id, CASE WHEN SK_ID_CURR % 3 = 0 THEN
  '{"probability": "' || CAST(proba AS STRING) || '", "explanation": {"base_value": -0.5, "shap_values": {"AMT_CREDIT": ' || CAST(SK_ID_CURR % 7 - 3 AS STRING) || ', "DAYS_BIRTH": 0.25, "X": "nan"}, "feature_values": {"AMT_CREDIT": "12"}}}'
 WHEN SK_ID_CURR % 3 = 1 THEN
  '{"decision": "REFUSÉ", "expected_value": 0.1, "contributions": [{"feature": "A", "shap_value": 2.5, "direction": "diminue"}, {"name": "B", "contribution": ' || CAST(SK_ID_CURR % 5 AS STRING) || ', "value": "7"}, {"contribution": 1}]}'
 ELSE '{"baseline": "x", "top_features": [{"feature": "C", "contribution": 0.75, "direction": "augmente le risque"}, {"feature": "D", "contribution": -1.5}]}' END AS body
FROM scored"""
_NORMAL = f"""
SELECT SK_ID_CURR AS id, CASE SK_ID_CURR % 3 WHEN 2 THEN 'Contribution' ELSE 'Valeur SHAP' END AS impact_label,
  CASE SK_ID_CURR % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.1 END AS base_value, feature, value, impact, direction FROM scored JOIN (
  SELECT 0 AS r, 'AMT_CREDIT' AS feature, '12' AS value UNION ALL SELECT 0, 'DAYS_BIRTH', NULL UNION ALL SELECT 1, 'A', NULL
  UNION ALL SELECT 1, 'B', '7' UNION ALL SELECT 2, 'C', NULL UNION ALL SELECT 2, 'D', NULL) f ON r = SK_ID_CURR % 3,
  LATERAL (SELECT CAST(CASE feature WHEN 'AMT_CREDIT' THEN SK_ID_CURR % 7 - 3 WHEN 'DAYS_BIRTH' THEN 0.25 WHEN 'A' THEN -2.5
    WHEN 'B' THEN SK_ID_CURR % 5 WHEN 'C' THEN 0.75 ELSE -1.5 END AS DOUBLE) AS impact),
  LATERAL (SELECT CASE WHEN feature = 'A' THEN 'diminue' WHEN impact > 0 THEN 'augmente le risque' WHEN impact < 0 THEN 'diminue le risque' ELSE 'neutre' END AS direction)"""


@register(
    "x3_normalised_explanations",
    with_tables(
        f"SELECT id, impact_label, {r6('base_value', 'base_value')}, feature, value, {r6('impact', 'impact')}, direction FROM normal",
        "scored",
        normal=_NORMAL,
    ),
)
def x3(t):
    t.scored.createOrReplaceTempView("scored")
    payloads = t.spark.sql(_PAYLOAD)
    return X.explanation_rows(X.normalize_explanations(payloads, "body", "id"), "id")


# ---------------------------------------------------------------- trained models

def _prepared(t):
    return M.prepare_train_test(build_spine(t.loan_tables()).table)


def _boosted(t):
    """The prepared table and a fit on its train rows that stops by a hold-out."""
    prepared, fitted = _prepared(t)
    train = prepared.where("split = 'train'")
    parts = stratified_holdout(train, ID, K.TARGET).withColumn("_valid", F.col("part") == "valid")
    return prepared, T.train_leafwise(parts, fitted.feature_names, validation="_valid")


@register("m7_boosted_scores")
def m7(t):
    prepared, scorer = _boosted(t)
    return scorer.with_probability(prepared).select(ID, "split", "probability")


@register("m8_train_and_evaluate")
def m8(t):
    prepared, fitted = _prepared(t)
    done = T.train_and_evaluate(prepared, fitted.feature_names, "leafwise")
    card = T.model_card(t.spark, done.config, fitted.feature_names)
    return card.select("model_name", "threshold", "n_features", "metrics")


@register("m9_cross_validation")
def m9(t):
    prepared, fitted = _prepared(t)
    return E.cross_validation_summary(T.cross_validate(prepared, fitted.feature_names, "leafwise"))


@register("m12_global_importance")
def m12(t):
    _, scorer = _boosted(t)
    return X.global_importance(t.spark, scorer)


@register("m13_tree_contributions")
def m13_trees(t):
    prepared, scorer = _boosted(t)
    return X.explain_trees(prepared, scorer, n=5)


@register("m15_tree_contribution_summary")
def m15_trees(t):
    prepared, scorer = _boosted(t)
    return X.contribution_summary(shapley_cells(prepared, scorer))


@register("m16_model_card")
def m16(t):
    prepared, scorer = _boosted(t)
    scored = scorer.with_probability(prepared.where("split = 'train'"))
    metrics = E.all_metrics(scored.withColumnRenamed("probability", "proba"), 0.5).first().asDict()
    config = {
        "optimal_threshold": 0.5,
        "metrics": {k: metrics[k] for k in ("auc", "accuracy")},
        "training_date": "2024-01-16",
    }
    card = T.model_card(t.spark, config, scorer.features)
    values = F.transform(
        F.array_sort(F.map_entries("metrics")), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("string"))
    )
    return card.withColumn("features", F.array_join("features", ",")).withColumn("metrics", F.array_join(values, ","))
