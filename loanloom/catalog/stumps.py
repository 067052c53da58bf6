"""Boosted fits whose every step SQL can follow: one split a tree, features with few values."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.catalog import evaluation as V
from loanloom.catalog.base import r6, register, with_tables
from loanloom.catalog.features import FEATURE_SELECT, md5_rank
from loanloom.catalog.models import BAND, SCORED_APP, SCORER
from loanloom.operators import evaluate as E
from loanloom.operators import explain as X
from loanloom.operators.applicant import application_features
from loanloom.plans import training as T
from loanloom.plans.preprocessor import ClientPreprocessor
from loanloom.plans.scoring import score

ID = K.CLIENT_KEY
# FLAG_PHONE equals FLAG_DOCUMENT_2 in the test tables: which of the two a tree takes would be chance
FEATURES = ["CNT_FAM_MEMBERS", "FLAG_DOCUMENT_2", "FLAG_DOCUMENT_3", "FLAG_EMAIL"]
ROUNDS, STEP, LEAST = 3, 0.05, 20


SETTINGS = dict(
    trees=ROUNDS,
    max_depth=1,
    learning_rate=STEP,
    row_fraction=1.0,
    feature_fraction="all",
    min_rows_per_leaf=LEAST,
)


def _fitted(t):
    return T.train_boosted(t.train, FEATURES, **SETTINGS)


# ------------------------------------------------------------------- the same in SQL

_VALUE = "CASE feature " + " ".join(f"WHEN '{f}' THEN CAST({f} AS DOUBLE)" for f in FEATURES) + " END"
_LONG = " UNION ALL ".join(
    f"SELECT model, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, w, res FROM {{0}} WHERE fitted" for f in FEATURES
)


def _weight(k: int) -> float:
    """The first tree counts whole, later ones by the step size."""
    return 1.0 if k == 1 else STEP


def _fit_ctes() -> dict[str, str]:
    """From ``rows_of`` (model, fitted, SK_ID_CURR, split, TARGET, features), for every model and round k:
    residuals (step), gains of all cut points (sums), the best split (tree), new margins (moved)."""
    ctes = {
        "step1": """
SELECT *, 2.0 * TARGET - 1 AS y, CAST(0 AS DOUBLE) AS margin, 2.0 * TARGET - 1 AS res,
  count(*) OVER (PARTITION BY model, fitted) / (2.0 * count(*) OVER (PARTITION BY model, fitted, TARGET)) AS w FROM rows_of""",
        "points": f"""
SELECT model, feature, (v + lead(v) OVER (PARTITION BY model, feature ORDER BY v)) / 2 AS cut
FROM (SELECT DISTINCT model, feature, v FROM ({_LONG.format('step1')}))""",
    }
    for k in range(1, ROUNDS + 1):
        ctes[f"sums{k}"] = f"""
SELECT model, feature, cut, sum(w) FILTER (WHERE v <= cut) AS wl, sum(w * res) FILTER (WHERE v <= cut) AS sl, count(*) FILTER (WHERE v <= cut) AS nl,
  sum(w) FILTER (WHERE v > cut) AS wr, sum(w * res) FILTER (WHERE v > cut) AS sr, count(*) FILTER (WHERE v > cut) AS nr
FROM ({_LONG.format(f'step{k}')}) JOIN points USING (model, feature) WHERE cut IS NOT NULL GROUP BY model, feature, cut"""
        ctes[f"tree{k}"] = f"""
SELECT model, feature, cut, sl / wl AS below, sr / wr AS above, (sl + sr) / (wl + wr) AS mean,
  sl * sl / wl + sr * sr / wr - (sl + sr) * (sl + sr) / (wl + wr) AS gain
FROM sums{k} WHERE nl >= {LEAST} AND nr >= {LEAST}
QUALIFY row_number() OVER (PARTITION BY model ORDER BY gain DESC, feature, cut) = 1"""
        ctes[f"moved{k}"] = f"""
SELECT s.* EXCLUDE (margin, res), margin + CAST({_weight(k)} AS DOUBLE) * CASE WHEN {_VALUE} <= cut THEN below ELSE above END AS margin
FROM step{k} s JOIN tree{k} t ON s.model = t.model"""
        ctes[f"step{k + 1}"] = f"SELECT *, 4 * y / (1 + exp(2 * y * margin)) AS res FROM moved{k}"
    return ctes


_COLUMNS = f"SK_ID_CURR, split, TARGET, {', '.join(FEATURES)}"
_CTES = {
    "rows_of": f"SELECT 0 AS model, split = 'train' AS fitted, {_COLUMNS} FROM app",
    **_fit_ctes(),
}
_TREES = " UNION ALL ".join(
    f"SELECT CAST({_weight(k)} AS DOUBLE) AS weight, * FROM tree{k}" for k in range(1, ROUNDS + 1)
)
_FEATURES = f"(VALUES {', '.join(f"('{f}')" for f in FEATURES)}) f(feature)"

_ROUNDS = " UNION ALL ".join(f"SELECT {k} AS round, * FROM moved{k}" for k in range(1, ROUNDS + 1))
_STOPPED = {
    **_fit_ctes(),
    "rounds": _ROUNDS,
    # the round with the lowest loss on the rows that were not fitted
    "kept": """
SELECT model, round FROM (SELECT model, round, sum(w * 2 * ln(1 + exp(-2 * y * margin))) / sum(w) AS loss FROM rounds
  WHERE NOT fitted GROUP BY model, round) QUALIFY row_number() OVER (PARTITION BY model ORDER BY loss, round) = 1""",
    "folded": """
SELECT model AS fold, round, TARGET, 1 / (1 + exp(-2 * margin)) AS proba
FROM rounds JOIN kept USING (model, round) WHERE NOT fitted""",
    "grid": V.GRID,
    "curve": V.FOLD_CURVE,
    "best": V.FOLD_BEST,
    "aucs": V.FOLD_AUC,
}


@register(
    "m7_boosted_stumps",
    with_tables(
        f"SELECT SK_ID_CURR, split, {r6('1 / (1 + exp(-2 * margin))', 'probability')} FROM moved{ROUNDS}", "app", **_CTES
    ),
)
def m7_stumps(t):
    return _fitted(t).with_probability(t.app).select(ID, "split", "probability")


_P = f"SELECT SK_ID_CURR, 1 / (1 + exp(-2 * margin)) AS p FROM moved{ROUNDS}"


@register(
    "m11_preprocessed_scores",
    with_tables(
        f"""
SELECT SK_ID_CURR AS client_id, {r6('p', 'probability')}, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction,
  CASE WHEN p >= 0.5 THEN '{K.REFUSED}' ELSE '{K.ACCEPTED}' END AS decision, {BAND} AS risk_category, {r6('0.5', 'threshold')} FROM sc""",
        "app",
        **_CTES,
        sc=_P,
    ),
)
def m11_preprocessed(t):
    """A fitted preprocessing and a scorer fitted on what it returns, together on raw clients."""
    fitted = ClientPreprocessor().fit(application_features(t.train))
    scorer = T.train_boosted(fitted.transform(application_features(t.train)), FEATURES, **SETTINGS)
    return score(t.app, scorer, 0.5, preprocessor=fitted, digits=None)


@register(
    "m12_stump_importance",
    with_tables(
        f"""
SELECT feature, {r6('importance', 'importance')}, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,
  {r6('importance * 100', 'importance_pct')} FROM (
  SELECT feature, coalesce(sum(gain), 0) / (SELECT sum(gain) FROM trees) AS importance
  FROM {_FEATURES} LEFT JOIN trees USING (feature) GROUP BY feature)""",
        "app",
        **_CTES,
        trees=_TREES,
    ),
)
def m12_stumps(t):
    return X.global_importance(t.spark, _fitted(t))


_CELLS = f"""
SELECT SK_ID_CURR, feature, {_VALUE} AS value, coalesce(sum(weight * (CASE WHEN {_VALUE} <= cut THEN below ELSE above END - mean)), 0) AS contribution
FROM app, {_FEATURES} LEFT JOIN trees USING (feature) GROUP BY ALL"""


@register(
    "m13_stump_contributions",
    with_tables(
        f"""
SELECT SK_ID_CURR, feature, {r6('value', 'value')}, {r6('contribution', 'contribution')},
  (SELECT {r6('sum(weight * mean)', 'b').split(' AS b')[0]} FROM trees) AS base_value,
  CASE WHEN contribution > 0 THEN '{X.UP}' ELSE '{X.DOWN}' END AS direction FROM cells""",
        "app",
        **_CTES,
        trees=_TREES,
        cells=_CELLS,
    ),
)
def m13_stumps(t):
    return X.explain_trees(t.app, _fitted(t), n=len(FEATURES)).drop("rank")


@register(
    "m15_stump_contribution_summary",
    with_tables(
        f"SELECT feature, {r6('avg(abs(contribution))', 'mean_abs_contribution')} FROM cells GROUP BY feature",
        "app",
        **_CTES,
        trees=_TREES,
        cells=_CELLS,
    ),
)
def m15_stumps(t):
    return X.contribution_summary(X.tree_cells(t.app, _fitted(t)))


# ------------------------------------------------------- hold-out and cross-validation

_HASHED = f"""SELECT *, {md5_rank(42, 'TARGET')} AS rk, count(*) OVER (PARTITION BY TARGET) AS rows_of_class
FROM app WHERE TARGET IS NOT NULL"""


@register(
    "m8_stumps_on_holdout",
    with_tables(
        f"""
SELECT {r6('threshold', 'threshold')}, (SELECT CAST(round AS BIGINT) FROM kept) AS best_iteration, {r6('auc', 'auc')},
  {r6('(TP + TN) / CAST(n AS DOUBLE)', 'accuracy')}, {r6(V.COST, 'business_cost')} FROM best JOIN aucs USING (fold)""",
        "app",
        hashed=_HASHED,
        rows_of=f"SELECT 0 AS model, rk > round_even(rows_of_class * 0.2, 0) AS fitted, {_COLUMNS} FROM hashed",
        **_STOPPED,
    ),
)
def m8_stumps(t):
    done = T.train_and_evaluate(t.train, FEATURES, **SETTINGS)
    card = T.model_card(t.spark, done.config, FEATURES)
    flat = [F.col("metrics")[name].alias(name) for name in ("auc", "accuracy", "business_cost")]
    best = F.lit(done.config["best_iteration"]).cast("long").alias("best_iteration")
    return card.select("threshold", best, *flat)


_FOLD = """(SELECT count(DISTINCT floor(rows_of_class * CAST(i AS DOUBLE) / 5)) FROM range(1, 5) t(i)
  WHERE floor(rows_of_class * CAST(i AS DOUBLE) / 5) < rk AND floor(rows_of_class * CAST(i AS DOUBLE) / 5) > 0)"""


@register(
    "m9_stumps_by_fold",
    with_tables(
        f"""
SELECT CAST(fold AS INTEGER) AS fold, {r6('auc', 'auc')}, {r6('(TP + TN) / CAST(n AS DOUBLE)', 'accuracy')},
  {r6(V.COST, 'business_cost')}, {r6('threshold', 'threshold')} FROM best JOIN aucs USING (fold)""",
        "app",
        hashed=_HASHED,
        dealt=f"SELECT *, {_FOLD} AS fold_of FROM hashed",
        rows_of=f"SELECT m.model, fold_of <> m.model AS fitted, {_COLUMNS} FROM dealt, range(5) m(model)",
        **_STOPPED,
    ),
)
def m9_stumps(t):
    return T.cross_validate(t.train, FEATURES, **SETTINGS)


# ------------------------------------------------------------------------ model card


@register(
    "m16_linear_model_card",
    with_tables(
        f"""
SELECT 'linear scorer' AS model_name, '1.0.0' AS model_version, {r6('0.44', 'threshold')}, {r6('10', 'cost_fn')}, {r6('1', 'cost_fp')},
  CAST({len(SCORER.weights)} AS INTEGER) AS n_features, '{','.join(SCORER.weights)}' AS features,
  {r6(V.AUC_VALUE, 'auc')}, {r6(V._div('TP + TN', 'n'), 'accuracy')}, {r6(V.COST, 'business_cost')},
  (SELECT CAST(CAST(max(ts) AS DATE) AS VARCHAR) FROM events) AS training_date FROM cm, ranks""",
        "app",
        feat=FEATURE_SELECT,
        sc=SCORED_APP,
        scored="SELECT SK_ID_CURR, TARGET, p AS proba FROM sc WHERE split = 'train'",
        classed=V.CLASSED,
        cm=V.CONFUSION,
        ranks=V.AUC,
    ),
)
def m16_linear(t):
    rows = SCORER.with_probability(application_features(t.train)).withColumnRenamed("probability", "proba")
    found = E.all_metrics(rows, 0.44).first().asDict()
    config = {
        "model_name": "linear scorer",
        "optimal_threshold": 0.44,
        "metrics": {name: found[name] for name in ("auc", "accuracy", "business_cost")},
    }
    day = str(t.scored.agg(F.max("ts").cast("date")).first()[0])
    card = T.model_card(t.spark, config, list(SCORER.weights), trained_on=day)
    flat = [F.col("metrics")[name].alias(name) for name in config["metrics"]]
    return card.select("*", *flat).drop("metrics").withColumn("features", F.array_join("features", ","))
