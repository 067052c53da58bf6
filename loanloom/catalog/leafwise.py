"""A tree grown leaf by leaf that SQL can follow: three leaves, features with few values."""

from __future__ import annotations

from loanloom import constants as K
from loanloom.catalog.base import r6, register, with_tables
from loanloom.operators import explain as X
from loanloom.operators.shapley import shapley_cells
from loanloom.plans.leafwise import train_leafwise
from loanloom.plans.scoring import decide

ID = K.CLIENT_KEY
FEATURES = ["CNT_FAM_MEMBERS", "FLAG_DOCUMENT_2", "FLAG_DOCUMENT_3", "FLAG_EMAIL"]
STEP, LEAST, L1, L2 = 0.05, 20, 0.1, 0.1
SETTINGS = dict(
    trees=1,
    leaves=3,
    learning_rate=STEP,
    row_fraction=1.0,
    feature_fraction="all",
    min_rows_per_leaf=LEAST,
    l1=L1,
    l2=L2,
)


def _fitted(t):
    return train_leafwise(t.train, FEATURES, **SETTINGS)


# ------------------------------------------------------------------- the same in SQL


def _worth(g: str, h: str) -> str:
    return f"power(greatest(abs({g}) - {L1}, 0), 2) / ({h} + {L2})"


def _value(of: str) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{f}' THEN CAST({f} AS DOUBLE)" for f in FEATURES) + " END"


def _splits(rows: str) -> str:
    """The split with the highest gain over all nodes of ``rows``: cuts at values that occur in the node."""
    long = " UNION ALL ".join(
        f"SELECT node, {i} AS place, '{f}' AS feature, CAST({f} AS DOUBLE) AS v, g, h FROM {rows} WHERE fitted"
        for i, f in enumerate(FEATURES)
    )
    return f"""
SELECT node, feature, v AS cut, gain FROM (
  SELECT *, {_worth('gl', 'hl')} + {_worth('ga - gl', 'ha - hl')} - {_worth('ga', 'ha')} AS gain FROM (
    SELECT node, place, feature, v,
      sum(sum(g)) OVER upto AS gl, sum(sum(h)) OVER upto AS hl, sum(count(*)) OVER upto AS nl,
      sum(sum(g)) OVER every AS ga, sum(sum(h)) OVER every AS ha, sum(count(*)) OVER every AS na
    FROM ({long}) GROUP BY node, place, feature, v
    WINDOW upto AS (PARTITION BY node, feature ORDER BY v ROWS UNBOUNDED PRECEDING), every AS (PARTITION BY node, feature))
  WHERE nl >= {LEAST} AND na - nl >= {LEAST})
ORDER BY gain DESC, node, place, cut LIMIT 1"""


_CTES = {
    "weighed": """
SELECT *, 0 AS node, split = 'train' AS fitted,
  count(*) OVER (PARTITION BY split) / (2.0 * count(*) OVER (PARTITION BY split, TARGET)) AS w FROM app""",
    "step0": "SELECT *, w * (0.5 - TARGET) AS g, w * 0.25 AS h FROM weighed",
    "split1": _splits("step0"),
    "step1": f"""
SELECT s.* EXCLUDE (node), CASE WHEN {_value('t.feature')} <= t.cut THEN 1 ELSE 2 END AS node FROM step0 s, split1 t""",
    "split2": _splits("step1"),
    # branch: the side of the second split by the row's own values, also where it is not in that node
    "step2": f"""
SELECT s.*, CASE WHEN {_value('t.feature')} <= t.cut THEN 3 ELSE 4 END AS branch, s.node = t.node AS inside FROM step1 s, split2 t""",
    "leaves": f"""
SELECT CASE WHEN inside THEN branch ELSE node END AS leaf, CAST(count(*) AS DOUBLE) AS n,
  -{STEP} * sign(sum(g)) * greatest(abs(sum(g)) - {L1}, 0) / (sum(h) + {L2}) AS answer
FROM step2 WHERE fitted GROUP BY 1""",
    "known": """
SELECT s.*, o.answer AS other, own.answer AS own, m.mean, m.n / (m.n + o.n) AS share FROM step2 s
JOIN leaves own ON own.leaf = s.branch
JOIN leaves o ON o.leaf < 3
JOIN (SELECT sum(n * answer) / sum(n) AS mean, sum(n) AS n FROM leaves WHERE leaf >= 3) m ON true""",
}


@register(
    "m7_leafwise_scores",
    with_tables(
        f"""
SELECT SK_ID_CURR, split, {r6('p', 'probability')}, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM (SELECT *, 1 / (1 + exp(-CASE WHEN inside THEN own ELSE other END)) AS p FROM known)""",
        "app",
        **_CTES,
    ),
)
def m7_leafwise(t):
    scored = decide(_fitted(t).with_probability(t.app), 0.5)
    return scored.select(ID, "split", "probability", "prediction")


# Shapley values of the at most two features of the tree, by all their subsets
_SUBSETS = """
SELECT *, share * mean + (1 - share) * other AS v0, CASE WHEN inside THEN mean ELSE other END AS v1,
  share * own + (1 - share) * other AS v2, CASE WHEN inside THEN own ELSE other END AS v12 FROM known"""
_CELLS = f"""
SELECT SK_ID_CURR, f.feature, {_value('f.feature')} AS value, v0, v12, CASE
  WHEN f.feature = a.feature AND f.feature = b.feature THEN v12 - v0
  WHEN f.feature = a.feature THEN (v1 - v0 + v12 - v2) / 2
  WHEN f.feature = b.feature THEN (v2 - v0 + v12 - v1) / 2 ELSE 0 END AS contribution
FROM subsets, split1 a, split2 b, (VALUES {', '.join(f"('{f}')" for f in FEATURES)}) f(feature)"""


@register(
    "m13_shapley_contributions",
    with_tables(
        f"""
SELECT SK_ID_CURR, feature, {r6('value', 'value')}, {r6('contribution', 'contribution')}, {r6('v0', 'base_value')},
  CASE WHEN contribution > 0 THEN '{X.UP}' ELSE '{X.DOWN}' END AS direction FROM cells""",
        "app",
        **_CTES,
        subsets=_SUBSETS,
        cells=_CELLS,
    ),
)
def m13_shapley(t):
    return X.explain_trees(t.app, _fitted(t), n=len(FEATURES)).drop("rank")


@register(
    "m15_shapley_summary",
    with_tables(
        f"SELECT feature, {r6('avg(abs(contribution))', 'mean_abs_contribution')} FROM cells GROUP BY feature",
        "app",
        **_CTES,
        subsets=_SUBSETS,
        cells=_CELLS,
    ),
)
def m15_shapley(t):
    return X.contribution_summary(shapley_cells(t.app, _fitted(t)))
