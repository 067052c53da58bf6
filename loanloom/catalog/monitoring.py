"""Drift, streaming and input/output queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.catalog import evaluation as EV
from loanloom.catalog import sqltext as Q
from loanloom.catalog.base import r6, register, with_tables
from loanloom.catalog.features import FEATURE_SELECT
from loanloom.catalog.models import SCORED_APP, SCORER, _scored_sql
from loanloom.catalog.profiles import corr_sql
from loanloom.functions.guards import rounded
from loanloom.operators import drift as D
from loanloom.operators import evaluate as E
from loanloom.operators.profile import column_stats
from loanloom.operators.ranking import importance_ranking
from loanloom.plans.scoring import score
from loanloom.session import materialize, scratch_path
from loanloom.sources import readers as I
from loanloom.sources import sinks as O
from loanloom.streaming import drift as SD
from loanloom.streaming import jobs as J

ID = K.CLIENT_KEY
SPLIT_AT = "TIMESTAMP '2024-01-16'"
NUM = Q.APP_NUMERIC
SIDED = "SELECT *, CASE split WHEN 'train' THEN 'reference' ELSE 'current' END AS side FROM app"


def _pair(t):
    return D.pair(t.app.where("split = 'train'").drop("split"), t.app.where("split = 'test'").drop("split"))


def _event_sides(t, name: str):
    df = t.scored if name == "scored" else t.raw(name)
    before = df.where(f"ts < {SPLIT_AT}")
    return D.pair(before, df.where(f"ts >= {SPLIT_AT}"))


# --------------------------------------------------------------------------- drift


@register("d1_population_pair", with_tables("SELECT * EXCLUDE (split) FROM sided", "app", sided=SIDED), digits=None)
def d1(t):
    return _pair(t)


@register(
    "d2_distribution_comparison",
    with_tables(
        f"""
SELECT side, feature, count(value) AS count, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')}, {r6('min(value)', 'min')},
  {r6('quantile_cont(value, 0.25)', 'q25')}, {r6('quantile_cont(value, 0.5)', 'q50')}, {r6('quantile_cont(value, 0.75)', 'q75')},
  {r6('max(value)', 'max')} FROM long GROUP BY side, feature""",
        "app",
        sided=SIDED,
        long=" UNION ALL ".join(
            f"SELECT side, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM sided" for c in NUM
        ),
    ),
)
def d2(t):
    return D.distribution_comparison(_pair(t), NUM)


@register(
    "d2_histogram_comparison",
    with_tables(
        """
SELECT side, CAST(bin AS INTEGER) AS bin, coalesce(m, 0) AS rows FROM (SELECT * FROM ends, range(0, 50) t(bin)) LEFT JOIN (
  SELECT side, least(CAST(floor((x - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin, count(*) AS m FROM vals JOIN ends USING (side) GROUP BY 1, 2
) USING (side, bin)""",
        "app",
        sided=SIDED,
        vals="SELECT side, AMT_CREDIT AS x FROM sided",
        ends="SELECT side, min(x) AS lo, max(x) AS hi FROM vals GROUP BY side",
    ),
)
def d2_histogram(t):
    return D.histogram_comparison(_pair(t), "AMT_CREDIT").select("side", "bin", "rows")


_SIDE_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE side = 'reference' AND {c} IS NULL) * 100.0 / count(*) FILTER (WHERE side = 'reference') AS r,"
    f" count(*) FILTER (WHERE side = 'current' AND {c} IS NULL) * 100.0 / count(*) FILTER (WHERE side = 'current') AS c FROM sided"
    for c in [*NUM, *Q.APP_STRING]
)


@register(
    "d3_missing_drift",
    with_tables(
        f"SELECT feature, {r6('r', 'reference')}, {r6('c', 'current')}, {r6('c - r', 'change')} FROM nulls",
        "app",
        sided=SIDED,
        nulls=_SIDE_NULLS,
    ),
)
def d3(t):
    return D.missing_drift(_pair(t), [*NUM, *Q.APP_STRING])


_CORR_COLS = [c for c in NUM if c != "AMT_CREDIT"]


def _side_corr(c: str) -> str:
    parts = [
        f"(SELECT {corr_sql(c, 'AMT_CREDIT')} FROM sided WHERE side = '{s}') AS {a}"
        for s, a in (("reference", "r"), ("current", "c"))
    ]
    return f"SELECT '{c}' AS feature, {', '.join(parts)}"


@register(
    "d4_correlation_drift",
    with_tables(
        f"SELECT feature, {r6('r', 'reference')}, {r6('c', 'current')}, {r6('c - r', 'change')} FROM corrs",
        "app",
        sided=SIDED,
        corrs=" UNION ALL ".join(_side_corr(c) for c in _CORR_COLS),
    ),
)
def d4(t):
    return D.correlation_drift(_pair(t), _CORR_COLS, "AMT_CREDIT")


_KS = """
SELECT feature, max(abs(fr - fc)) AS d, max(n) AS n, max(m) AS m FROM (
  SELECT feature, CAST(sum(is_r) OVER up AS DOUBLE) / nullif(sum(is_r) OVER whole, 0) AS fr, CAST(sum(1 - is_r) OVER up AS DOUBLE) / nullif(sum(1 - is_r) OVER whole, 0) AS fc,
    CAST(sum(is_r) OVER whole AS DOUBLE) AS n, CAST(sum(1 - is_r) OVER whole AS DOUBLE) AS m
  FROM (SELECT feature, value, CASE side WHEN 'reference' THEN 1 ELSE 0 END AS is_r FROM long)
  WINDOW up AS (PARTITION BY feature ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), whole AS (PARTITION BY feature)
) GROUP BY feature"""
_KS_P = """CASE WHEN d IS NULL THEN NULL WHEN sqrt(n * m / (n + m)) * d < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT sum((CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * (n * m / (n + m)) * d * d)) FROM range(1, 101) t(k)))) END"""


@register(
    "d5_kolmogorov_smirnov",
    with_tables(
        f"SELECT feature, {r6('d', 'statistic')}, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, {r6(_KS_P, 'p_value')} FROM ks",
        "app",
        sided=SIDED,
        long=Q.union_long("sided", NUM, "side"),
        ks=_KS,
    ),
)
def d5(t):
    return D.ks_test(_pair(t), NUM)


SCORED_LONG = f"SELECT CASE WHEN ts < {SPLIT_AT} THEN 'reference' ELSE 'current' END AS side, 'proba' AS feature, proba AS value FROM scored"


@register(
    "d7_prediction_drift",
    with_tables(
        f"SELECT feature, {r6('d', 'statistic')}, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, {r6(_KS_P, 'p_value')} FROM ks",
        "scored",
        long=SCORED_LONG,
        ks=_KS,
    ),
)
def d7(t):
    return D.prediction_drift(t.scored.where(f"ts < {SPLIT_AT}"), t.scored.where(f"ts >= {SPLIT_AT}"))


# the upper tail of the chi-squared distribution in closed form, for few even or odd degrees
_NORMAL_TAIL = "(SELECT 2 * sum(exp(-pow(sqrt(x) + (k + 0.5) * 0.0005, 2) / 2)) * 0.0005 / sqrt(2 * pi()) FROM range(0, 60000) t(k))"
_CHI_P = f"""CASE WHEN dof % 2 = 0 THEN (SELECT sum(exp(-x / 2 + k * ln(x / 2) - lgamma(k + 1))) FROM range(0, dof // 2) t(k))
  ELSE {_NORMAL_TAIL} + coalesce((SELECT sum(exp(-x / 2 + (k + 0.5) * ln(x / 2) - lgamma(k + 1.5))) FROM range(0, dof // 2) t(k)), 0) END"""

_CHI = """
SELECT feature, sum((r - er) * (r - er) / er + (c - ec) * (c - ec) / ec) AS x, count(*) - 1 AS dof,
  CAST(sum(r) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS m FROM (
  SELECT feature, r, c, (r + c) * CAST(sum(r) OVER w AS DOUBLE) / (sum(r) OVER w + sum(c) OVER w) AS er,
    (r + c) * CAST(sum(c) OVER w AS DOUBLE) / (sum(r) OVER w + sum(c) OVER w) AS ec
  FROM (SELECT feature, value, count(*) FILTER (WHERE side = 'reference') AS r, count(*) FILTER (WHERE side = 'current') AS c FROM texts GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY feature)) GROUP BY feature"""


@register(
    "d6_chi_squared",
    with_tables(
        f"SELECT feature, {r6('x', 'statistic')}, dof, n, m, {r6(_CHI_P, 'p_value', 4)} FROM chi",
        "app",
        sided=SIDED,
        texts=Q.union_text("sided", Q.APP_STRING, "side")
        + f" UNION ALL SELECT CASE WHEN ts < {SPLIT_AT} THEN 'reference' ELSE 'current' END, 'event_type', event_type FROM events",
        chi=_CHI,
    ),
    digits=None,
)
def d6(t):
    clients = D.chi2_test(_pair(t), Q.APP_STRING)
    events = D.chi2_test(_event_sides(t, "events").select("side", "event_type"), ["event_type"])
    rows = clients.unionByName(events)
    return rounded(rows.drop("p_value"), 6).join(rounded(rows.select("feature", "p_value"), 4), "feature")


_TEXTS = Q.union_text("sided", Q.APP_STRING, "side")
_REPORT = f"""
SELECT *, CASE WHEN m = 0 THEN 'lost' WHEN n = 0 THEN 'new' ELSE 'tested' END AS status, m = 0 OR n = 0 OR p < 0.05 AS drifted FROM (
  SELECT feature, 'kolmogorov_smirnov' AS test, d AS statistic, {_KS_P} AS p, n, m FROM ks
  UNION ALL SELECT feature, 'chi_squared', x, {_CHI_P}, n, m FROM chi)"""


@register(
    "d7_drift_alert",
    with_tables(
        f"""
SELECT count(*) AS features, count(*) FILTER (WHERE drifted) AS drifted_features, count(*) FILTER (WHERE status <> 'tested') AS one_sided_features,
  {r6('count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE)', 'drift_share')},
  count(*) FILTER (WHERE drifted) / CAST(count(*) AS DOUBLE) >= 0.5 OR count(*) FILTER (WHERE status <> 'tested') > 0 AS alert FROM report""",
        "app",
        sided=SIDED,
        long=Q.union_long("sided", NUM, "side"),
        texts=_TEXTS,
        ks=_KS,
        chi=_CHI,
        report=_REPORT,
    ),
)
def d7_alert(t):
    return D.drift_alert(D.drift_report(_pair(t), NUM, Q.APP_STRING))


@register(
    "d7_drift_report",
    with_tables(
        f"SELECT feature, test, {r6('statistic', 'statistic')}, {r6('p', 'p_value', 4)}, status, drifted FROM report",
        "app",
        sided=SIDED,
        long=Q.union_long("sided", NUM, "side"),
        texts=_TEXTS,
        ks=_KS,
        chi=_CHI,
        report=_REPORT,
    ),
    digits=None,
)
def d7_report(t):
    rows = D.drift_report(_pair(t), NUM, Q.APP_STRING)
    return rounded(rows.drop("p_value"), 6).join(
        rounded(rows.select("feature", "test", "p_value"), 4), ["feature", "test"]
    )


_LOST = "SELECT * REPLACE (CASE WHEN side = 'reference' THEN AMT_CREDIT END AS AMT_CREDIT, CASE WHEN side = 'current' THEN OCCUPATION_TYPE END AS OCCUPATION_TYPE, CAST(NULL AS DOUBLE) AS OWN_CAR_AGE) FROM sided"


@register(
    "d7_drift_one_sided",
    with_tables(
        """
SELECT feature, CASE WHEN r = 0 AND c = 0 THEN 'empty' WHEN c = 0 THEN 'lost' WHEN r = 0 THEN 'new' ELSE 'tested' END AS status,
  (r = 0) <> (c = 0) AS drifted, TRUE AS alert FROM (
  SELECT 'AMT_CREDIT' AS feature, count(AMT_CREDIT) FILTER (WHERE side = 'reference') AS r, count(AMT_CREDIT) FILTER (WHERE side = 'current') AS c FROM changed
  UNION ALL SELECT 'OCCUPATION_TYPE', count(OCCUPATION_TYPE) FILTER (WHERE side = 'reference'), count(OCCUPATION_TYPE) FILTER (WHERE side = 'current') FROM changed
  UNION ALL SELECT 'OWN_CAR_AGE', count(OWN_CAR_AGE) FILTER (WHERE side = 'reference'), count(OWN_CAR_AGE) FILTER (WHERE side = 'current') FROM changed)""",
        "app",
        sided=SIDED,
        changed=_LOST,
    ),
)
def d7_one_sided(t):
    """A feature without values on one side raises the alert."""
    both = _pair(t).withColumns(
        {
            "AMT_CREDIT": F.when(F.col("side") == "reference", F.col("AMT_CREDIT")),
            "OCCUPATION_TYPE": F.when(F.col("side") == "current", F.col("OCCUPATION_TYPE")),
            "OWN_CAR_AGE": F.lit(None).cast("double"),
        }
    )
    report = D.drift_report(both, ["AMT_CREDIT", "OWN_CAR_AGE"], ["OCCUPATION_TYPE"])
    alert = D.drift_alert(report).select("alert").scalar()
    return report.select("feature", "status", "drifted").withColumn("alert", alert)


# ------------------------------------------------------------------------ streaming


@register(
    "r1_stream_scores",
    with_tables(_scored_sql(0.44).replace("CAST(0.44 AS DOUBLE)", r6("0.44", "x").split(" AS x")[0]), "app", feat=FEATURE_SELECT, sc=SCORED_APP),
)
def r1(t):
    source, out = scratch_path(t.spark, "arrivals"), scratch_path(t.spark, "scores")
    t.app.repartition(4, ID).write.parquet(source)
    clients = J.read_stream(t.spark, source, t.app.schema, files_per_trigger=2)
    scores = score(clients, SCORER, 0.44, digits=None)
    J.run_to_end(scores, out, scratch_path(t.spark, "progress"))
    return t.spark.read.parquet(out)


def _predicted(t):
    return t.scored.select(
        ID,
        F.col("ts").cast("timestamp").alias("ts"),
        "proba",
        (F.col("proba") >= 0.44).cast("int").alias("prediction"),
    )


@register(
    "r2_prediction_log",
    with_tables(
        f"SELECT SK_ID_CURR, CASE WHEN proba >= 0.44 THEN 1 ELSE 0 END AS prediction, {r6('proba', 'proba')} FROM scored",
        "scored",
    ),
)
def r2(t):
    """Every event is delivered twice and must be logged once."""
    source, out = scratch_path(t.spark, "deliveries"), scratch_path(t.spark, "log")
    rows = _predicted(t)
    rows.unionByName(rows).repartition(4, ID).write.parquet(source)
    events = J.read_stream(t.spark, source, rows.schema)
    J.run_to_end(J.prediction_log(events, ID), out, scratch_path(t.spark, "progress"))
    return t.spark.read.parquet(out).select(ID, "prediction", "proba")


_WINDOWS = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS rows, avg(CASE WHEN proba >= 0.44 THEN 1 ELSE 0 END) AS refusal_rate,
  avg(proba) AS mean_score FROM scored GROUP BY 1"""


def _days(windows, *more):
    return windows.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "rows", "refusal_rate", "mean_score", *more
    )


_MONITOR = f"SELECT day, rows, {r6('refusal_rate', 'refusal_rate')}, {r6('mean_score', 'mean_score')} FROM days"


@register(
    "r3_decision_monitor",
    with_tables(_MONITOR + " WHERE day < (SELECT max(day) FROM days)", "scored", days=_WINDOWS),
)
def r3(t):
    """Windows closed by the watermark; the last day stays open."""
    source, out = scratch_path(t.spark, "predictions"), scratch_path(t.spark, "windows")
    rows = _predicted(t)
    rows.write.parquet(source)
    events = J.read_stream(t.spark, source, rows.schema)
    J.run_to_end(J.decision_monitor(events), out, scratch_path(t.spark, "progress"))
    return _days(t.spark.read.parquet(out))


@register(
    "r3_monitor_alerts",
    with_tables(
        f"""SELECT day, rows, {r6('refusal_rate', 'refusal_rate')}, {r6('mean_score', 'mean_score')},
  abs(refusal_rate - r) > 0.01 OR abs(mean_score - m) > 0.01 AS alert
FROM days, (SELECT avg(CASE WHEN proba >= 0.44 THEN 1 ELSE 0 END) AS r, avg(proba) AS m FROM scored)""",
        "scored",
        days=_WINDOWS,
    ),
)
def r3_alerts(t):
    """Days whose refusals or scores left the population's by more than a hundredth."""
    rows = _predicted(t)
    whole = rows.agg(F.avg("prediction").alias("r"), F.avg("proba").alias("m")).first()
    windows = J.monitor_alerts(J.monitor_aggregates(rows), whole["r"], whole["m"], 0.01)
    return _days(windows, "alert")


_GAPS = "SELECT * REPLACE (CASE WHEN SK_ID_CURR % 4 = 0 AND ts >= TIMESTAMP '2024-01-20' THEN NULL ELSE proba END AS proba) FROM scored"


def _gaps(t):
    """Scores of which a quarter is missing from one day on."""
    missing = (F.col(ID) % 4 == 0) & (F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))
    return _predicted(t).withColumn("proba", F.when(~missing, F.col("proba")))


@register(
    "r3_null_alerts",
    with_tables(
        f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS rows, {r6('avg(CASE WHEN proba IS NULL THEN 1 ELSE 0 END)', 'null_rate')},
  avg(CASE WHEN proba IS NULL THEN 1 ELSE 0 END) > 0.1 AS alert FROM gaps GROUP BY 1""",
        "scored",
        gaps=_GAPS,
    ),
)
def r3_nulls(t):
    """Days on which too many scores are missing, rate and mean being as expected."""
    same = {"refusal_rate": F.lit(0.5), "mean_score": F.lit(0.5)}
    windows = J.monitor_alerts(J.monitor_aggregates(_gaps(t)).withColumns(same), 0.5, 0.5, 0.1)
    return _days(windows, "null_rate", "alert").drop(*same)


_POINTS = [i / 10 for i in range(1, 10)]
_CELLS = "[" + ", ".join(f"count(*) FILTER (WHERE value IS NOT NULL AND bin = {i})" for i in range(10)) + "]"
_BIN = " + ".join(f"CAST(value > b[{i}] AS INTEGER)" for i in range(1, 10))
_SHARES = "list_transform(cells, lambda c: (c + 0.5) / (rows - missing + 5.0))"
_DRIFT = dict(
    gaps=_GAPS,
    long="SELECT ts, 'proba' AS feature, proba AS value FROM gaps UNION ALL SELECT ts, 'income', CAST(SK_ID_CURR % 100 AS DOUBLE) * CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 2 ELSE 1 END FROM gaps",
    cuts=f"SELECT feature, quantile_cont(value, {_POINTS}) AS b FROM long WHERE ts < {SPLIT_AT} GROUP BY feature",
    binned=f"SELECT date_trunc('day', ts) AS day, ts < {SPLIT_AT} AS old, feature, value, {_BIN} AS bin FROM long JOIN cuts USING (feature)",
    ref=f"SELECT feature, count(*) AS rows, count(*) - count(value) AS missing, {_CELLS} AS cells FROM binned WHERE old GROUP BY 1",
    cur=f"SELECT day, feature, count(*) AS rows, count(*) - count(value) AS missing, {_CELLS} AS cells FROM binned GROUP BY 1, 2",
    refs=f"SELECT feature, missing / rows AS reference_null_rate, {_SHARES} AS q FROM ref",
    curs=f"SELECT day, feature, rows, missing / rows AS null_rate, {_SHARES} AS p FROM cur",
    psis="SELECT *, list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * ln(z[1] / z[2]))) AS psi FROM curs JOIN refs USING (feature)",
)
_DRIFT_ROWS = f"""SELECT strftime(day, '%Y-%m-%d') AS day, feature, rows, {r6('null_rate', 'null_rate')}, {r6('reference_null_rate', 'reference_null_rate')},
  {r6('psi', 'psi')}, psi > 0.2 OR abs(null_rate - reference_null_rate) > 0.1 AS alert FROM psis"""
_WATCHED = ["proba", "income"]


def _watched(t):
    later = F.col("ts") >= F.lit("2024-01-25").cast("timestamp")
    return _gaps(t).select("ts", "proba", ((F.col(ID) % 100) * F.when(later, 2).otherwise(1)).cast("double").alias("income"))


def _reference(t, rows):
    old = rows.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp"))
    return materialize(SD.reference_profile(old, _WATCHED), "reference")


def _by_day(windows):
    day = F.date_format("window_start", "yyyy-MM-dd").alias("day")
    return windows.select(day, "feature", "rows", "null_rate", "reference_null_rate", "psi", "alert")


@register("r3_feature_drift_batch", with_tables(_DRIFT_ROWS, "scored", **_DRIFT))
def r3_drift_batch(t):
    rows = _watched(t)
    return _by_day(SD.feature_drift(rows, _reference(t, rows), _WATCHED))


@register(
    "r3_feature_drift",
    with_tables(_DRIFT_ROWS + " WHERE day < (SELECT max(day) FROM psis)", "scored", **_DRIFT),
)
def r3_drift(t):
    """The same from a stream, against the stored reference; the last day stays open."""
    source, out = scratch_path(t.spark, "predictions"), scratch_path(t.spark, "drift")
    rows = _watched(t)
    rows.write.parquet(source)
    events = J.read_stream(t.spark, source, rows.schema)
    J.run_to_end(SD.feature_drift(events, _reference(t, rows), _WATCHED, delay="10 minutes"), out, scratch_path(t.spark, "progress"))
    return _by_day(t.spark.read.parquet(out))


@register("r3_monitor_batch", with_tables(_MONITOR, "scored", days=_WINDOWS))
def r3_batch(t):
    return _days(J.monitor_aggregates(_predicted(t)))


# ------------------------------------------------------------------ sources, sinks

# of 1200 clients in a row 1100 share one request, the others come in fifties
_REQUEST = f"CASE WHEN {ID} % 1200 < 1100 THEN {ID} // 1200 * 10 ELSE {ID} // 1200 * 10 + {ID} % 1200 // 50 - 21 END"
_REQUESTS = f"SELECT *, count(*) OVER (PARTITION BY request) AS n FROM (SELECT *, CAST({_REQUEST} AS BIGINT) AS request FROM app)"


def _batches(t):
    number = F.expr(_REQUEST.replace("//", "DIV")).cast("long")
    fields = t.app.select(number.alias("request"), ID, "AMT_CREDIT", "EXT_SOURCE_2", "OCCUPATION_TYPE")
    # at most 1100 clients a request
    whole = fields.groupBy("request").agg(F.collect_list(F.struct(*fields.columns[1:])).alias("clients"))
    asked = F.when(F.col("request") % 10 == 2, 1.5).when(F.col("request") % 10 == 1, 0.3).alias("threshold")
    bodies = whole.select("request", F.to_json(F.struct("clients", asked)).alias("body"))
    return I.read_batch_requests(bodies, "body", fields.drop("request").schema, ["request"])


@register(
    "p27_batch_requests",
    with_tables(
        f"""SELECT request, {r6('CASE WHEN request % 10 = 1 THEN 0.3 END', 'threshold')}, SK_ID_CURR, {r6('AMT_CREDIT', 'AMT_CREDIT')},
  {r6('EXT_SOURCE_2', 'EXT_SOURCE_2')}, OCCUPATION_TYPE FROM requests WHERE n <= 1000 AND request % 10 <> 2""",
        "app",
        requests=_REQUESTS,
    ),
)
def p27_batches(t):
    return _batches(t)[0]


@register(
    "p27_rejected_batches",
    with_tables(
        "SELECT DISTINCT request, CASE WHEN n > 1000 THEN 'clients' ELSE 'threshold' END AS reason FROM requests WHERE n > 1000 OR request % 10 = 2",
        "app",
        requests=_REQUESTS,
    ),
)
def p27_rejected(t):
    return _batches(t)[1].drop("body")


def _csv_round_trip(t, view: str, name: str):
    """Write a loan table as csv in the expected layout and read it back."""
    folder = scratch_path(t.spark, "csv")
    O.write_table(t.view(view), f"{folder}/{K.TABLE_FILES[name]}", "csv")
    return I.read_table(t.spark, folder, name)


def _view_sql(view: str, doubles: list[str], exclude: str = "") -> str:
    rounded = ", ".join(f"round(CAST({c} AS DOUBLE) + CAST(1e-08 AS DOUBLE), 6) AS {c}" for c in doubles)
    replace = f" REPLACE ({rounded})" if doubles else ""
    return with_tables(f"SELECT *{exclude}{replace} FROM {view}", view)


_APP_DOUBLES = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "CNT_FAM_MEMBERS", *Q.EXT, "OWN_CAR_AGE"]


@register("s1_applications", _view_sql("app", _APP_DOUBLES))
def s1(t):
    folder = scratch_path(t.spark, "csv")
    for split, name in (("train", "application_train"), ("test", "application_test")):
        part = t.app.where(F.col("split") == split).drop("split")
        part = part if split == "train" else part.drop(K.TARGET)
        O.write_table(part, f"{folder}/{K.TABLE_FILES[name]}", "csv")
    return I.read_applications(t.spark, folder).select(*t.app.columns)


@register(
    "s8_csv_types_from_values",
    with_tables(
        f"""
SELECT SK_ID_CURR, TARGET, DAYS_BIRTH, CASE WHEN SK_ID_CURR % 7 = 0 THEN NULL ELSE {r6('AMT_CREDIT', 'x').split(' AS x')[0]} END AS AMT_CREDIT,
  {r6('AMT_CREDIT / 3', 'SELLERPLACE_AREA')}, OCCUPATION_TYPE AS SOMETHING, (SELECT count(*) FROM app WHERE SK_ID_CURR % 7 = 0) AS unparsed FROM app""",
        "app",
    ),
)
def s8_csv(t):
    """Whole numbers written as 1.0, columns that no rule names, and cells that do not parse."""
    path = scratch_path(t.spark, "csv")
    odd = t.app.select(
        ID,
        F.col(K.TARGET).cast("double").alias(K.TARGET),
        F.col("DAYS_BIRTH").cast("double").alias("DAYS_BIRTH"),
        F.when(F.col(ID) % 7 == 0, "oops").otherwise(F.col("AMT_CREDIT").cast("string")).alias("AMT_CREDIT"),
        (F.col("AMT_CREDIT") / 3).alias("SELLERPLACE_AREA"),
        F.col("OCCUPATION_TYPE").alias("SOMETHING"),
    )
    O.write_table(odd, path, "csv")
    lost = I.unparsed_cells(t.spark, path).agg(F.sum("unparsed").alias("n"))
    return I.read_csv(t.spark, path).withColumn("unparsed", lost.scalar())


@register("s2_bureau", _view_sql("bureau", ["AMT_CREDIT_MAX_OVERDUE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT"]))
def s2(t):
    return _csv_round_trip(t, "bureau", "bureau")


@register("s2_bureau_balance", _view_sql("bureau_balance", []))
def s2_balance(t):
    return _csv_round_trip(t, "bureau_balance", "bureau_balance")


@register(
    "s3_previous_application",
    _view_sql("previous_application", ["AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT"]),
)
def s3(t):
    return _csv_round_trip(t, "previous_application", "previous_application")


@register(
    "s4_installments",
    _view_sql(
        "installments_payments",
        ["NUM_INSTALMENT_VERSION", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"],
    ),
)
def s4(t):
    return _csv_round_trip(t, "installments_payments", "installments_payments").withColumn(
        "NUM_INSTALMENT_NUMBER", F.col("NUM_INSTALMENT_NUMBER").cast("int")
    )


@register("s5_pos_cash", _view_sql("pos_cash", ["CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE"]))
def s5(t):
    return _csv_round_trip(t, "pos_cash", "pos_cash")


@register(
    "s6_credit_card",
    _view_sql("credit_card", ["AMT_BALANCE", "AMT_DRAWINGS_CURRENT", "AMT_PAYMENT_CURRENT"]),
)
def s6(t):
    return _csv_round_trip(t, "credit_card", "credit_card")


@register(
    "s7_preview",
    with_tables("SELECT SK_ID_CURR, AMT_CREDIT FROM app ORDER BY SK_ID_CURR LIMIT 1000", "app"),
    digits=None,
)
def s7(t):
    return I.preview(t.app.select(ID, "AMT_CREDIT"), 1000, ID)


@register("s8_source_resolution", "SELECT c_custkey, c_mktsegment FROM customer")
def s8(t):
    location = I.resolve_source(t.spark, None, f"{t.folder}/customer.parquet")
    return I.read_source(t.spark, location).select("c_custkey", "c_mktsegment")


@register(
    "s9_json_requests",
    with_tables(
        f"SELECT SK_ID_CURR, {r6('AMT_CREDIT', 'AMT_CREDIT')}, {r6('EXT_SOURCE_1', 'EXT_SOURCE_1')}, DAYS_BIRTH, OCCUPATION_TYPE FROM app WHERE SK_ID_CURR % 10 <> 0",
        "app",
    ),
)
def s9(t):
    fields = t.app.select(ID, "AMT_CREDIT", "EXT_SOURCE_1", "DAYS_BIRTH", "OCCUPATION_TYPE")
    body = F.when(F.col(ID) % 20 == 0, F.lit('{"threshold": 0.5}')).when(
        F.col(ID) % 10 == 0, F.lit('{"features": {}}')
    ).otherwise(F.to_json(F.struct(F.struct(*fields.columns).alias("features"))))
    good, _ = I.read_requests(fields.select(body.alias("body")), "body", fields.schema)
    return good


@register(
    "s9_rejected_requests",
    with_tables(
        """SELECT CASE WHEN SK_ID_CURR % 20 = 0 THEN '{"threshold": 0.5}' ELSE '{"features": {}}' END AS body, count(*) AS rows
FROM app WHERE SK_ID_CURR % 10 = 0 GROUP BY 1""",
        "app",
    ),
)
def s9_rejected(t):
    body = F.when(F.col(ID) % 20 == 0, F.lit('{"threshold": 0.5}')).when(
        F.col(ID) % 10 == 0, F.lit('{"features": {}}')
    ).otherwise(F.lit('{"features": {"AMT_CREDIT": "1"}}'))
    _, bad = I.read_requests(t.app.select(body.alias("body")), "body", t.app.select("AMT_CREDIT").schema)
    return bad.groupBy("body").agg(F.count(F.lit(1)).alias("rows"))


@register(
    "s10_csv_scoring",
    with_tables(
        f"SELECT SK_ID_CURR AS client_id, {r6('p', 'probability')}, CASE WHEN p >= 0.5 THEN '{K.REFUSED}' ELSE '{K.ACCEPTED}' END AS decision FROM sc",
        "app",
        feat=FEATURE_SELECT,
        sc=SCORED_APP,
    ),
)
def s10(t):
    upload, download = scratch_path(t.spark, "upload"), scratch_path(t.spark, "download")
    O.write_table(t.app.drop("split", K.TARGET), upload, "csv")
    scores = score(I.read_csv(t.spark, upload), SCORER, digits=None).select(
        "client_id", "probability", "decision"
    )
    O.write_table(scores, download, "csv")
    return I.read_csv(
        t.spark, download, overrides={"client_id": "long", "probability": "double"}
    )


@register(
    "s11_predictions",
    with_tables(
        f"""
SELECT SK_ID_CURR, {r6('proba', 'TARGET_PROBA')}, CASE WHEN proba >= 0.44 THEN 1 ELSE 0 END AS TARGET_PRED,
  CASE WHEN proba <= 0 THEN NULL WHEN proba <= 0.2 THEN 'Très faible' WHEN proba <= 0.4 THEN 'Faible'
  WHEN proba <= 0.6 THEN 'Modéré' WHEN proba <= 0.8 THEN 'Élevé' ELSE 'Très élevé' END AS RISK_CATEGORY FROM scored""",
        "scored",
    ),
)
def s11(t):
    path = scratch_path(t.spark, "predictions")
    O.write_table(O.predictions(t.scored, 0.44), path)
    return t.spark.read.parquet(path)


@register("s12_submission", with_tables(f"SELECT SK_ID_CURR, {r6('proba', 'TARGET')} FROM scored", "scored"))
def s12(t):
    path = scratch_path(t.spark, "submission")
    O.write_table(O.submission(t.scored), path, "csv")
    return I.read_csv(t.spark, path, overrides={K.TARGET: "double"})


@register(
    "s13_importance_table",
    with_tables(
        "SELECT feature, importance FROM importance",
        "app",
        importance=" UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS importance FROM app" for c in NUM),
    ),
)
def s13(t):
    path = scratch_path(t.spark, "importance")
    ranked = importance_ranking(column_stats(t.app, NUM, {"importance": F.count}))
    O.write_table(ranked.select("feature", "importance"), path, "csv")
    missing = scratch_path(t.spark, "absent")
    return O.read_first(t.spark, [missing, path], "feature string, importance bigint")


_LINES = [
    "CASE setting WHEN 'default' THEN 'SEUIL PAR DÉFAUT' ELSE 'SEUIL OPTIMAL' END || printf(' (%.2f)', threshold)",
    f"printf('  AUC:       %.4f', {EV.AUC_VALUE})",
    f"printf('  Accuracy:  %.4f', {EV._div('TP + TN', 'n')})",
    f"printf('  Precision: %.4f', {EV.PRECISION})",
    f"printf('  Recall:    %.4f', {EV.RECALL})",
    f"printf('  F1-Score:  %.4f', {EV.F1})",
    "format('  TP: {:,} | FP: {:,}', TP, FP)",
    "format('  FN: {:,} | TN: {:,}', FN, TN)",
    f"format('  Coût métier: {{:,}}', CAST({EV.COST} AS BIGINT))",
    f"format('  Réduction du coût: {{:,}} (', CAST({EV._BASE} - {EV.COST} AS BIGINT)) || printf('%.1f%%)', ({EV._BASE} - {EV.COST}) / {EV._BASE} * 100)",
]


@register(
    "s14_settings_and_report",
    with_tables(
        " UNION ALL ".join(
            f"SELECT setting, CAST({i} AS INTEGER) AS line, {text} AS text, {r6('(SELECT threshold FROM best)', 'stored_threshold')} FROM two, ranks"
            for i, text in enumerate(_LINES)
        ),
        "scored",
        grid=EV.GRID,
        curve=EV.CURVE,
        best=EV.BEST,
        two=EV._TWO,
        ranks=EV.AUC,
    ),
)
def s14(t):
    """The lines of the report as they are read back, beside the threshold of the settings file."""
    best = E.optimal_threshold(E.threshold_curve(t.scored)).first()
    path = scratch_path(t.spark, "settings")
    O.write_settings(t.spark, {"optimal_threshold": best["threshold"], "cost_fn": K.COST_FN}, path)
    back = O.read_settings(t.spark, path)
    report = scratch_path(t.spark, "report")
    O.write_table(O.report_lines(E.metrics_report(t.scored)), report)
    stored = F.lit(float(back["optimal_threshold"])).alias("stored_threshold")
    return t.spark.read.parquet(report).select("setting", "line", "text", stored)


_INVENTORY = ["app", "bureau", "bureau_balance", "previous_application", "installments_payments", "pos_cash", "credit_card"]
_WIDTHS = {"app": 21, "bureau": 7, "bureau_balance": 3, "previous_application": 6, "installments_payments": 8, "pos_cash": 7, "credit_card": 7}


@register(
    "s15_table_inventory",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{n}' AS table_name, TRUE AS present, count(*) AS rows, CAST({_WIDTHS[n]} AS BIGINT) AS columns FROM {n}"
            for n in _INVENTORY
        )
        + " UNION ALL SELECT 'application_extra', FALSE, CAST(0 AS BIGINT), CAST(0 AS BIGINT)",
        *_INVENTORY,
    ),
)
def s15(t):
    return I.inventory({**t.loan_tables(), "application_extra": None}).drop("column_names")


@register(
    "s16_run_log",
    with_tables(
        f"""
SELECT 'run-' || i AS run_id, {r6('auc', 'val_auc')}, {r6('i / 100', 'optimal_threshold')} FROM (
  SELECT CAST(i AS INTEGER) AS i, (SELECT avg(proba) FROM scored) AS auc FROM range(3, 13) t(i))""",
        "scored",
    ),
)
def s16(t):
    """Twelve logged runs; the ten most recent come back."""
    mean = t.scored.agg(F.avg("proba")).first()[0]
    path = scratch_path(t.spark, "runs")
    for i in range(1, 13):
        metrics = {"val_auc": mean, "optimal_threshold": i / 100}
        O.append_run(t.spark, path, f"run-{i}", datetime(2024, 1, i), {"trees": 500}, metrics)
    return O.last_runs(t.spark, path).select("run_id", "val_auc", "optimal_threshold")
