"""Requests of many clients, and drift of features while a stream runs."""

import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom.operators import drift as D
from loanloom.session import scratch_path
from loanloom.sources import readers as I
from loanloom.streaming import drift as SD
from loanloom.streaming import jobs as J

DAY = datetime(2024, 3, 1)
ROWS = "ts timestamp, x double, y double"


def day(n, values, y=1.0):
    return [(DAY + timedelta(days=n, minutes=i), v, y) for i, v in enumerate(values)]


@pytest.fixture(scope="module")
def profile(spark):
    old = spark.createDataFrame(day(0, [float(i) for i in range(100)], y=None), ROWS)
    path = scratch_path(spark, "profile")
    SD.reference_profile(old, ["x", "y"]).write.parquet(path)
    return spark.read.parquet(path)


def test_reference_without_values(profile):
    rows = {r["feature"]: r for r in profile.collect()}
    assert len(rows["x"]["shares"]) == 10 and sum(rows["x"]["shares"]) == pytest.approx(1)
    assert rows["y"]["bounds"] is None and rows["y"]["shares"] is None and rows["y"]["null_rate"] == 1.0


def test_index_and_alerts_by_hand(spark, profile):
    new = day(1, [float(i) for i in range(100)], None) + day(2, [99.0] * 100, None) + day(3, [None] * 50 + [50.0], None)
    df = spark.createDataFrame(new + [(None, 1.0, 1.0)], ROWS)
    found = {(r["window_start"].day, r["feature"]): r for r in SD.feature_drift(df, profile, ["x", "y"]).collect()}
    assert len(found) == 6  # the row without a time belongs to no window
    assert found[2, "x"]["psi"] == pytest.approx(0) and not found[2, "x"]["alert"]
    full, none, old = 100.5 / 105, 0.5 / 105, 0.1
    psi = (full - old) * math.log(full / old) + 9 * (none - old) * math.log(none / old)
    assert found[3, "x"]["psi"] == pytest.approx(psi) and found[3, "x"]["alert"]
    assert found[4, "x"]["null_rate"] == pytest.approx(50 / 51) and found[4, "x"]["alert"]
    assert found[2, "y"]["psi"] is None and not found[2, "y"]["alert"]


def test_stream_equals_batch_on_closed_windows(spark, profile):
    """Days arrive file by file; a row of a closed day that comes late is left out."""
    source, out = scratch_path(spark, "arrivals"), scratch_path(spark, "drift")
    days = [day(n, [float((i * (n + 1)) % 100) for i in range(80)]) for n in range(4)]
    for rows in [*days, day(0, [5.0] * 7), day(5, [1.0])]:
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(source)
        # each arrival is a run of its own; progress and state are taken up again
        stream = J.read_stream(spark, source, spark.createDataFrame([], ROWS).schema)
        watched = SD.feature_drift(stream, profile, ["x", "y"], delay="10 minutes")
        J.run_to_end(watched, out, f"{out}-progress")
    batch = SD.feature_drift(spark.createDataFrame(sum(days, []), ROWS), profile, ["x", "y"])

    def rows_of(df):
        return sorted((r["window_start"], r["feature"], r["rows"], r["null_rate"], round(r["psi"] or 0, 9), r["alert"]) for r in df.collect())

    assert rows_of(spark.read.parquet(out)) == rows_of(batch)


def test_drift_of_nothing(spark, profile):
    assert SD.feature_drift(spark.createDataFrame([], ROWS), profile, ["x", "y"]).count() == 0


def test_missing_scores_alert(spark):
    windows = spark.createDataFrame(
        [(0.3, 0.4, 0.0), (0.3, 0.4, 0.2), (None, None, 1.0), (None, None, 0.0)],
        "refusal_rate double, mean_score double, null_rate double",
    )
    assert [r["alert"] for r in J.monitor_alerts(windows, 0.3, 0.4).collect()] == [False, True, True, False]
    assert [r["alert"] for r in J.monitor_alerts(windows, 0.3, 0.4, 0.1, 0.2).collect()] == [True, False, True, True]


def test_requests_of_many_clients(spark):
    schema = T.StructType.fromDDL("SK_ID_CURR long, AMT double, NAME string")
    client = {"SK_ID_CURR": 7, "AMT": "1.5", "NAME": "a", "more": 1}
    bodies = [
        {"clients": [client, {"SK_ID_CURR": "x"}], "threshold": 0.25},
        {"clients": [client] * 1000},
        {"clients": [client] * 1001},
        {"clients": []},
        {"threshold": 0.5},
        {"clients": [client], "threshold": 1.01},
        {"clients": [client], "threshold": "much"},
    ]
    texts = [json.dumps(b) for b in bodies] + ["{", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "request int, text string")
    good, bad = I.read_batch_requests(df, "text", schema, ["request"])
    counts = {r["request"]: r["n"] for r in good.groupBy("request").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {0: 2, 1: 1000}
    first = sorted(good.where("request = 0").collect(), key=lambda r: r["SK_ID_CURR"] is None)
    assert first[0][1:] == (0.25, 7, 1.5, "a") and first[1][1:] == (0.25, None, None, None)
    reasons = {r["request"]: r["reason"] for r in bad.collect()}
    assert reasons == {2: "clients", 3: "clients", 4: "clients", 5: "threshold", 6: "threshold", 7: "clients", 8: "clients", 9: "clients"}
    assert good.columns == ["request", "threshold", "SK_ID_CURR", "AMT", "NAME"]


def test_tail_is_built_once(spark):
    """Series, continued fraction and normal tail agree with known values and share one expression."""
    cases = [(3.84, 1, 0.05004), (0.5, 10, 0.99999), (18.307, 10, 0.05), (5000.0, 5000, 0.4973), (5200.0, 5000, 0.0241), (0.0, 3, 1.0)]
    df = spark.createDataFrame([(s, d) for s, d, _ in cases], "s double, d int")
    got = [r["p"] for r in df.select(D.chi2_tail(F.col("s"), F.col("d")).alias("p")).collect()]
    assert got == [pytest.approx(p, abs=5e-4) for _, _, p in cases]
