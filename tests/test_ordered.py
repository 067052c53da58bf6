"""Running totals and quantiles on skewed data, against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import drift as D
from loanloom.operators import ordered as O
from loanloom.operators.compare import value_positions
from loanloom.operators.skew import lookup_join

POINTS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def skewed(n=6000, seed=1):
    """A third of all rows hold one value; the rest is heavy-tailed, partly missing."""
    rng = np.random.default_rng(seed)
    values = np.exp(rng.normal(0, 4, n))
    values[: n // 3] = 7.0
    values[-5:] = 1e12
    rng.shuffle(values)
    return values


@pytest.fixture(scope="module")
def frame(spark):
    a, b = skewed(seed=1), np.round(skewed(seed=2))
    rows = [
        (i % 2, float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))
    ]
    return spark.createDataFrame(rows, "g int, a double, b double").repartition(6).persist()


def expected(frame, column, where=None):
    rows = frame.where(where).collect() if where else frame.collect()
    return np.array([r[column] for r in rows if r[column] is not None])


def test_quantiles_are_exact(frame):
    rows = {r["feature"]: r for r in O.quantiles(frame, ["a", "b"], POINTS).collect()}
    for column in ("a", "b"):
        want = np.quantile(expected(frame, column), POINTS)
        got = [rows[column][O._name(p)] for p in POINTS]
        assert got == pytest.approx(want, rel=1e-12)


def test_quantiles_by_group(frame):
    rows = O.quantiles(frame, ["a"], [0.5], ["g"]).collect()
    assert {r["g"]: r["q50"] for r in rows} == pytest.approx(
        {g: float(np.median(expected(frame, "a", f"g = {g}"))) for g in (0, 1)}
    )


def test_order_bits_are_those_of_the_binary_form(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308]
    values += [float("inf"), float("-inf"), -1.7976931348623157e308, 1 - 2**-53, 2 - 2**-52]
    values += [float(x) for x in np.frombuffer(rng.bytes(16_000), "<f8") if np.isfinite(x)]
    values += [2.0**i for i in range(-1074, 1024)] + [float(np.nextafter(2.0**i, 0)) for i in range(-1000, 1024)]

    def bits(x):
        size = int(np.float64(abs(x) + 0.0).view(np.int64))
        return -size if x < 0 else size

    frame = spark.createDataFrame([(v,) for v in values], "value double")
    rows = O.with_order_bits(frame).collect()
    assert all(r["bits"] == bits(r["value"]) for r in rows)
    assert O.with_order_bits(frame.select(F.lit(float("nan")).alias("value"))).first()["bits"] > max(r["bits"] for r in rows)


@pytest.mark.parametrize("finish", [0, 40, 3000])
def test_quantiles_by_several_digits(frame, monkeypatch, finish):
    monkeypatch.setattr(O, "FINISH", finish)
    rows = {(r["g"], r["feature"]): r for r in O.quantiles(frame, ["a", "b"], POINTS, ["g"]).collect()}
    for g in (0, 1):
        for column in ("a", "b"):
            want = np.quantile(expected(frame, column, f"g = {g}"), POINTS)
            assert [rows[g, column][O._name(p)] for p in POINTS] == pytest.approx(want, rel=1e-12)


def test_quantiles_shuffle_no_values(spark, frame, monkeypatch):
    """What the scans shuffle is one row per feature and digit, whatever the number of values."""
    monkeypatch.setattr(O, "FINISH", 0)
    plan = O.quantiles(frame, ["a", "b"], [0.5])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    wide = frame.crossJoin(spark.range(1)).withColumn("a", F.col("a") + F.rand(1) * 1e-9)
    counted = O._digit_counts(
        wide.select(F.lit("a").alias("feature"), F.col("a").alias("value")), ["feature"], 52, [F.lit(0), F.col("n_all") - 1], None
    )
    assert len(counted.rows) == 2  # of 6000 different values


def test_quantiles_of_nothing(frame):
    assert O.quantiles(frame.where("1 = 0"), ["a"], [0.5]).collect() == []


def test_unknown_quantile_method_is_refused(frame):
    with pytest.raises(ValueError):
        O.quantiles(frame, ["a"], [0.5], method="auto")


def test_running_totals(frame):
    counts = frame.groupBy("g", "a").agg(F.count(F.lit(1)).alias("n"))
    rows = O.running_totals(counts, ["g"], "a", ["n"]).collect()
    for g in (0, 1):
        values = expected(frame, "a", f"g = {g}")
        got = sorted((r["a"], r["n_below"], r["n_upto"], r["n_all"]) for r in rows if r["g"] == g)
        for v, below, upto, whole in got[:: max(1, len(got) // 50)]:
            assert (below, upto, whole) == ((values < v).sum(), (values <= v).sum(), len(values))


def test_hot_value_stays_one_row_before_the_ordering(frame):
    counts = frame.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    assert counts.where("a = 7").first()["n"] == 2000


def test_ks_equals_brute_force(spark):
    a, b = skewed(seed=5), skewed(seed=6) * 1.3
    ref = spark.createDataFrame([(float(x),) for x in a], "x double")
    cur = spark.createDataFrame([(float(x),) for x in b], "x double")
    row = D.ks_test(D.pair(ref, cur), ["x"]).first()
    grid = np.concatenate([a, b])
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert row["statistic"] == pytest.approx(np.abs(fa - fb).max())


def test_ks_without_values_on_one_side(spark):
    ref = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    cur = spark.createDataFrame([(None,)], "x double")
    row = D.ks_test(D.pair(ref, cur), ["x"]).first()
    assert row["statistic"] is None and row["p_value"] is None


# tabulated upper tails of the chi-squared distribution
@pytest.mark.parametrize(
    "x, dof, p",
    [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.070498, 5, 0.05), (18.307038, 10, 0.05), (6.634897, 1, 0.01)],
)
def test_chi2_tail(spark, x, dof, p):
    df = spark.createDataFrame([(x, dof)], "x double, k int")
    assert df.select(D.chi2_tail(F.col("x"), F.col("k")).alias("p")).first()["p"] == pytest.approx(p, rel=1e-5)


def test_chi2_statistic(spark):
    ref = spark.createDataFrame([("a",)] * 30 + [("b",)] * 70, "c string")
    cur = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "c string")
    row = D.chi2_test(D.pair(ref, cur), ["c"]).first()
    assert row["statistic"] == pytest.approx(8.3333333)
    assert row["dof"] == 1
    assert row["p_value"] == pytest.approx(0.003892, rel=1e-3)


def test_positions_of_unknown_values(spark, frame):
    asked = spark.createDataFrame([(-1.0,), (7.0,), (8.5,), (1e13,)], "a double")
    got = {r["value"]: r["percentile"] for r in value_positions(frame, asked, ["a"]).collect()}
    values = expected(frame, "a")
    assert got == pytest.approx({v: (values < v).mean() * 100 for v in (-1.0, 7.0, 8.5, 1e13)})


def test_lookup_join_keeps_every_fact(spark):
    facts = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), "id"
    )
    lookup = facts.groupBy("k").agg(F.count(F.lit(1)).alias("w")).withColumn("v", F.col("k") * 2)
    lookup = lookup.where("k <> 17")
    joined = lookup_join(facts, lookup, ["k"], "w")
    assert joined.count() == 9000
    assert joined.where("v is null").select("k").distinct().collect()[0]["k"] == 17
    assert joined.where("v is not null and v <> 2 * k").count() == 0
