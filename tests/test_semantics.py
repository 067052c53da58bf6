"""Missing-value and ordering rules that differ from Spark's defaults."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import decision as D
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.functions import text as X
from loanloom.operators import aggregates as A
from loanloom.operators import applicant as P
from loanloom.operators import profile as R
from loanloom.operators import reshape as H
from loanloom.operators.histogram import histogram
from loanloom.plans.spine import build_spine
from loanloom.sources import readers as I


def test_sum_of_missing_values_is_zero_but_unmatched_clients_stay_null(spark):
    card = spark.createDataFrame(
        [(1, -1, 10.0, 100, None, None, 0), (1, -2, 5.0, 0, None, 2.0, 3)],
        "SK_ID_CURR long, MONTHS_BALANCE int, AMT_BALANCE double, AMT_CREDIT_LIMIT_ACTUAL long,"
        "AMT_DRAWINGS_CURRENT double, AMT_PAYMENT_CURRENT double, SK_DPD long",
    )
    app = spark.createDataFrame([(1, "train"), (2, "train")], "SK_ID_CURR long, split string")
    rows = {r[0]: r for r in build_spine({"app": app, "credit_card": card}).table.collect()}
    assert rows[1]["CC_AMT_DRAWINGS_CURRENT_SUM"] == 0.0
    assert rows[1]["CC_AMT_DRAWINGS_CURRENT_MEAN"] is None
    assert rows[1]["CC_CC_LATE_SUM"] == 1
    assert rows[1]["CC_CC_UTILIZATION_MAX"] == 5.0
    assert rows[2]["CC_AMT_DRAWINGS_CURRENT_SUM"] is None


def test_row_statistics_skip_missing(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 6.0), (1.0, None, 3.0), (None, None, 5.0), (None, None, None)],
        "a double, b double, c double",
    )
    cols = [F.col(c) for c in "abc"]
    rows = df.select(
        G.row_sum(cols).alias("s"), G.row_mean(cols).alias("m"), G.row_std(cols).alias("d"),
        G.row_min(cols).alias("lo"), G.row_max(cols).alias("hi"),
    ).collect()
    assert [r["s"] for r in rows] == [9.0, 4.0, 5.0, 0.0]
    assert [r["m"] for r in rows] == [3.0, 2.0, 5.0, None]
    assert rows[0]["d"] == pytest.approx(2.6457513)
    assert rows[1]["d"] == pytest.approx(1.4142136)
    assert rows[2]["d"] is None and rows[3]["d"] is None
    assert [r["lo"] for r in rows] == [1.0, 1.0, 5.0, None]
    assert [r["hi"] for r in rows] == [6.0, 3.0, 5.0, None]


def test_unknown_comparison_is_not_late(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, 3.0), (None, 3.0)], "DAYS_ENTRY_PAYMENT double, DAYS_INSTALMENT double")
    df = df.withColumns({"AMT_PAYMENT": F.lit(1.0), "AMT_INSTALMENT": F.lit(2.0)})
    assert [r["LATE_PAYMENT"] for r in A.payment_lateness(df).collect()] == [1, 0, 0]
    status = spark.createDataFrame([("Approved",), ("Refused",), (None,)], "NAME_CONTRACT_STATUS string")
    rows = A.status_flags(status).collect()
    assert [(r[1], r[2]) for r in rows] == [(1, 0), (0, 1), (0, 0)]


def test_employment_marker(spark):
    df = spark.createDataFrame([(365243,), (-730,)], "DAYS_EMPLOYED long")
    years = lambda mode: [r[0] for r in df.select(P.year_columns(df.columns, mode)["EMPLOYED_YEARS"]).collect()]
    assert years("null") == [None, 2.0]
    assert years("as_is") == [pytest.approx(-1000.6657534), 2.0]
    with pytest.raises(ValueError):
        P.employed_days("other")


def test_zero_denominator_gives_null(spark):
    df = spark.createDataFrame([(5.0, -1.0), (5.0, 0.0)], "AMT_CREDIT double, AMT_INCOME_TOTAL double")
    rows = P.application_features(df).collect()
    assert [r["CREDIT_INCOME_RATIO"] for r in rows] == [None, 5.0]


def test_missing_inputs_leave_derivations_out(spark):
    df = spark.createDataFrame([(1, 10.0)], "SK_ID_CURR long, AMT_CREDIT double")
    assert P.application_features(df).columns == ["SK_ID_CURR", "AMT_CREDIT"]


def test_supplied_ratio_is_overwritten_when_inputs_are_present(spark):
    df = spark.createDataFrame([(9.0, 2.0, 99.0)], "AMT_CREDIT double, AMT_INCOME_TOTAL double, CREDIT_INCOME_RATIO double")
    assert P.application_features(df).first()["CREDIT_INCOME_RATIO"] == 3.0


def test_request_ratios(spark):
    df = spark.createDataFrame(
        [(100.0, 300.0, None), (0.0, 300.0, None), (100.0, 300.0, 7.0)],
        "AMT_INCOME_TOTAL double, AMT_CREDIT double, CREDIT_INCOME_RATIO double",
    )
    rows = P.fill_request_ratios(df).collect()
    assert [r["CREDIT_INCOME_RATIO"] for r in rows] == [3.0, 0.0, 7.0]
    assert [r["EXT_SOURCE_MEAN"] for r in rows] == [0.5] * 3


def test_bands_differ_on_their_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.4,), (0.8,), (1.0,)], "p double")
    rows = df.select(D.risk_band(F.col("p")).alias("l"), D.risk_band_right_closed(F.col("p")).alias("r")).collect()
    assert [r["l"] for r in rows] == ["Très faible", "Faible", "Modéré", "Très élevé", "Très élevé"]
    assert [r["r"] for r in rows] == [None, "Très faible", "Faible", "Élevé", "Très élevé"]


def test_threshold_resolution():
    assert D.resolve_threshold(0.3, {"optimal_threshold": 0.4}) == 0.3
    assert D.resolve_threshold(None, {"optimal_threshold": 0.4}) == 0.4
    assert D.resolve_threshold(None, {}, 0.5) == 0.5
    assert D.resolve_threshold() == 0.44


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (0, 2.0, None), (1, 2.0, 3.0), (0, 2.0, 5.0)], "TARGET int, c double, x double")
    rows = {r["feature"]: r["correlation"] for r in R.target_correlations(df, ["c", "x"]).collect()}
    assert rows["c"] is None
    assert rows["x"] == pytest.approx(-0.8660254)


def test_mode_takes_the_smallest_of_tied_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "x string")
    row = R.describe_categories(df, ["x"]).first()
    assert (row["top"], row["freq"], row["unique"], row["count"]) == ("a", 2, 3, 5)


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], ["Feature One", "Feature (Two)", "Feature[Three]", "a,b", "c:d", "e/f"])
    assert S.clean_names(df).columns == ["Feature_One", "Feature__Two_", "Feature_Three_", "a_b", "c_d", "e_f"]
    with pytest.raises(ValueError):
        S.clean_names(spark.createDataFrame([(1, 2)], ["a b", "A(b"]))


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(1, 1000, 127, 1.1, "x"), (3, 3000, 1, 3.3, "y")], "a long, b long, c long, d double, e string"
    )
    assert [t for _, t in H.narrow_types(df).dtypes] == ["tinyint", "smallint", "smallint", "float", "string"]


def test_sparse_columns_use_a_strict_limit(spark):
    df = spark.createDataFrame([(i, 1.0 if i == 0 else None, None) for i in range(5)], "k int, a double, b double")
    assert H.sparse_columns(df, 0.8) == ["b"]


def test_coercion(spark):
    ref = spark.createDataFrame([], "n long, x double, s string").schema
    df = spark.createDataFrame([("2.5", "inf", "a"), ("3.5", "1e3", None), ("zz", "nan", "b")], "n string, x string, s string")
    rows = H.coerce_types(df, ref).collect()
    assert [tuple(r) for r in rows] == [(2, None, "a"), (4, 1000.0, None), (None, None, "b")]
    row = df.select(H.safe_number(F.col("n"), 9).alias("f"), H.safe_whole(F.col("n"), 9).alias("i")).collect()
    assert [tuple(r) for r in row] == [(2.5, 2), (3.5, 4), (9.0, 9)]


def test_validation_limits():
    H.check_request_size(1)
    H.check_request_size(1000)
    for n in (0, 1001):
        with pytest.raises(ValueError):
            H.check_request_size(n)
    with pytest.raises(ValueError):
        H.check_threshold(1.2)


def test_nested_non_finite_values(spark):
    df = spark.createDataFrame([({"a": float("nan"), "b": 1.0}, [float("inf"), 2.0])], "m map<string,double>, l array<double>")
    row = H.finite_only(df).first()
    assert row["m"] == {"a": None, "b": 1.0} and row["l"] == [None, 2.0]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,), (None,)], "x double")
    rows = histogram(df, "x", 10).orderBy("bin").collect()
    assert [r["rows"] for r in rows] == [1, 1, 1, 0, 0, 0, 0, 0, 0, 1]
    assert sum(r["density"] for r in rows) == pytest.approx(1.0)
    flat = histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x", 4).collect()
    assert sum(r["rows"] for r in flat) == 2


def test_tag_detection(spark):
    tagged = spark.createDataFrame([("a|b",), ("b | c",), ("a|d",), ("x",), (None,)], "t string")
    assert X.detect_delimiter(tagged, "t") == "|"
    assert {r["tag"]: r["rows"] for r in X.tag_frequency(tagged, "t", "|").collect()} == {
        "a": 2, "b": 2, "c": 1, "d": 1, "x": 1
    }
    few = spark.createDataFrame([("a|b",), ("a|b",), ("plain",)], "t string")
    assert X.detect_delimiter(few, "t") is None
    lists = spark.createDataFrame([("[a, b]",), ("(c)",)], "t string")
    assert X.detect_delimiter(lists, "t") == ","
    assert {r["tag"] for r in X.tag_frequency(lists, "t", ",").collect()} == {"a", "b", "c"}


def test_signature_ignores_column_order(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    first = df.select(X.row_signature(["a", "b", "c"]).alias("s")).first()["s"]
    assert first == df.select(X.row_signature(["c", "b", "a"]).alias("s")).first()["s"]
    assert df.select(X.slug(F.lit("  Très Élevé (x) ")).alias("s")).first()["s"] == "tr_s_lev_x"


def test_missing_tokens_become_null(spark, tmp_path):
    folder = tmp_path / "bureau.csv"
    folder.write_text(
        "SK_ID_BUREAU,SK_ID_CURR,CREDIT_ACTIVE,AMT_CREDIT_SUM\n1,10,NA,5.5\n2,10,XNA,NaN\n3,11,,N/A\n"
    )
    rows = I.read_table(spark, str(tmp_path), "bureau").orderBy("SK_ID_BUREAU").collect()
    assert [r["CREDIT_ACTIVE"] for r in rows] == [None, "XNA", None]
    assert [r["AMT_CREDIT_SUM"] for r in rows] == [5.5, None, None]


def test_missing_application_file_is_an_error(spark, tmp_path):
    (tmp_path / "application_train.csv").write_text("SK_ID_CURR,TARGET\n1,0\n")
    with pytest.raises(FileNotFoundError):
        I.read_applications(spark, str(tmp_path))
    (tmp_path / "application_test.csv").write_text("SK_ID_CURR\n2\n")
    tables = I.read_loan_tables(spark, str(tmp_path))
    assert list(tables) == ["app"]
    spine = build_spine(tables)
    assert spine.table.count() == 2 and "bureau" in spine.skipped
    assert spine.table.where("split = 'test'").first()["TARGET"] is None


def test_source_resolution(spark):
    assert I.resolve_source(spark, "a", "b") == "a"
    assert I.resolve_source(spark, None, "b") == "b"
    spark.conf.set(I.SOURCE_SETTING, "c")
    assert I.resolve_source(spark, None, "b") == "c"
    spark.conf.unset(I.SOURCE_SETTING)
    with pytest.raises(ValueError):
        I.resolve_source(spark, None, None)


NORMAL = {k: v for k, v in K.DEFAULT_RECORD.items()}
CLIENTS = {
    "normal": NORMAL,
    "low_risk": {**NORMAL, "AMT_INCOME_TOTAL": 300000.0, "AMT_CREDIT": 200000.0, "EXT_SOURCE_1": 0.85, "EXT_SOURCE_2": 0.8, "EXT_SOURCE_3": 0.82},
    "high_risk": {**NORMAL, "AMT_INCOME_TOTAL": 50000.0, "AMT_CREDIT": 800000.0, "EXT_SOURCE_1": 0.1, "EXT_SOURCE_2": 0.15, "EXT_SOURCE_3": 0.12},
    "huge_income": {**NORMAL, "AMT_INCOME_TOTAL": 1e8},
    "no_income": {**NORMAL, "AMT_INCOME_TOTAL": 0.0},
    "newborn": {**NORMAL, "DAYS_BIRTH": 0},
    "no_scores": {**NORMAL, "EXT_SOURCE_1": None, "EXT_SOURCE_2": None, "EXT_SOURCE_3": None},
}


def test_named_clients_get_a_probability(spark):
    from loanloom.catalog.models import SCORER
    from loanloom.plans.scoring import score

    schema = "SK_ID_CURR long, " + ", ".join(
        f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in NORMAL.items()
    )
    rows = [(i, *c.values()) for i, c in enumerate(CLIENTS.values())]
    scored = score(spark.createDataFrame(rows, schema), SCORER, 0.44).collect()
    by_name = {name: r for name, r in zip(CLIENTS, sorted(scored, key=lambda r: r["client_id"]))}
    assert all(0 <= r["probability"] <= 1 for r in scored)
    assert by_name["low_risk"]["probability"] < by_name["normal"]["probability"] < by_name["high_risk"]["probability"]
    stats = P.application_features(spark.createDataFrame(rows, schema)).where("SK_ID_CURR = 6").first()
    assert stats["EXT_SOURCE_STD"] is None and stats["EXT_SOURCE_MEAN"] is None


def test_correlation_matrix_of_many_columns(spark):
    """Two scans for any width; pairs over the rows that have both values; far means, constants and empty columns."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40))
    x[:, 1] += 1e7
    x[:, 2], x[:, 3] = 3.7, np.nan
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"c{i}" for i in range(40)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    frame = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    matrix = R.correlation_matrix(frame, names)
    got = {(r["left"], r["right"]): r["correlation"] for r in matrix.collect()}
    assert len(got) == 40 * 39 // 2
    for i in range(40):
        for j in range(i + 1, 40):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 2 in (i, j) or 3 in (i, j):
                assert got[names[i], names[j]] is None
            else:
                want = np.corrcoef(x[both, i], x[both, j])[0, 1]
                assert got[names[i], names[j]] == pytest.approx(want, abs=1e-7)
    plan = matrix._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Expand [" not in plan and "Generate " not in plan
