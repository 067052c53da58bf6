"""Preprocessing, splits, training and explanations."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.operators import explain as X
from loanloom.operators import sampling
from loanloom.plans import preprocessor as M
from loanloom.plans import training as T
from loanloom.plans.scoring import LinearScorer, what_if
from loanloom.sources import sinks as O
from loanloom.streaming import jobs as J

ID = K.CLIENT_KEY


@pytest.fixture(scope="module")
def clients(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(400):
        x = float(rng.normal())
        risk = 1 / (1 + np.exp(-(2 * x - 1.5)))
        rows.append(
            (
                100001 + i,
                int(rng.random() < risk),
                x,
                float(rng.uniform(0, 100)) if i % 4 else None,
                ["Laborers", "Managers", None, "Zoo"][int(rng.integers(4))],
            )
        )
    df = spark.createDataFrame(rows, "SK_ID_CURR long, TARGET int, x double, y double, job string")
    return df.withColumn("empty", F.lit(None).cast("double")).repartition(4).persist()


def test_transform_leaves_no_missing_value(clients):
    fitted = M.ClientPreprocessor().fit(clients)
    out = fitted.transform(clients)
    assert fitted.feature_names == ["x", "y", "job"]
    assert "empty" in fitted.state.dropped and "TARGET" not in fitted.feature_names
    nulls = out.select([F.count_if(F.col(c).isNull()).alias(c) for c in fitted.feature_names]).first()
    assert set(nulls) == {0}
    assert out.count() == clients.count()


def test_transform_before_fit_is_an_error(clients):
    with pytest.raises(ValueError):
        M.ClientPreprocessorModel(None).transform(clients)


def test_unknown_imputation_is_refused():
    with pytest.raises(ValueError):
        M.ClientPreprocessor(impute="guess")


def test_class_codes_and_unseen_classes(spark, clients):
    fitted = M.ClientPreprocessor().fit(clients)
    seen = [("Laborers", 0.0), (None, 1.0), ("Managers", 2.0), ("Zoo", 3.0), ("Unseen", 1.0)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(seen)], "SK_ID_CURR long, job string")
    assert [r["job"] for r in fitted.transform(df).orderBy(ID).collect()] == [c for _, c in seen]
    # without a missing value in the fit, an unseen class takes the next free code
    full = M.ClientPreprocessor().fit(clients.where("job is not null"))
    codes = {r[ID]: r["job"] for r in full.transform(df).collect()}
    assert codes == {0: 0.0, 1: 3.0, 2: 1.0, 3: 2.0, 4: 3.0}


def test_absent_text_column_takes_the_fill(spark, clients):
    fitted = M.ClientPreprocessor().fit(clients)
    df = spark.createDataFrame([(1, 0.5, "extra")], "SK_ID_CURR long, x double, more string")
    row = fitted.transform(df).first()
    fill = {c.name: c.fill for c in fitted.state.columns}
    assert (row["x"], row["y"], row["job"]) == (0.5, fill["y"], fill["job"])
    assert "more" not in row


def test_many_classes_keep_their_sorted_codes(spark, clients):
    many = spark.range(3000).select(
        F.col("id").alias(ID),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 1500)).alias("job"),
    )
    joined = M.ClientPreprocessor().fit(many).transform(many)
    codes = {name: float(i) for i, name in enumerate(sorted(r["job"] for r in many.select("job").distinct().collect()))}
    names = {r[ID]: r["job"] for r in many.collect()}
    assert {r[ID]: r["job"] for r in joined.collect()} == {i: codes[n] for i, n in names.items()}


def test_large_label_table_survives_saving(spark, clients, tmp_path):
    fitted = M.ClientPreprocessor(scale=True).fit(clients)
    fitted.save(spark, str(tmp_path))
    again = M.ClientPreprocessorModel.load(spark, str(tmp_path))
    assert again.state.labels_path.startswith(str(tmp_path))
    assert fitted.transform(clients).exceptAll(again.transform(clients)).count() == 0


def test_scaling_uses_the_population_deviation(spark):
    df = spark.createDataFrame([(1, 1.0, 4.0), (2, 2.0, 4.0), (3, 3.0, 4.0)], "SK_ID_CURR long, x double, c double")
    out = M.ClientPreprocessor(scale=True).fit(df).transform(df).orderBy(ID).collect()
    assert [r["x"] for r in out] == pytest.approx([-1.2247449, 0.0, 1.2247449])
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0]


def test_median_is_the_midpoint(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 10.0, 20.0, None])], "SK_ID_CURR long, x double")
    assert M.ClientPreprocessor().fit(df).state.columns[0].fill == 6.0


@pytest.mark.parametrize("fraction", [0.0, 0.1, 0.5, 1.0])
def test_sample_is_exact_and_repeatable(clients, fraction):
    first = {r[ID] for r in sampling.sample_fraction(clients, ID, fraction).collect()}
    second = {r[ID] for r in sampling.sample_fraction(clients.repartition(7), ID, fraction).collect()}
    assert len(first) == round(400 * fraction) and first == second


def test_holdout_keeps_class_shares(clients):
    parts = sampling.stratified_holdout(clients, ID, K.TARGET, 0.2)
    counts = {(r["TARGET"], r["part"]): r["count"] for r in parts.groupBy("TARGET", "part").count().collect()}
    for y in (0, 1):
        n = counts[(y, "train")] + counts[(y, "valid")]
        assert counts[(y, "valid")] == round(n * 0.2)
    assert sum(counts.values()) == 400


def test_folds_split_each_class_evenly(clients):
    folds = sampling.stratified_folds(clients, ID, K.TARGET, 5)
    counts = folds.groupBy("TARGET", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in counts if r["TARGET"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_class_weights_balance(clients):
    sums = T.balanced_weights(clients).groupBy("TARGET").agg(F.sum("weight").alias("w")).collect()
    assert [r["w"] for r in sums] == pytest.approx([200.0, 200.0])


@pytest.fixture(scope="module")
def prepared(clients):
    return M.ClientPreprocessor().fit(clients).transform(clients).persist()


@pytest.fixture(scope="module")
def trees(prepared):
    return T.train_boosted(prepared, ["x", "y", "job"], trees=6, max_depth=3)


def test_training_beats_chance_and_reports(spark, prepared):
    done = T.train_and_evaluate(prepared, ["x", "y", "job"], "boosted", trees=6, max_depth=3)
    assert done.valid_metrics["auc"] > 0.6
    assert 0.01 <= done.threshold <= 0.98
    assert done.config["best_iteration"] == done.scorer.rounds == len(done.scorer.model.trees)
    card = T.model_card(spark, done.config, ["x", "y", "job"]).first()
    assert card["n_features"] == 3 and card["threshold"] == done.threshold


def test_boosting_keeps_the_best_round(prepared):
    features = ["x", "y", "job"]
    marked = prepared.withColumn("v", F.col(ID) % 4 == 0)
    kept = T.train_boosted(marked, features, validation="v", trees=30, max_depth=2, patience=8)
    whole = T.train_boosted(marked.where("not v"), features, trees=30, max_depth=2)
    rows = whole.assemble(marked.where("v")).withColumn("label", F.col("TARGET").cast("double"))
    rows = T.balanced_weights(rows, "label")
    losses = whole.model.evaluateEachIteration(rows)
    assert kept.rounds == T.best_round(losses, 8) == len(kept.model.trees) > 1
    again = kept.model.evaluateEachIteration(rows)
    assert again == pytest.approx(losses[: kept.rounds])


@pytest.mark.parametrize(
    "losses, patience, best",
    [([3, 2, 1], 2, 3), ([3, 1, 2, 2, 0], 2, 2), ([3, 1, 2, 2, 0], 5, 5), ([1], 1, 1), ([1, 1, 1], 5, 1)],
)
def test_best_round(losses, patience, best):
    assert T.best_round(losses, patience) == best


def test_cross_validation_stops_early_in_each_fold(prepared):
    folds = T.cross_validate(prepared, ["x", "y", "job"], k=2, trees=6, max_depth=2).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1] and all(r["auc"] > 0.6 for r in folds)


def test_training_is_repeatable(prepared, trees):
    again = T.train_boosted(prepared, ["x", "y", "job"], trees=6, max_depth=3)
    a = trees.with_probability(prepared).orderBy(ID).collect()
    b = again.with_probability(prepared).orderBy(ID).collect()
    assert [r["probability"] for r in a] == pytest.approx([r["probability"] for r in b])


def test_cross_validation(prepared):
    folds = T.cross_validate(prepared, ["x", "y", "job"], "logistic", k=3).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2]
    assert all(r["auc"] > 0.6 for r in folds)


def test_tree_contributions_add_up_to_the_margin(prepared, trees):
    cells = X.tree_cells(prepared, trees)
    total = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["contribution"])
    scored = trees.model.setFeaturesCol("_features").transform(trees.assemble(prepared))
    raw = scored.select(ID, vector_to_array("rawPrediction")[1].alias("raw"))
    rows = cells.select(ID, "margin", (F.col("base_value") + total).alias("sum")).join(raw, ID).collect()
    assert len(rows) == 400
    for r in rows:
        assert r["sum"] == pytest.approx(r["margin"])
        assert r["raw"] == pytest.approx(2 * r["margin"]) or r["raw"] == pytest.approx(r["margin"])


def test_top_contributions_are_sorted(prepared, trees):
    rows = X.explain_trees(prepared, trees, n=2).where(F.col(ID) == 100001).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2]
    assert abs(rows[0]["contribution"]) >= abs(rows[1]["contribution"])
    assert all(r["direction"] == ("augmente" if r["contribution"] > 0 else "diminue") for r in rows)


def test_importance_covers_all_features(spark, trees):
    rows = X.global_importance(spark, trees).collect()
    assert {r["feature"] for r in rows} == {"x", "y", "job"}
    assert sum(r["importance_pct"] for r in rows) == pytest.approx(100)


def test_logistic_model_as_expression(prepared):
    fitted = T.train_logistic(prepared, ["x", "y", "job"])
    linear = LinearScorer.from_model(fitted.model, fitted.features)
    a = fitted.with_probability(prepared).orderBy(ID).collect()
    b = linear.with_probability(prepared).orderBy(ID).collect()
    assert [r["probability"] for r in a] == pytest.approx([r["probability"] for r in b])


def test_what_if_replaces_and_shifts(spark):
    scorer = LinearScorer(0.0, {"CREDIT_INCOME_RATIO": 1.0})
    df = spark.createDataFrame([(1, 9.0, 2.0)], "SK_ID_CURR long, AMT_CREDIT double, AMT_INCOME_TOTAL double")
    rows = what_if(df, [{"name": "same"}, {"name": "more", "deltas": {"AMT_CREDIT": 3.0}}, {"name": "set", "values": {"AMT_CREDIT": 0.0}}], scorer)
    got = {r["scenario"]: r["delta"] for r in rows.collect()}
    base = 1 / (1 + np.exp(-3))
    assert got["same"] == pytest.approx(0)
    assert got["more"] == pytest.approx(1 / (1 + np.exp(-4)) - base)
    assert got["set"] == pytest.approx(0.5 - base)


def test_explanation_shapes(spark):
    bodies = [
        (1, '{"shap": {"shap_values": {"a": -2, "b": "inf", "c": 0}, "base_value": 1.5}}'),
        (2, '{"contributions": [{"name": "a", "shap": 2, "direction": "baisse"}, {"feature": "", "contribution": 1}]}'),
        (3, '{"top_features": [{"feature": "a", "contribution": "x"}, {"feature": "b", "contribution": 0.5}]}'),
        (4, "not json"),
    ]
    df = spark.createDataFrame(bodies, "id int, body string")
    rows = {r["id"]: r for r in X.normalize_explanations(df, "body", "id").collect()}
    assert [(c["feature"], c["impact"], c["direction"]) for c in rows[1]["contributions"]] == [
        ("a", -2.0, K.LOWERS_RISK), ("c", 0.0, K.NEUTRAL_RISK)
    ]
    assert rows[1]["base_value"] == 1.5 and rows[1]["impact_label"] == "Valeur SHAP"
    assert [(c["feature"], c["impact"]) for c in rows[2]["contributions"]] == [("a", -2.0)]
    assert rows[2]["impact_label"] == "Contribution"
    assert [(c["feature"], c["direction"]) for c in rows[3]["contributions"]] == [("b", K.RAISES_RISK)]
    assert rows[4]["contributions"] == []


def test_settings_and_importance_fallback(spark, tmp_path):
    O.write_settings(spark, {"optimal_threshold": 0.44, "model_name": "é"}, f"{tmp_path}/s")
    assert O.read_settings(spark, f"{tmp_path}/s") == {"optimal_threshold": 0.44, "model_name": "é"}
    df = spark.createDataFrame([("a", 3), ("b", 1)], "feature string, importance long")
    O.write_table(df.withColumn("more", F.lit("x")), f"{tmp_path}/i", "csv")
    found = O.read_first(spark, [f"{tmp_path}/none", f"{tmp_path}/i"], "feature string, importance bigint")
    assert sorted(map(tuple, found.collect())) == [("a", 3), ("b", 1)]
    assert O.read_first(spark, [f"{tmp_path}/none"], "feature string") is None


def test_restarted_log_has_no_duplicates(spark, tmp_path):
    schema = "SK_ID_CURR long, ts timestamp, proba double"
    rows = spark.sql("select id as SK_ID_CURR, timestamp'2024-01-01' + make_dt_interval(0, 0, id) as ts, 0.5D as proba from range(50)")
    rows.write.parquet(f"{tmp_path}/in")
    log = lambda: J.prediction_log(J.read_stream(spark, f"{tmp_path}/in", rows.schema), ID)
    J.run_to_end(log(), f"{tmp_path}/out", f"{tmp_path}/chk")
    rows.where("SK_ID_CURR >= 30").write.mode("append").parquet(f"{tmp_path}/in")
    J.run_to_end(log(), f"{tmp_path}/out", f"{tmp_path}/chk")
    assert spark.read.schema(schema).parquet(f"{tmp_path}/out").count() == 50


def test_alerts_only_outside_the_tolerance(spark):
    df = spark.createDataFrame([(0.3, 0.4), (0.5, 0.4), (0.3, 0.7)], "refusal_rate double, mean_score double")
    assert [r["alert"] for r in J.monitor_alerts(df, 0.3, 0.4).collect()] == [False, True, True]
