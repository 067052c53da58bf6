"""Training, scoring, describing and drift over a folder of csv tables."""

import pytest
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom import jobs
from loanloom.operators.aggregates import aggregate_pos
from loanloom.sources import readers as I
from loanloom.sources import sinks as O

FILES = {n: n for n in ("bureau", "bureau_balance", "previous_application", "installments_payments")}


@pytest.fixture(scope="module")
def data(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("loans"))
    app = tables.app
    O.write_table(app.where("split = 'train'").drop("split"), f"{folder}/{K.TABLE_FILES['application_train']}", "csv")
    O.write_table(app.where("split = 'test'").drop("split", "TARGET"), f"{folder}/{K.TABLE_FILES['application_test']}", "csv")
    for name, view in FILES.items():
        O.write_table(tables.view(view), f"{folder}/{K.TABLE_FILES[name]}", "csv")
    return folder


@pytest.fixture(scope="module")
def trained(spark, data, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("model"))
    config = jobs.train_job(spark, data, out, trees=4, max_depth=2)
    return out, config


def test_training_leaves_everything_behind(spark, trained, tables):
    out, config = trained
    preprocessor, scorer, settings = jobs.load_model(spark, out)
    assert settings["optimal_threshold"] == config["optimal_threshold"]
    assert scorer.features == preprocessor.feature_names
    assert "INST_DAYS_LATE_MEAN" in scorer.features and "OWN_CAR_AGE" not in scorer.features
    n_test = tables.app.where("split = 'test'").count()
    assert I.read_csv(spark, f"{out}/submission", overrides={"TARGET": "double"}).count() == n_test
    runs = O.last_runs(spark, f"{out}/runs").collect()
    assert len(runs) == 1 and runs[0]["run_id"] == config["run_id"]
    assert spark.read.option("header", True).csv(f"{out}/importance").count() == len(scorer.features)


def test_scoring_a_file(spark, trained, data, tmp_path):
    out, config = trained
    clients = f"{data}/{K.TABLE_FILES['application_test']}"
    summary = jobs.score_job(spark, out, clients, f"{tmp_path}/scores").first()
    assert summary["total_clients"] == summary["accepted_count"] + summary["refused_count"]
    everyone = jobs.score_job(spark, out, clients, f"{tmp_path}/all", threshold=0.0).first()
    assert everyone["refused_count"] == everyone["total_clients"]


def test_describe_and_drift(spark, data, tmp_path):
    train = f"{data}/{K.TABLE_FILES['application_train']}"
    test = f"{data}/{K.TABLE_FILES['application_test']}"
    summary = jobs.describe_job(spark, train, f"{tmp_path}/described").first()
    assert summary["n_rows"] == summary["target_0"] + summary["target_1"]
    alert = jobs.drift_job(spark, train, test, f"{tmp_path}/drift").first()
    assert alert["features"] > 10


def test_bucketed_tables_are_aggregated_without_a_shuffle(spark, tables, tmp_path):
    pos = tables.view("pos_cash")
    O.write_bucketed(pos, "pos_by_client", f"{tmp_path}/pos", buckets=4)
    stored = spark.table("pos_by_client")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = aggregate_pos(stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in plan
    assert aggregate_pos(stored).count() == pos.select("SK_ID_CURR").distinct().count()
    spark.sql("DROP TABLE pos_by_client")


def test_repeated_keys_stay_together_in_a_sample(spark):
    from loanloom.operators.sampling import sample_fraction

    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 300).alias("k"))
    kept = sample_fraction(df, "k", 0.5).groupBy("k").count().collect()
    whole = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    assert kept and all(whole[r["k"]] == r["count"] for r in kept)
