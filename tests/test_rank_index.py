"""The stored order of a population against counts on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.operators import rank_index as R
from loanloom.operators.compare import value_positions
from loanloom.session import scratch_path

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def population(spark):
    rng = np.random.default_rng(5)
    a = np.exp(rng.normal(0, 4, 5000))
    a[:1700] = 7.0  # a third of all rows
    b = np.round(rng.normal(0, 20, 5000))
    rows = [(i, float(x), None if i % 6 == 0 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    path = scratch_path(spark, "population")
    spark.createDataFrame(rows, "i int, a double, b double").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def index(spark, population):
    return R.build_index(population, FEATURES, scratch_path(spark, "rank-index"))


@pytest.fixture(scope="module")
def asked(spark, population):
    """Values of the population, others between them, and some beyond both ends."""
    rng = np.random.default_rng(6)
    new = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(np.exp(rng.normal(0, 5, 600)), rng.normal(0, 40, 600)))]
    ends = [(-1, -1e300, -1e9), (-2, 1e300, 1e9), (-3, None, 0.0), (-4, 7.0, -0.0)]
    return population.limit(300).unionByName(spark.createDataFrame(new + ends, "i int, a double, b double"))


def expected(population, asked):
    whole = population.toPandas()
    found = {}
    for feature in FEATURES:
        known = np.sort(whole[feature].dropna().to_numpy())
        values = asked.toPandas()[feature].dropna()
        counts = values.value_counts()
        for value in counts.index:
            found[feature, value] = (counts[value], 100 * np.searchsorted(known, value) / len(known))
    return found


def rows(found):
    return {(r["feature"], r["value"]): (r["asks"], pytest.approx(r["percentile"])) for r in found.collect()}


def test_positions_equal_a_sorted_search(index, population, asked):
    assert rows(index.positions(asked)) == expected(population, asked)


def test_positions_equal_the_direct_count(index, population, asked):
    direct = value_positions(population, asked, FEATURES)
    assert rows(index.positions(asked)) == rows(direct)


def test_crowded_buckets_are_shared(index, population, asked):
    """With a share of three values a task, buckets are copied and the rows stay."""
    assert rows(index.positions(asked, least_share=3)) == expected(population, asked)


def test_extension_equals_the_whole(spark, index, population):
    first = R.build_index(population.where("i < 100"), FEATURES, scratch_path(spark, "rank-index"))
    whole = first.extend(population.where("i >= 100"), scratch_path(spark, "rank-index"))
    columns = ["feature", "value", "n", "n_below", "n_upto"]
    assert set(whole.values().select(columns).collect()) == set(index.values().select(columns).collect())
    ours = {r["feature"]: r for r in whole.summary().collect()}
    for r in index.summary().collect():
        assert ours[r["feature"]]["n_all"] == r["n_all"]
        assert ours[r["feature"]]["median"] == r["median"]
        assert ours[r["feature"]]["mean"] == pytest.approx(r["mean"])


def test_later_clients_read_the_index_alone(index, population, asked, spark):
    path = population.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[-1]
    clients = spark.createDataFrame(asked.collect(), asked.schema)
    plan = index.compare(clients, key="i")._jdf.queryExecution().optimizedPlan().toString()
    files = index.compare(clients, key="i").inputFiles()
    assert files and all(index.path.rsplit("/", 1)[-1] in f for f in files)
    assert path not in plan


def test_one_feature_reads_its_folder(index, asked):
    assert rows(index.positions(asked, ["b"])) == {k: v for k, v in rows(index.positions(asked)).items() if k[0] == "b"}
    files = index.values(["b"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(feature" in files


def test_quantiles_are_read_off(index, population):
    points = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    whole = population.toPandas()
    found = index.quantiles(points).collect()
    assert len(found) == len(points) * len(FEATURES)
    for r in found:
        assert r["value"] == pytest.approx(np.quantile(whole[r["feature"]].dropna(), r["probability"]))


def test_nothing_known(spark, population, asked):
    """A feature without values gives no row, until rows with values extend the index."""
    empty = population.where("i < 100").withColumn("b", F.lit(None).cast("double"))
    index = R.build_index(empty, FEATURES, scratch_path(spark, "rank-index"))
    assert index.features == FEATURES
    assert {r["feature"] for r in index.positions(asked).collect()} == {"a"}
    assert {r["feature"] for r in index.compare(asked, key="i").collect()} == {"a"}
    with pytest.raises(ValueError, match="no feature"):
        index.positions(asked, ["c"])
    none = R.build_index(population.where("i < 0"), FEATURES, scratch_path(spark, "rank-index"))
    assert none.positions(asked).count() == 0
    whole = none.extend(population, scratch_path(spark, "rank-index"))
    assert rows(whole.positions(asked)) == expected(population, asked)


def test_no_clients(index, asked):
    assert index.positions(asked.where("i = 99999")).count() == 0
