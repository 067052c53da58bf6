"""Class codes by maps and by joins are the same codes."""

import pytest

from loanloom.plans import preprocessor as M
from loanloom.session import scratch_path
from loanloom.streaming import jobs as J

SCHEMA = "SK_ID_CURR long, small string, odd string, wide string, amount double"


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows lack each text; ``wide`` has more classes than a map takes."""
    found = [
        (i, None if i % 3 == 0 else f"s{i % 5}", ["a b", "", "é", "a`b"][i % 4], None if i % 3 == 1 else f"w{i % 701}", float(i))
        for i in range(2000)
    ]
    path = scratch_path(spark, "texts")
    spark.createDataFrame(found, SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def by_key(df):
    return {r["SK_ID_CURR"]: tuple(r) for r in df.collect()}


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter")


def test_maps_equal_joins(rows, spark, monkeypatch):
    model = M.ClientPreprocessor().fit(rows)
    unseen = spark.createDataFrame([(-1, "new", None, "new", None), (-2, None, "a b", None, 1.0)], SCHEMA)
    asked = rows.unionByName(unseen)
    encoded = model.encode(asked)
    assert joins(encoded) == 1  # the wide column alone
    by_maps = by_key(encoded)
    monkeypatch.setattr(M, "FEW_CLASSES", -1)
    joined = model.encode(asked)
    assert joins(joined) == 3
    assert by_maps == by_key(joined)


def test_codes_are_ranks(rows):
    model = M.ClientPreprocessor().fit(rows)
    got = by_key(model.encode(rows))
    for column, place in (("small", 1), ("odd", 2), ("wide", 3)):
        texts = {r["SK_ID_CURR"]: "MISSING" if r[column] is None else r[column] for r in rows.collect()}
        ranks = {v: float(i) for i, v in enumerate(sorted(set(texts.values())))}
        assert {k: ranks[v] for k, v in texts.items()} == {k: v[place] for k, v in got.items()}


def test_reloaded_and_on_a_stream(rows, spark):
    model = M.ClientPreprocessor().fit(rows)
    path, out = scratch_path(spark, "model"), scratch_path(spark, "encoded")
    model.save(spark, path)
    again = M.ClientPreprocessorModel.load(spark, path)
    stream = J.read_stream(spark, rows.inputFiles()[0].rsplit("/", 1)[0], rows.schema)
    J.run_to_end(again.transform(stream), out, scratch_path(spark, "progress"))
    assert by_key(spark.read.parquet(out)) == by_key(model.transform(rows))
