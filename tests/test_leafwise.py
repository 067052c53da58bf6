"""Leaf-wise boosting and exact Shapley values against plain re-computations."""

import pickle
import threading
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.catalog import models
from loanloom.operators import explain as X
from loanloom.operators import shapley
from loanloom.plans import leafwise as L
from loanloom.plans import training as T

ID = K.CLIENT_KEY
FEATURES = ["x", "y", "z"]
WHOLE = dict(row_fraction=1.0, feature_fraction="all", min_rows_per_leaf=5)


@pytest.fixture(scope="module")
def clients(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(600):
        x, y = float(rng.normal()), float(rng.integers(0, 9))
        z = None if i % 5 == 0 else float(rng.uniform(0, 1))
        risk = 1 / (1 + np.exp(-(2 * x + (1.5 if z is None else z) - 0.2 * y * (x > 0) - 1)))
        rows.append((100001 + i, int(rng.random() < risk), x, y, z))
    return spark.createDataFrame(rows, f"{ID} long, TARGET int, x double, y double, z double").persist()


@pytest.fixture(scope="module")
def fitted(clients):
    return L.train_leafwise(clients, FEATURES, trees=8, leaves=9, **WHOLE)


def matrix(df):
    rows = df.select(ID, "TARGET", *FEATURES).orderBy(ID).collect()
    x = np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in rows])
    return x, np.array([r["TARGET"] for r in rows], dtype=float)


def plain_margins(x, y, trees, leaves, step=0.05, l1=0.1, l2=0.1, least=5):
    """Every cut of every feature of every leaf tried by itself, the best leaf split first."""
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    margin = np.zeros(len(y))

    def worth(g, h):
        return max(abs(g) - l1, 0) ** 2 / (h + l2)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)

        def best(rows):
            found = (1e-9, None)
            for f in range(x.shape[1]):
                v = x[rows, f]
                for missing_left in (False, True):
                    for cut in np.unique(v[~np.isnan(v)]):
                        left = np.where(np.isnan(v), missing_left, v <= cut)
                        a, b = rows[left], rows[~left]
                        if min(len(a), len(b)) < least:
                            continue
                        gain = worth(g[a].sum(), h[a].sum()) + worth(g[b].sum(), h[b].sum())
                        gain -= worth(g[rows].sum(), h[rows].sum())
                        if gain > found[0] + 1e-9:
                            found = (gain, (a, b))
            return found

        open_leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
        while len(open_leaves) < leaves:
            at = max(range(len(open_leaves)), key=lambda i: open_leaves[i][1][0])
            if open_leaves[at][1][1] is None:
                break
            a, b = open_leaves.pop(at)[1][1]
            open_leaves += [(a, best(a)), (b, best(b))]
        for rows, _ in open_leaves:
            total = g[rows].sum()
            margin[rows] -= step * np.sign(total) * max(abs(total) - l1, 0) / (h[rows].sum() + l2)
    return margin


def coarse(df):
    """Few values per feature, so that every value is the bound of a bin."""
    return df.withColumns({"x": F.round("x", 1), "z": F.round("z", 1)})


def test_equals_a_plain_search_of_all_cuts(clients):
    few = coarse(clients)
    x, y = matrix(few)
    got = L.train_leafwise(few, FEATURES, trees=5, leaves=7, **WHOLE).model.margins(x)
    assert got == pytest.approx(plain_margins(x, y, 5, 7), abs=1e-6)


def test_partitions_and_order_do_not_matter(clients):
    settings = dict(trees=4, leaves=6, min_rows_per_leaf=5)
    a = L.train_leafwise(clients.repartition(1), FEATURES, **settings).model
    b = L.train_leafwise(clients.repartition(20).orderBy(F.rand(1)), FEATURES, **settings).model
    for one, two in zip(a.trees, b.trees, strict=True):
        assert all(np.array_equal(getattr(one, k), getattr(two, k)) for k in L.NODE)


def same_trees(a, b):
    for one, two in zip(a.trees, b.trees, strict=True):
        assert all(np.array_equal(getattr(one, k), getattr(two, k)) for k in L.NODE)


def test_sums_of_many_tasks_meet_by_feature(clients, monkeypatch):
    marked = clients.withColumn("v", F.col(ID) % 3 == 0).repartition(9).persist()
    settings = dict(validation="v", trees=5, leaves=9, **WHOLE)
    one = L.train_leafwise(marked, FEATURES, **settings)
    monkeypatch.setattr(L, "TOGETHER", 128 * 100)  # 100 rows a task
    many = L.train_leafwise(marked, FEATURES, **settings)
    same_trees(one.model, many.model)
    assert one.auc_by_round == many.auc_by_round


def test_rows_of_one_task_need_few_jobs(clients, monkeypatch):
    jobs, run = [], L._run

    def counted(state, job):
        jobs.append(job)
        return run(state, job)

    monkeypatch.setattr(L, "_run", counted)
    marked = clients.withColumn("v", F.col(ID) % 3 == 0)
    kept = L.train_leafwise(marked, FEATURES, validation="v", trees=40, patience=40, leaves=9, **WHOLE)
    assert len(kept.auc_by_round) == 40 and len(jobs) < 20


def test_spread_rows_apply_a_tree_once(clients, monkeypatch):
    applied, run = [], L._run

    def counted(state, job):
        applied.append(len(job.trees))
        return run(state, job)

    monkeypatch.setattr(L, "_run", counted)
    monkeypatch.setattr(L, "TOGETHER", 128 * 100)
    L.train_leafwise(clients, FEATURES, trees=4, leaves=5, **WHOLE)
    assert len(applied) > 5 and not any(applied)  # the stored margins have all trees already


def random_block(n, features=4, missing=0.2):
    rng = np.random.default_rng(n)
    codes = rng.integers(1, 9, (features, n)).astype(np.uint8)
    codes[rng.random(codes.shape) < missing] = L.MISSING
    label = rng.integers(0, 2, n).astype(float)
    return L.Block(codes, label, np.ones(n), np.zeros(n, bool), np.arange(n, dtype=np.uint64), np.zeros(n))


def test_leaves_of_codes_follow_every_row():
    block = random_block(300)
    features, bounds = np.arange(4), [np.arange(1.0, 9.0)] * 4
    settings = dict(trees=1, leaves=12, max_depth=None, patience=5, bag_rounds=5, row_fraction=1.0)
    rules = L.Rules(0.0, 0.1, 5, 0.1)
    job = L.Alone([], {0: 0}, [features], 0, [], bounds, 10, 2.0**20, rules, False, settings)
    ((tree,), _, _) = next(job.grow([block]))
    assert (tree.feature < 0).sum() == 12 and tree.missing_left.any() and not tree.missing_left.all()

    def walk(codes):
        node = 0
        while tree.feature[node] >= 0:
            code = codes[tree.feature[node]]
            left = tree.missing_left[node] if code == L.MISSING else code <= tree.code[node]
            node = tree.left[node] if left else tree.right[node]
        return node

    some = np.array([250, 3, 3, 77])
    assert L.leaves_of_codes(tree, block.codes).tolist() == [walk(c) for c in block.codes.T]
    assert L.leaves_of_codes(tree, block.codes, some).tolist() == [walk(block.codes[:, i]) for i in some]


def test_sums_of_a_leaf_do_not_depend_on_its_size(monkeypatch):
    block = random_block(500)
    bag = L.Bag([block], 0, 0.7)
    growth = L.Growth(bag, bag.gradients(2.0**20), np.array([0, 2, 3]), 10)
    at = np.arange(0, len(bag.rows[0]), 3)
    few = growth._sums(at)
    monkeypatch.setattr(L, "FEW_ROWS", 10)
    assert np.array_equal(growth._sums(at), few) and few[0, :, 2].sum() == len(at)


def test_no_sum_per_code_reaches_the_driver(clients, monkeypatch):
    sizes, collect = [], RDD.collect

    def weighed(rdd):
        found = collect(rdd)
        sizes.append(len(pickle.dumps(found)))
        return found

    monkeypatch.setattr(RDD, "collect", weighed)
    marked = clients.withColumn("v", F.col(ID) % 3 == 0)
    L.train_leafwise(marked, FEATURES, validation="v", trees=3, leaves=25, **WHOLE)
    assert sizes and max(sizes) < 8_000  # sums of one leaf: 3 features x 256 codes x 24 bytes


def test_children_too_small_to_split_are_not_looked_at(clients, monkeypatch):
    asked, run = [], L._run

    def counted(state, job):
        asked.append(len(job.slots))
        return run(state, job)

    monkeypatch.setattr(L, "_run", counted)
    settings = {**WHOLE, "min_rows_per_leaf": 301}
    L.train_leafwise(clients, FEATURES, trees=2, **settings)
    assert asked == [1, 1, 1]  # a root a tree, and the last round's
    asked.clear()
    L.train_leafwise(clients, FEATURES, trees=1, leaves=2, **WHOLE)
    assert asked == [1, 1]  # nothing follows the only split


def test_trees_keep_their_bounds(fitted):
    for tree in fitted.model.trees:
        leaves = tree.feature < 0
        assert leaves.sum() <= 9 and (tree.rows[leaves] >= 5).all() and tree.rows[leaves].sum() == 600


def test_depth_limit(clients):
    flat = L.train_leafwise(clients, FEATURES, trees=2, max_depth=1, **WHOLE)
    assert all(len(tree.feature) == 3 for tree in flat.model.trees)


def test_margins_survive_stored_blocks(clients, monkeypatch):
    plain = L.train_leafwise(clients, FEATURES, trees=7, leaves=4, **WHOLE)
    monkeypatch.setattr(L, "REFRESH", 2)
    monkeypatch.setattr(L, "RELIABLE", 4)
    stored = L.train_leafwise(clients, FEATURES, trees=7, leaves=4, **WHOLE)
    x, _ = matrix(clients)
    assert stored.model.margins(x) == pytest.approx(plain.model.margins(x))


def test_stops_by_auc_without_another_fit(clients):
    marked = clients.withColumn("v", F.col(ID) % 3 == 0)
    kept = L.train_leafwise(marked, FEATURES, validation="v", trees=60, patience=6, **WHOLE)
    scores = kept.auc_by_round
    assert kept.rounds == len(kept.model.trees) == int(np.argmax(scores)) + 1
    assert len(scores) == 60 or len(scores) == kept.rounds + 6
    x, y = matrix(marked.where("v"))
    margin = kept.model.margins(x)
    pairs = margin[y == 1][:, None] - margin[y == 0][None, :]
    assert max(scores) == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean(), abs=2e-3)


def test_missing_values_take_the_learned_side(clients, fitted):
    scored = fitted.with_probability(clients.withColumn("z", F.lit(None).cast("double")))
    as_nan = fitted.with_probability(clients.withColumn("z", F.lit(float("nan"))))
    a, b = (sorted(r["probability"] for r in d.collect()) for d in (scored, as_nan))
    assert a == pytest.approx(b) and all(0 < p < 1 for p in a)


def test_awkward_tables(spark, clients, fitted):
    assert fitted.with_probability(clients.limit(0)).count() == 0
    assert shapley.shapley_cells(clients.limit(0), fitted).count() == 0
    twice = clients.limit(3).union(clients.limit(3))
    assert fitted.with_probability(twice).count() == 6
    with pytest.raises(ValueError, match="both classes"):
        L.train_leafwise(clients.where("TARGET = 1"), FEATURES)
    with pytest.raises(ValueError, match="both classes"):
        L.train_leafwise(clients.limit(0), FEATURES)
    constant = clients.select(ID, "TARGET", F.lit(1.0).alias("x"), F.lit(None).cast("double").alias("z"))
    flat = L.train_leafwise(constant, ["x", "z"], trees=2, **WHOLE)
    assert all(len(tree.feature) == 1 for tree in flat.model.trees)


def test_saved_trees_score_alike(spark, clients, fitted, tmp_path):
    T.save_scorer(spark, fitted, f"{tmp_path}/scorer")
    loaded = T.load_scorer(spark, f"{tmp_path}/scorer")
    x, _ = matrix(clients)
    assert loaded.features == FEATURES
    assert loaded.model.margins(x) == pytest.approx(fitted.model.margins(x), abs=0)


def test_train_and_evaluate_and_folds(clients):
    done = T.train_and_evaluate(clients, FEATURES, "leafwise", trees=10, patience=4)
    assert done.valid_metrics["auc"] > 0.6 and done.config["best_iteration"] == done.scorer.rounds
    folds = T.cross_validate(clients, FEATURES, "leafwise", k=2, trees=5).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1] and all(r["auc"] > 0.6 for r in folds)


def test_folds_are_fitted_at_the_same_time(clients, monkeypatch):
    together = threading.Barrier(3, timeout=60)

    def fit(df, features, **settings):
        together.wait()  # breaks if a fold waits for another one's fit
        return L.train_leafwise(df, features, trees=2, **settings)

    monkeypatch.setitem(T.TRAINERS, "leafwise", fit)
    folds = T.cross_validate(clients, FEATURES, "leafwise", k=3, **WHOLE).collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2]


# ------------------------------------------------------------------------ Shapley values


def answer(tree, row, known, node=0):
    """Mean answer of a tree when only the features in ``known`` are looked at."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if f in known:
        goes = tree.missing_left[node] if np.isnan(row[f]) else row[f] <= tree.cut[node]
        return answer(tree, row, known, left if goes else right)
    share = tree.rows[left] / tree.rows[node]
    return share * answer(tree, row, known, left) + (1 - share) * answer(tree, row, known, right)


def by_subsets(tree, row, n):
    out = np.zeros(n)
    for f in range(n):
        others = [k for k in range(n) if k != f]
        for size in range(n):
            weight = factorial(size) * factorial(n - size - 1) / factorial(n)
            for known in combinations(others, size):
                out[f] += weight * (answer(tree, row, {*known, f}) - answer(tree, row, set(known)))
    return out


def test_shapley_values_equal_all_subsets(clients, fitted):
    x, _ = matrix(clients)
    got = np.zeros((40, 3))
    want = np.zeros((40, 3))
    for tree in fitted.model.trees:
        paths = shapley.leaf_paths(tree)
        assert shapley.expected(paths) == pytest.approx(answer(tree, x[0], set()))
        shapley.add_shapley(tree, paths, x[:40], got)
        want += [by_subsets(tree, row, 3) for row in x[:40]]
    assert got == pytest.approx(want, abs=1e-12)


def test_shapley_values_of_many_features(spark):
    rng = np.random.default_rng(3)
    names = [f"f{i}" for i in range(7)]
    x = rng.normal(size=(500, 7))
    y = (x.sum(axis=1) + rng.normal(size=500) > 0).astype(int)
    rows = [(i, int(y[i]), *x[i].tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, f"{ID} long, TARGET int, " + ", ".join(f"{n} double" for n in names))
    tree = L.train_leafwise(df, names, trees=1, leaves=25, learning_rate=1.0, **WHOLE).model.trees[0]
    paths = shapley.leaf_paths(tree)
    assert max(len(p.features) for p in paths) >= 4
    got = np.zeros((10, 7))
    shapley.add_shapley(tree, paths, x[:10], got)
    assert got == pytest.approx(np.array([by_subsets(tree, row, 7) for row in x[:10]]), abs=1e-12)


def test_shapley_values_add_up_to_the_margin(clients, fitted):
    total = F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["contribution"])
    rows = shapley.shapley_cells(clients, fitted).select("margin", (F.col("base_value") + total).alias("sum")).collect()
    assert len(rows) == 600 and all(r["sum"] == pytest.approx(r["margin"]) for r in rows)
    top = X.explain_trees(clients, fitted, n=2).where(F.col(ID) == 100001).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2]


def test_summary_explains_every_client(clients, fitted, monkeypatch):
    monkeypatch.setattr(models, "_boosted", lambda t: (clients, fitted))
    x, _ = matrix(clients)
    values = np.zeros(x.shape)
    for tree in fitted.model.trees:
        shapley.add_shapley(tree, shapley.leaf_paths(tree), x, values)
    want = dict(zip(FEATURES, np.abs(values).mean(axis=0)))
    got = {r["feature"]: r["mean_abs_contribution"] for r in models.m15_trees(None).collect()}
    assert got == pytest.approx(want, rel=1e-9)


def test_answers_written_down_equal_those_of_each_row(clients, fitted, monkeypatch):
    x, _ = matrix(clients)
    written, each = np.zeros(x.shape), np.zeros(x.shape)
    for tree in fitted.model.trees:
        shapley.add_shapley(tree, shapley.leaf_paths(tree), x, written)
    monkeypatch.setattr(shapley, "WRITTEN", 1)
    for tree in fitted.model.trees:
        shapley.add_shapley(tree, shapley.leaf_paths(tree), x, each)
    assert np.abs(written).sum() > 0 and written == pytest.approx(each, abs=1e-12)


def test_importance_is_the_share_of_gain(spark, fitted):
    rows = X.global_importance(spark, fitted).collect()
    assert {r["feature"] for r in rows} == set(FEATURES)
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
