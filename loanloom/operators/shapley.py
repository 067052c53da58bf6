"""Exact Shapley values of tree ensembles.

The value of a set of known features is the tree's mean answer when a split on an
unknown feature is passed on both sides, by their shares of the fitted rows. For one leaf this is
the answer times a product over the distinct features of its path: 1 or 0 for a known
feature (the row follows the path there or not), the product of the shares for an unknown one. A
feature's Shapley value is the integral over u in [0, 1] of what it adds when every other feature
is known with probability u; the integrand is a polynomial whose degree is below the
number of features on the path, so Gauss-Legendre nodes give it exactly: no subsets.

What a leaf adds depends only on which features of its path the row follows. For short paths
these answers are written down once per batch, and a row looks its own up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.plans.leafwise import LeafwiseScorer, Tree

ROWS = 10_000  # rows a task explains at a time
WRITTEN = 12  # features of a path up to which all its answers are written down: 2^12 of each


@dataclass
class LeafPath:
    """One leaf: its answer and, per distinct feature of the path, its steps and the share of unknowns."""

    value: float
    features: np.ndarray
    steps: list[list[tuple[int, bool]]]  # (node, goes left)
    shares: np.ndarray

    def added(self, follows: np.ndarray) -> np.ndarray:
        """What the leaf adds to its features; ``follows``: 1 or 0 per feature and row."""
        nodes, weights = np.polynomial.legendre.leggauss(len(self.features) // 2 + 1)
        inside = np.zeros_like(follows)
        for u, w in zip((nodes + 1) / 2, weights / 2):
            factors = self.shares * (1 - u) + follows * u  # above 0: a leaf has rows and u is below 1
            inside += w * factors.prod(axis=1, keepdims=True) / factors
        return self.value * (follows - self.shares) * inside

    def written(self) -> np.ndarray:
        """``added`` by feature for every set of followed features, bit i for feature i."""
        nodes, weights = np.polynomial.legendre.leggauss(len(self.features) // 2 + 1)
        unknown = np.outer((1 - nodes) / 2, self.shares)  # factors of features that are not followed
        known = unknown + (nodes[:, None] + 1) / 2
        products = np.ones((len(nodes), 1))
        for low, high in zip(unknown.T, known.T):
            products = np.hstack([products * low[:, None], products * high[:, None]])
        places = np.arange(len(self.features))
        followed = np.arange(products.shape[1]) >> places[:, None] & 1
        without = ((weights[:, None] / 2 / unknown).T * -self.shares[:, None]) @ products
        with_it = ((weights[:, None] / 2 / known).T * (1 - self.shares)[:, None]) @ products
        return self.value * np.where(followed, with_it, without)


def leaf_paths(tree: Tree) -> list[LeafPath]:
    found = []

    def visit(node: int, steps: dict, shares: dict) -> None:
        f = int(tree.feature[node])
        if f < 0:
            names = np.array(sorted(steps), dtype=int)
            ratios = np.array([shares[k] for k in names.tolist()])
            found.append(LeafPath(float(tree.value[node]), names, [steps[k] for k in names.tolist()], ratios))
            return
        for child, left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
            share = shares.get(f, 1.0) * float(tree.rows[child]) / float(tree.rows[node])
            visit(child, {**steps, f: [*steps.get(f, []), (node, left)]}, {**shares, f: share})

    visit(0, {}, {})
    return found


def expected(paths: list[LeafPath]) -> float:
    """Mean answer of a tree, nothing known."""
    return sum(p.value * float(np.prod(p.shares)) for p in paths)


def add_shapley(tree: Tree, paths: list[LeafPath], x: np.ndarray, out: np.ndarray) -> None:
    """Adds the tree's Shapley values of the rows ``x`` (NaN where missing) to ``out``."""
    inner = np.flatnonzero(tree.feature >= 0)
    if not len(inner):
        return
    value = x[:, tree.feature[inner]].T
    left = np.where(np.isnan(value), tree.missing_left[inner, None], value <= tree.cut[inner, None])
    sides = {True: left, False: ~left}
    place = {int(node): i for i, node in enumerate(inner)}
    total = np.ascontiguousarray(out.T)
    for path in paths:
        follows = [
            np.logical_and.reduce([sides[goes][place[node]] for node, goes in steps])
            if len(steps) > 1
            else sides[steps[0][1]][place[steps[0][0]]]
            for steps in path.steps
        ]
        if len(follows) > WRITTEN:
            total[path.features] += path.added(np.stack(follows, axis=1).astype(float)).T
            continue
        pattern = np.zeros(len(x), dtype=np.uint16)
        for i, one in enumerate(follows):
            pattern |= one.astype(np.uint16) << np.uint16(i)
        pattern = pattern.astype(np.intp)
        for f, answers in zip(path.features.tolist(), path.written()):
            total[f] += answers[pattern]
    out[:] = total.T


def shapley_cells(df: DataFrame, scorer: LeafwiseScorer, key: str = K.CLIENT_KEY) -> DataFrame:
    """``key, base_value, margin, cells``: the Shapley value of every feature in every row's margin.

    base_value plus a row's contributions is its margin. A missing value is NULL in ``cells``
    and follows the side its split learned. Rows stay where they are; an empty table gives an empty
    table, repeated rows each get their own.
    """
    names, model = scorer.features, scorer.model
    # bounded by the settings of the fit: trees x leaves x path length
    shared = df.sparkSession.sparkContext.broadcast([(t, leaf_paths(t)) for t in model.trees])

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = model.base + sum(expected(paths) for _, paths in shared.value)
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                pdf = whole.iloc[start : start + ROWS]
                x = np.vstack(pdf["_x"].to_numpy()).astype(float)
                parts = np.zeros(x.shape)
                for tree, paths in shared.value:
                    add_shapley(tree, paths, x, parts)
                yield pd.DataFrame(
                    {
                        key: pdf[key].to_numpy(),
                        "_x": list(x),
                        "base_value": base,
                        "margin": model.margins(x),
                        "_parts": list(parts),
                    }
                )

    inputs = df.select(key, scorer.values().alias("_x"))
    kind = inputs.schema[key].dataType.simpleString()
    out = inputs.mapInPandas(
        explain, f"`{key}` {kind}, _x array<double>, base_value double, margin double, _parts array<double>"
    )
    cells = F.zip_with(
        F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("_x").alias("value")),
        F.col("_parts"),
        lambda a, c: F.struct(
            a["feature"].alias("feature"),
            F.when(~F.isnan(a["value"]), a["value"]).alias("value"),
            c.alias("contribution"),
        ),
    )
    return out.select(key, "base_value", "margin", cells.alias("cells"))
