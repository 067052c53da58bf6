"""Boosted trees grown leaf by leaf from gradient histograms.

Features are turned into at most ``bins`` byte codes once, and the coded rows are
stored in blocks. A tree always splits the leaf with the highest gain next; children that are
too small to be split are not looked at.

Rows that one task can hold (``TOGETHER``) stay in it: a job grows many trees there, and of two children
only the smaller is summed. A larger fit spreads its rows. A job then sums gradients, curvatures and rows per
(leaf, feature, code) inside the tasks; the sums are exchanged by feature, merged and searched
where they are merged. To the driver goes one split per leaf and task, never a sum per code. A job
looks at the children of the next few leaves ahead, so a tree takes fewer jobs than splits. Both ways
give the same trees.

Blocks are RDD elements, not rows: a block is a matrix with its margins that stays with its
task over hundreds of passes. A lost executor's blocks are rebuilt from the stored
table and the trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import schema as S
from loanloom.session import ensure_checkpoint_dir, materialize

MISSING = 0  # code of a missing value; real values have codes from 1
SKETCH = 10_000  # bin bounds are off by at most this part of the rows
AUC_CELLS = 1 << 14  # scores closer than this count as ties when rounds are compared
REFRESH = 3  # trees that a task that fits alone applies anew in every job before it stores its margins
AHEAD = 16  # leaves one job sums ahead
RELIABLE = 60  # trees after which the stored margins are checkpointed
TOGETHER = 1 << 27  # codes up to which one task fits alone: 2^20 rows of up to 128 features
SPREAD = 4  # a larger fit's tasks hold at most this part of TOGETHER
TREES_AT_ONCE = 32  # trees a task that fits alone grows in a job
FEW_ROWS = 1024  # rows of a leaf up to which all features are summed in one pass
BINS = "_n int, _bins binary, _label binary, _weight binary, _checked binary, _draw binary"


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root, a leaf has feature -1. ``cut``: up to it goes left."""

    feature: np.ndarray
    code: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray


NODE = {
    "feature": "int",
    "code": "int",
    "cut": "double",
    "missing_left": "boolean",
    "left": "int",
    "right": "int",
    "value": "double",
    "rows": "long",
    "gain": "double",
}
_DTYPES = {"int": np.int32, "long": np.int64, "double": np.float64, "boolean": bool}


def as_tree(nodes: list[dict]) -> Tree:
    return Tree(**{k: np.array([n[k] for n in nodes], dtype=_DTYPES[t]) for k, t in NODE.items()})


def leaves_of_codes(tree: Tree, codes: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """``codes``: one row of the matrix per feature; ``of``: the clients asked for, all by default.

    The clients are parted node by node; a code is read once per node on its client's way.
    """
    found = np.zeros(codes.shape[1] if of is None else len(of), dtype=np.int32)
    stack = [(0, None)]
    while stack:
        node, places = stack.pop()
        if tree.feature[node] < 0:
            found[slice(None) if places is None else places] = node
            continue
        rows = of if places is None else places if of is None else of.take(places)
        own = codes[tree.feature[node]] if rows is None else codes[tree.feature[node]].take(rows)
        left = own <= tree.code[node]  # MISSING is below all codes
        if not tree.missing_left[node]:
            left &= own != MISSING
        for child, side in ((tree.left[node], left), (tree.right[node], ~left)):
            taken = np.flatnonzero(side)
            if len(taken):
                stack.append((child, taken if places is None else places.take(taken)))
    return found


def leaves_of_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    """``x``: one row of the matrix per client, NaN where missing."""
    at = np.zeros(len(x), dtype=np.int32)
    moving = np.arange(len(x))
    while True:
        moving = moving[tree.feature[at[moving]] >= 0]
        if not len(moving):
            return at
        nodes = at[moving]
        value = x[moving, tree.feature[nodes]]
        left = np.where(np.isnan(value), tree.missing_left[nodes], value <= tree.cut[nodes])
        at[moving] = np.where(left, tree.left[nodes], tree.right[nodes])


# ------------------------------------------------------------------------- the model


@dataclass
class BoostedTrees:
    base: float
    trees: list[Tree]
    n_features: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += tree.value[leaves_of_values(tree, x)]
        return total

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gain of all splits."""
        gains = np.zeros(self.n_features)
        for tree in self.trees:
            inner = tree.feature >= 0
            np.add.at(gains, tree.feature[inner], tree.gain[inner])
        return Vectors.dense(gains / gains.sum() if gains.sum() > 0 else gains)


@dataclass
class LeafwiseScorer:
    """Scores rows by the named features; a missing value goes the way its split learned."""

    model: BoostedTrees
    features: list[str]
    rounds: int | None = None
    auc_by_round: list[float] = field(default_factory=list)

    def values(self) -> Column:
        missing = F.lit(float("nan"))
        return F.array(*[F.coalesce(S.quoted(n).cast("double"), missing) for n in self.features])

    def with_probability(self, df: DataFrame) -> DataFrame:
        model = self.model

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            matrix = np.vstack(x.to_numpy()) if len(x) else np.empty((0, model.n_features))
            return pd.Series(1 / (1 + np.exp(-model.margins(matrix))))

        return df.withColumn("probability", probability(self.values()))


def save_trees(spark, scorer: LeafwiseScorer, path: str) -> None:
    """One row per node."""
    rows = [
        (t, at, *(getattr(tree, k)[at].item() for k in NODE))
        for t, tree in enumerate(scorer.model.trees)
        for at in range(len(tree.feature))
    ]
    columns = ", ".join(f"`{k}` {kind}" for k, kind in NODE.items())
    spark.createDataFrame(rows, f"tree int, node int, {columns}").write.mode("overwrite").parquet(path)


def load_trees(spark, path: str, base: float, features: list[str]) -> LeafwiseScorer:
    """The node table is bounded by the settings of the fit: trees x leaves."""
    trees: dict[int, list[dict]] = {}
    for row in spark.read.parquet(path).orderBy("tree", "node").collect():
        trees.setdefault(row["tree"], []).append(row.asDict())
    model = BoostedTrees(base, [as_tree(trees[t]) for t in sorted(trees)], len(features))
    return LeafwiseScorer(model, features, len(model.trees))


# ------------------------------------------------------------------------ coded blocks


def bin_bounds(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper bounds of the codes of every feature, from one mergeable sketch each.

    A feature with fewer values than bins has every value that is not rare as a bound.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = df.agg(
        *[
            F.percentile_approx(F.nanvl(S.quoted(n).cast("double"), F.lit(None)), shares, SKETCH).alias(f"b{i}")
            for i, n in enumerate(features)
        ]
    ).first()
    return [np.unique(np.array(found[i] or [], dtype=float)) for i in range(len(features))]


def coded_blocks(df: DataFrame, features: list[str], bounds: list[np.ndarray]) -> DataFrame:
    """One row per Arrow batch: codes feature by feature, label, weight, mark of checked rows, draw."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, weight, checked, draw = (
                batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)
            )
            codes = np.empty((len(bounds), batch.num_rows), dtype=np.uint8)
            for f, bound in enumerate(bounds):
                x = batch.column(4 + f).to_numpy(zero_copy_only=False).astype(float)
                codes[f] = np.where(np.isnan(x), MISSING, 1 + np.searchsorted(bound, x))
            cells = [
                codes,
                label.astype(np.float64),
                weight.astype(np.float64),
                checked.astype(bool),
                draw.astype(np.int64),
            ]
            columns = [pa.array([batch.num_rows], pa.int32())]
            columns += [pa.array([c.tobytes()], pa.binary()) for c in cells]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BINS.split(", ")])

    inputs = df.select(
        *["_label", "_weight", "_checked", "_draw"],
        *[S.quoted(n).cast("double").alias(f"x{i}") for i, n in enumerate(features)],
    )
    return inputs.mapInArrow(encode, BINS)


@dataclass
class Block:
    codes: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    checked: np.ndarray
    draw: np.ndarray
    margin: np.ndarray


def _block(row, base: float) -> Block:
    n = row["_n"]
    return Block(
        np.frombuffer(row["_bins"], dtype=np.uint8).reshape(-1, n),
        np.frombuffer(row["_label"]),
        np.frombuffer(row["_weight"]),
        np.frombuffer(row["_checked"], dtype=bool),
        np.frombuffer(row["_draw"], dtype=np.int64).view(np.uint64),
        np.full(n, base),
    )


def _advanced(block: Block, trees: list[Tree]) -> Block:
    margin = block.margin.copy()
    for tree in trees:
        margin += tree.value[leaves_of_codes(tree, block.codes)]
    return replace(block, margin=margin)


def in_bag(draw: np.ndarray, period: int, share: float) -> np.ndarray:
    """Rows of a bag by a hash of the row and the bag's number."""
    if share >= 1:
        return np.ones(len(draw), dtype=bool)
    z = draw + np.uint64((0x9E3779B97F4A7C15 * (period + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


@dataclass
class Pass:
    """One job: which trees to apply, which leaves to sum, over which features.

    The features, and the score cells of the checked rows, are cut into ``parts`` ranges;
    a range's sums meet in one task, which answers with its best split of every leaf.
    """

    trees: list[Tree]
    growing: Tree
    slots: dict[int, int]
    features: np.ndarray
    width: int
    scale: float
    period: int
    share: float
    check: bool
    rules: Rules
    parts: int

    def _range(self, part: int, n: int) -> slice:
        return slice(n * part // self.parts, n * (part + 1) // self.parts)

    def sums(self, blocks: Iterator[Block]) -> Iterator[tuple[int, tuple]]:
        """Per range: (places of the codes that occur, their sums, rows per class and score cell)."""
        shape = (len(self.slots), self.width)
        sums = np.zeros((len(self.features), *shape, 3), dtype=np.int64)
        ranks = np.zeros((2, AUC_CELLS), dtype=np.int64) if self.check else None
        taken = [self._taken(_advanced(block, self.trees), ranks) for block in blocks]
        if taken:
            codes, start, steepness, curvature = (np.concatenate(column, axis=-1) for column in zip(*taken))
            both = steepness + 1j * curvature
            for of_feature, own in zip(codes, sums):
                _add_cells(start + of_feature, both, own.reshape(-1, 3))
        for part in range(self.parts):
            own = sums[self._range(part, len(sums))].reshape(-1, 3)
            at = np.flatnonzero(own[:, 2])
            yield part, (at, own[at], None if ranks is None else ranks[:, self._range(part, AUC_CELLS)])

    def _taken(self, block: Block, ranks: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Codes, first cells and gradients of the rows that are in one of the leaves."""
        if ranks is not None:
            _rank(block, 1 / (1 + np.exp(-block.margin)), ranks)
        slot_of = np.full(len(self.growing.feature), -1)
        slot_of[list(self.slots)] = list(self.slots.values())
        bag = np.flatnonzero(~block.checked & in_bag(block.draw, self.period, self.share))
        slot = slot_of[leaves_of_codes(self.growing, block.codes, bag)]
        used, slot = bag[slot >= 0], slot[slot >= 0]
        p = 1 / (1 + np.exp(-block.margin[used]))
        gradients = _gradients(p, block.label[used], block.weight[used], self.scale)
        return block.codes[self.features[:, None], used], slot * self.width, *gradients

    def splits(self, exchanged: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
        """Per range: its number, every leaf's (sum of its rows, best split), area below its score cells."""
        merged = {}
        for part, (at, own, ranks) in exchanged:
            if part not in merged:
                own_range = self._range(part, len(self.features))
                shape = (own_range.stop - own_range.start, len(self.slots), self.width, 3)
                merged[part] = [np.zeros(shape, dtype=np.int64), 0]
            merged[part][0].reshape(-1, 3)[at] += own
            if ranks is not None:
                merged[part][1] = merged[part][1] + ranks
        for part, (sums, ranks) in merged.items():
            first = self._range(part, len(self.features)).start
            leaves = []
            for slot in range(len(self.slots)):
                split = best_split(sums[:, slot], self.scale, self.rules, first)
                leaves.append((tuple(sums[0, slot].sum(axis=0).tolist()), split))
            yield part, leaves, _area(ranks) if self.check else None


def _gradients(p: np.ndarray, label: np.ndarray, weight: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers: the sums do not depend on the order in which tasks are merged."""
    return np.rint(weight * (p - label) * scale), np.rint(weight * p * (1 - p) * scale)


def _add_cells(cells: np.ndarray, gradients: np.ndarray, out: np.ndarray) -> None:
    """Writes steepness, curvature and rows per cell; ``gradients``: the first two as one complex number, for one pass."""
    found = np.zeros(len(out), dtype=complex)
    np.add.at(found, cells, gradients)
    out[:, 0], out[:, 1] = found.real, found.imag
    out[:, 2] = np.bincount(cells, minlength=len(out))


def _rank(block: Block, p: np.ndarray, ranks: np.ndarray) -> None:
    """Counts the checked rows per class and score cell."""
    cell = np.minimum((p * AUC_CELLS).astype(np.int64), AUC_CELLS - 1)
    for label in (0, 1):
        ranks[label] += np.bincount(cell[block.checked & (block.label == label)], minlength=AUC_CELLS)


def _area(ranks: np.ndarray) -> tuple[int, int, int]:
    """Rows of both classes in a range of score cells, and twice the area they span; a cell's rows are ties."""
    none, some = ranks
    below = np.cumsum(none) - none
    return int(none.sum()), int(some.sum()), int((some * (2 * below + none)).sum())


def auc_of(areas: list[tuple[int, int, int]]) -> float:
    """Area under the curve from the areas of all ranges of score cells, lowest scores first."""
    none = some = twice = 0
    for n, s, area in areas:
        twice += area + 2 * s * none
        none, some = none + n, some + s
    return twice / (2 * none * some) if none and some else 0.5


# ----------------------------------------------------------------------------- splits


@dataclass
class Rules:
    """What a split is worth and a leaf answers: L1, L2, least rows, step size."""

    l1: float
    l2: float
    least_rows: int
    step: float

    def worth(self, g, h):
        t = np.maximum(np.abs(g) - self.l1, 0)
        return t * t / np.maximum(h + self.l2, 1e-300)

    def answer(self, g: float, h: float) -> float:
        return float(-self.step * np.sign(g) * max(abs(g) - self.l1, 0) / max(h + self.l2, 1e-300))


@dataclass
class Leaf:
    """``total``: gradients, curvatures (scaled) and rows. ``known``: ``split`` is its best one, None if it has none.

    ``path`` says where it is in the tree: 1 for the root, 2p and 2p + 1 below p.
    """

    node: int
    total: tuple[int, int, int]
    path: int
    known: bool
    split: tuple | None = None
    children: tuple[Leaf, Leaf] | None = None
    parent: Leaf | None = None


def best_split(sums: np.ndarray, scale: float, rules: Rules, first: int = 0) -> tuple | None:
    """(-gain, missing ones added left, feature's position, code, missing goes left, left side's total) or None.

    ``sums`` (feature, code, 3) begins with the feature at position ``first``. The least tuple has the highest
    gain; ties go to the first feature, then the lowest cut. Where the leaf has no missing
    value of the feature, a later one goes to the larger side.
    """
    whole = sums[0].sum(axis=0)
    unit = np.array([scale, scale, 1.0])
    missing = sums[:, MISSING]
    below = np.cumsum(sums[:, 1:], axis=1)  # all values left, the missing right: a split too
    total, best = whole / unit, None
    for missing_left in (False, True):
        if missing_left and not missing[:, 2].any():
            break
        taken = below + missing[:, None] if missing_left else below
        left = taken / unit
        right = total - left
        gain = rules.worth(left[..., 0], left[..., 1]) + rules.worth(right[..., 0], right[..., 1])
        gain -= rules.worth(total[0], total[1])
        allowed = (left[..., 2] >= rules.least_rows) & (right[..., 2] >= rules.least_rows)
        gain = np.where(allowed, gain, -np.inf)
        f, code = divmod(int(np.argmax(gain)), gain.shape[1])
        if gain[f, code] > 1e-9 and (best is None or -gain[f, code] < best[0]):
            side = missing_left if missing[f, 2] else bool(left[f, code, 2] > right[f, code, 2])
            best = (-float(gain[f, code]), missing_left, first + f, code + 1, side, tuple(taken[f, code].tolist()))
    return best


class Grower:
    """One tree: looks at leaves ahead (at most ``ahead``), splits them in order of gain, equal ones from the root down."""

    def __init__(
        self, root: tuple, features, bounds, scale, rules: Rules, leaves: int, depth: int | None, ahead: int
    ):
        self.features, self.bounds, self.scale, self.rules = features, bounds, scale, rules
        self.limit, self.depth, self.ahead = leaves, depth, ahead
        self.nodes: list[dict] = []
        total, split = root
        self.root = self._leaf(total, 1)
        self._learn(self.root, split)
        self.open, self.n_leaves = [self.root], 1

    def _leaf(self, total: tuple[int, int, int], path: int, parent: Leaf | None = None) -> Leaf:
        g, h, rows = total
        deep = self.depth is not None and path.bit_length() > self.depth
        leaf = Leaf(len(self.nodes), total, path, known=rows < 2 * self.rules.least_rows or deep, parent=parent)
        self.nodes.append(
            dict(feature=-1, code=0, cut=0.0, missing_left=False, left=0, right=0, gain=0.0)
            | dict(value=self.rules.answer(g / self.scale, h / self.scale), rows=rows)
        )
        return leaf

    @staticmethod
    def _learn(leaf: Leaf, split: tuple | None) -> None:
        if not leaf.known:
            leaf.known, leaf.split = True, split

    def _children(self, leaf: Leaf) -> tuple[Leaf, Leaf]:
        if leaf.children is None:
            left = leaf.split[5]
            right = tuple(a - b for a, b in zip(leaf.total, left))
            leaf.children = tuple(self._leaf(part, 2 * leaf.path + i, leaf) for i, part in enumerate((left, right)))
        return leaf.children

    def _inner(self, leaf: Leaf) -> dict:
        gain, _, position, code, missing_left, _ = leaf.split
        left, right = (child.node for child in leaf.children)
        f = int(self.features[position])
        cut = float(self.bounds[f][code - 1]) if code <= len(self.bounds[f]) else float("inf")
        return dict(feature=f, code=code, cut=cut, missing_left=missing_left, left=left, right=right, gain=-gain)

    def wanted(self) -> list[Leaf]:
        """Splits what is decided; then the leaves that must be summed (none: the tree is done)."""
        while self.n_leaves < self.limit:
            if not all(leaf.known for leaf in self.open):
                return self._ahead()
            able = [leaf for leaf in self.open if leaf.split]
            if not able:
                return []
            first = min(able, key=lambda leaf: (leaf.split[0], leaf.path))
            self.open.remove(first)
            self.open += self._children(first)
            self.n_leaves += 1
            self.nodes[first.node] |= self._inner(first) | {"taken": True}
        return []

    def _ahead(self) -> list[Leaf]:
        """The open leaves not known, and the next ones if splitting went on with what is known.

        Behind as many splits as are left, no leaf can be chosen.
        """
        unknown = [leaf for leaf in self.open if not leaf.known]
        queue = [(leaf.split[0], leaf.path, leaf) for leaf in self.open if leaf.split]
        heapq.heapify(queue)
        for _ in range(self.limit - self.n_leaves - 1):
            if not queue or len(unknown) >= self.ahead:
                break
            for child in self._children(heapq.heappop(queue)[2]):
                if not child.known:
                    unknown.append(child)
                elif child.split:
                    heapq.heappush(queue, (child.split[0], child.path, child))
        return unknown

    def trial(self, leaves: list[Leaf]) -> tuple[Tree, dict[int, int]]:
        """The tree with all splits known ahead, to reach those leaves; the slot of each."""
        nodes = [dict(n) for n in self.nodes]
        stack = [self.root]
        while stack:
            leaf = stack.pop()
            if leaf.children is not None:
                nodes[leaf.node] |= self._inner(leaf)
                stack += leaf.children
        return as_tree(nodes), {leaf.node: slot for slot, leaf in enumerate(leaves)}

    def learn(self, leaves: list[Leaf], found: list[tuple]) -> None:
        for leaf, (_, split) in zip(leaves, found, strict=True):
            self._learn(leaf, split)

    def tree(self) -> Tree:
        """Only the nodes that were taken, renumbered from the root."""
        order, at = [0], 0
        while at < len(order):
            node = self.nodes[order[at]]
            if node.get("taken"):
                order += [node["left"], node["right"]]
            at += 1
        place = {old: new for new, old in enumerate(order)}
        kept = []
        for old in order:
            node = dict(self.nodes[old])
            if node.pop("taken", False):
                node |= dict(left=place[node["left"]], right=place[node["right"]])
            kept.append(node)
        return as_tree(kept)


# ------------------------------------------------------------------ a fit of one task


class Bag:
    """The rows a tree is fitted on, as one matrix, with the blocks they come from."""

    def __init__(self, blocks: list[Block], period: int, share: float):
        self.blocks = blocks
        taken = [~b.checked & in_bag(b.draw, period, share) for b in blocks]
        self.rows, self.others = ([np.flatnonzero(t == side) for t in taken] for side in (True, False))
        self.codes = np.concatenate([b.codes.take(at, axis=1) for b, at in zip(blocks, self.rows)], axis=1)

    def gradients(self, scale: float) -> tuple[np.ndarray, np.ndarray]:
        parts = [
            _gradients(1 / (1 + np.exp(-b.margin[at])), b.label[at], b.weight[at], scale)
            for b, at in zip(self.blocks, self.rows)
        ]
        return tuple(np.concatenate(column) for column in zip(*parts))

    def advance(self, tree: Tree, added: np.ndarray) -> None:
        """Adds a tree's answers to the margins; ``added``: those of the bag's rows."""
        start = 0
        for block, at, others in zip(self.blocks, self.rows, self.others):
            block.margin[at] += added[start : start + len(at)]
            block.margin[others] += tree.value[leaves_of_codes(tree, block.codes, others)]
            start += len(at)


class Growth:
    """A tree of a bag: rows and sums of its leaves. Of two children the smaller is summed, the other is the rest."""

    def __init__(self, bag: Bag, gradients: tuple, features: np.ndarray, width: int):
        self.bag, self.gradients, self.features, self.width = bag, gradients, features, width
        self.rows = {1: np.arange(bag.codes.shape[1])}
        self.sums = {1: self._sums(None)}

    def _sums(self, at: np.ndarray | None) -> np.ndarray:
        """(feature, code, 3) over the rows ``at``, all by default."""
        g, h = self.gradients if at is None else (part.take(at) for part in self.gradients)
        n, codes = len(self.features), self.bag.codes
        out = np.empty((n, self.width, 3), dtype=np.int64)
        if at is not None and len(at) <= FEW_ROWS:
            cells = (codes[self.features[:, None], at] + self.width * np.arange(n)[:, None]).ravel()
            for i, part in enumerate((g, h, None)):
                weights = None if part is None else np.tile(part, n)
                out[..., i] = np.bincount(cells, weights, n * self.width).reshape(n, self.width)
            return out
        both = g + 1j * h
        for i, f in enumerate(self.features):
            _add_cells((codes[f] if at is None else codes[f].take(at)).astype(np.intp), both, out[i])
        return out

    def rows_of(self, leaf: Leaf) -> np.ndarray:
        if leaf.path not in self.rows:
            at = self.rows.pop(leaf.parent.path)
            _, _, position, code, missing_left, _ = leaf.parent.split
            own = self.bag.codes[self.features[position]].take(at)
            left = own <= code  # MISSING is below all codes
            if not missing_left:
                left &= own != MISSING
            for path, side in ((2 * leaf.parent.path, left), (2 * leaf.parent.path + 1, ~left)):
                self.rows[path] = at.take(np.flatnonzero(side))
        return self.rows[leaf.path]

    def sums_of(self, leaf: Leaf) -> np.ndarray:
        if leaf.path not in self.sums:
            whole = self.sums.pop(leaf.parent.path)
            small, large = sorted(leaf.parent.children, key=lambda child: child.total[2])
            self.sums[small.path] = self._sums(self.rows_of(small))
            self.sums[large.path] = whole - self.sums[small.path]
        return self.sums[leaf.path]

    def added(self, leaves: list[Leaf], answers: list[float]) -> np.ndarray:
        """The answer of each row's leaf."""
        out = np.empty(self.bag.codes.shape[1])
        for leaf, answer in zip(leaves, answers, strict=True):
            out[self.rows_of(leaf)] = answer
        return out


@dataclass
class Alone:
    """One job of a fit whose rows are all in one task: it grows the next trees without another job.

    ``slots``: where each tree begins. ``chosen``: every tree's features. ``scores``: of the rounds so far.
    """

    trees: list[Tree]
    slots: dict[int, int]
    chosen: list[np.ndarray]
    first: int
    scores: list[float]
    bounds: list[np.ndarray]
    width: int
    scale: float
    rules: Rules
    validated: bool
    settings: dict

    def grow(self, blocks: Iterator[Block]) -> Iterator[tuple[list[Tree], list[float], bool]]:
        """(the new trees, the scores of all rounds so far, whether the fit is done)."""
        blocks = [_advanced(block, self.trees) for block in blocks]
        grown, scores, bag = [], list(self.scores), None
        for features in self.chosen:
            n = self.first + len(grown)
            if self.validated and n:
                ranks = np.zeros((2, AUC_CELLS), dtype=np.int64)
                for block in blocks:
                    _rank(block, 1 / (1 + np.exp(-block.margin)), ranks)
                scores.append(auc_of([_area(ranks)]))
            if _done(n, scores, self.settings):
                yield grown, scores, True
                return
            period, again = divmod(n, self.settings["bag_rounds"])
            if bag is None or not again:
                bag = None  # not two at a time
                bag = Bag(blocks, period, self.settings["row_fraction"])
            grown.append(self._tree(bag, features))
        yield grown, scores, False

    def _tree(self, bag: Bag, features: np.ndarray) -> Tree:
        growth = Growth(bag, bag.gradients(self.scale), features, self.width)

        def learned(sums: np.ndarray) -> tuple:
            return tuple(sums[0].sum(axis=0).tolist()), best_split(sums, self.scale, self.rules)

        limits = self.settings["leaves"], self.settings["max_depth"]
        grower = Grower(learned(growth.sums[1]), features, self.bounds, self.scale, self.rules, *limits, ahead=0)
        while leaves := grower.wanted():
            grower.learn(leaves, [learned(growth.sums_of(leaf)) for leaf in leaves])
        tree = grower.tree()
        bag.advance(tree, growth.added(grower.open, [grower.nodes[leaf.node]["value"] for leaf in grower.open]))
        return tree


def _done(n: int, scores: list[float], settings: dict) -> bool:
    return n == settings["trees"] or bool(scores) and len(scores) - _best(scores, n) >= settings["patience"]


def _best(scores: list[float], n: int) -> int:
    """How many of n trees are kept."""
    return int(np.argmax(scores)) + 1 if scores else n


# -------------------------------------------------------------------------------- fit


def train_leafwise(
    df: DataFrame,
    features: list[str],
    label: str = K.TARGET,
    validation: str | None = None,
    **overrides,
) -> LeafwiseScorer:
    """Fit with balanced class weights; one fit, never repeated.

    ``validation`` (0/1) marks rows that are not fitted but scored after every round; the
    model keeps the rounds up to the highest AUC on them, ends ``patience`` rounds later.
    Features may have missing values (NULL or NaN). Rows without label are left out.
    Settings: ``K.BOOSTING`` and ``K.LEAFWISE``.
    """
    settings = {**K.BOOSTING, **K.LEAFWISE, **overrides}
    if not 2 <= settings["bins"] <= 254:
        raise ValueError("codes are bytes: 2 to 254 bins")
    checked = F.coalesce(F.col(validation).cast("boolean"), F.lit(False)) if validation else F.lit(False)
    plain = [S.quoted(f.name) for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    hashed = F.xxhash64(F.lit(settings["seed"]), *plain)
    rows = df.where(S.quoted(label).isNotNull()).withColumns(
        {"_label": S.quoted(label).cast("double"), "_checked": checked, "_draw": hashed}
    )
    fitted = rows.where(~F.col("_checked"))
    counts = {r["_label"]: r["n"] for r in fitted.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(counts) != {0.0, 1.0}:
        raise ValueError(f"a fit needs rows of both classes, 0 and 1; found {sorted(counts)}")
    n = sum(counts.values())
    weights = {c: n / (2 * k) for c, k in counts.items()}
    weight = F.when(F.col("_label") == 1, F.lit(weights[1.0])).otherwise(F.lit(weights[0.0]))
    bounds = bin_bounds(fitted, features, settings["bins"])
    stored = materialize(coded_blocks(rows.withColumn("_weight", weight), features, bounds), "coded-rows")
    # whole-number sums: exact in the doubles of a block or a whole fit, whose weights add up to n
    batch = int(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    heaviest = max(weights.values())
    room = min(52 - np.log2(max(batch, 1) * heaviest), 53 - np.log2(n + 1), 40)
    return _boost(stored, n, features, bounds, float(2.0 ** np.floor(room)), validation is not None, settings)


def _boost(stored: DataFrame, n: int, features, bounds, scale, validated: bool, settings: dict) -> LeafwiseScorer:
    least = max(1, settings["min_rows_per_leaf"])
    rules = Rules(settings["l1"], settings["l2"], least, settings["learning_rate"])
    rng = np.random.default_rng(settings["seed"])
    share = settings["feature_fraction"]
    taken = len(features) if share == "all" else max(1, round(float(share) * len(features)))
    width = max((len(b) for b in bounds), default=0) + 2
    ensure_checkpoint_dir(stored.sparkSession)
    base = 0.0  # balanced classes weigh the same
    codes = n * max(len(features), 128)
    slots = stored.sparkSession.sparkContext.defaultParallelism
    tasks = 1 if codes <= TOGETHER else slots * -(-codes * SPREAD // (TOGETHER * slots))
    state = stored.repartition(tasks).rdd.map(lambda row: _block(row, base)).persist(StorageLevel.MEMORY_AND_DISK)
    trees, pending, scores, before, done = [], [], [], None, False

    def drawn() -> np.ndarray:
        return np.sort(rng.choice(len(features), taken, replace=False))

    try:
        while not done:
            if len(pending) >= (REFRESH if tasks == 1 else 1):
                reliable = len(trees) // RELIABLE > (len(trees) - len(pending)) // RELIABLE
                before, state = state, _refreshed(state, pending, reliable)
                pending = []
            if tasks == 1:
                # a lost task repeats few trees
                ahead = [drawn() for _ in range(min(max(1, len(trees) // 2), TREES_AT_ONCE))]
                grown, scores, done = _run(
                    state,
                    Alone(
                        pending, {0: 0}, ahead, len(trees), scores, bounds, width, scale, rules, validated, settings
                    ),
                )
            else:
                grown, scores, done = _grown(
                    state, pending, drawn(), len(trees), scores, bounds, width, scale, rules, validated, settings, tasks
                )
            if before is not None:  # the job has stored the blocks that follow them
                before.unpersist()
                before = None
            trees += grown
            pending = [*pending, *grown]
    finally:
        for blocks in (before, state):
            if blocks is not None:
                blocks.unpersist()
    best = _best(scores, len(trees))
    return LeafwiseScorer(BoostedTrees(base, trees[:best], len(features)), features, best, scores)


_ROOT = dict(feature=-1, code=0, cut=0.0, missing_left=False, left=0, right=0, value=0.0, rows=0, gain=0.0)


def _grown(
    state, pending, chosen, n: int, scores, bounds, width, scale, rules, validated: bool, settings: dict, tasks: int
) -> tuple[list[Tree], list[float], bool]:
    """The next tree of a fit of many tasks, none when it is done; one job per look ahead."""
    job = Pass(
        pending, as_tree([_ROOT]), {0: 0}, chosen, width, scale, n // settings["bag_rounds"],
        settings["row_fraction"], validated and n > 0, rules, min(tasks, len(chosen), state.context.defaultParallelism),
    )
    (root,), areas = _run(state, job)
    if job.check:
        scores = [*scores, auc_of(areas)]
    if _done(n, scores, settings):
        return [], scores, True
    grower = Grower(root, chosen, bounds, scale, rules, settings["leaves"], settings["max_depth"], AHEAD)
    while leaves := grower.wanted():
        trial, slots = grower.trial(leaves)
        grower.learn(leaves, _run(state, replace(job, growing=trial, slots=slots, check=False))[0])
    return [grower.tree()], scores, False


def _run(state, job: Pass | Alone) -> tuple:
    """Every leaf's (total, best split), and the areas of the ranges of score cells; of ``Alone`` what it grew."""
    if isinstance(job, Alone):
        return state.mapPartitions(job.grow).collect()[0]
    exchanged = state.mapPartitions(job.sums).partitionBy(job.parts, lambda part: part)
    found = sorted(exchanged.mapPartitions(job.splits).collect(), key=lambda answer: answer[0])
    leaves = []
    for slot in range(len(job.slots)):
        answers = [answer[1][slot] for answer in found]
        leaves.append((answers[0][0], min((s for _, s in answers if s), default=None)))
    return leaves, [answer[2] for answer in found]


def _refreshed(state, trees: list[Tree], reliable: bool):
    """Blocks whose margins include those trees; the next job stores them."""
    after = state.map(lambda block: _advanced(block, trees)).persist(StorageLevel.MEMORY_AND_DISK)
    if reliable:
        after.checkpoint()
    return after
