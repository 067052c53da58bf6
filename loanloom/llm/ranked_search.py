"""Ranked lexical search: the best documents of every query item, by a document FP-tree.

Terms are runs of ASCII letters and digits and of characters from U+0080 on, only A to Z in lower case. A
document is restricted to the terms of the items and kept as counts. N documents have a term, L is the
number of all their terms, n a document's, df the documents that hold a term, tf its
occurrences in the document. A term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))); a
document's length enters by m = 50 + (50 n N) div L; it scores the sum over the item's distinct terms of
w ((10 ** 9 tf) div (1000 tf + 20 m)).

Document FP-tree. A task puts its documents, a chunk at a time, in the order of their terms, the most frequent
first; documents share the path of their common first terms. A node keeps, over its subtree, the largest tf
of every term and the smallest m: the score of such a document bounds all of the subtree's. Depth first, a node is
entered for the items whose bound reaches their k-th best score so far; an item whose bound
fails stays out of the subtree. What is found in one chunk bounds the next. The items that enter a
node are worked on together.

Every task gives at most k rows an item; they are ranked by salted groups, then by item. Terms' document
frequencies and item lists go to the tasks for one block of items (BLOCK characters) at a time;
documents stay where they are. A group of copies with a third of all rows is spread over tasks like any rows.

Defined results: a null or empty text, document or item, has no terms, finds nothing and is not found. Equal
scores go by ascending doc_id, null ones last; rows with one doc_id are ranked each. Every row of
items is an item, also with a repeated or null id. Only id and text are read, so other columns may have any names.
An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.llm.common import shuffle_partitions
from loanloom.session import materialize

BLOCK = 1_000_000  # characters of items searched for together
CELLS = 1 << 22  # documents times terms of a chunk
FEW = 24  # documents of a subtree that are scored at once
WAITING = 1 << 17  # candidates that wait until they are ranked

# bytes of a text: capitals become small, all that is no term a blank
_TERMS = bytes(
    b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


# ------------------------------------------------------------------------ tree


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


@dataclass
class Tree:
    """Rows of counts: first the chunk's documents, then the inner nodes with their maxima."""

    counts: np.ndarray
    m: np.ndarray
    kids: dict[int, list[int]]
    below: dict[int, np.ndarray]  # an inner node's documents
    root: int


def build(sequences: list[np.ndarray], counts: np.ndarray, m: np.ndarray) -> Tree:
    """The tree of documents given by their terms' ranks, ascending; ``counts`` by (document, term)."""
    n = len(sequences)
    names = [s.astype(">u4").tobytes() for s in sequences]
    order = sorted(range(n), key=names.__getitem__)
    rows, smallest = [counts], [m]
    kids: dict[int, list[int]] = {}
    below: dict[int, np.ndarray] = {}
    made: list[tuple[np.ndarray, int]] = []

    def row(k: int) -> tuple[np.ndarray, int]:
        return (counts[k], int(m[k])) if k < n else made[k - n]

    def close(children: list[int]) -> int:
        node = n + len(made)
        parts = [row(k) for k in children]
        made.append((np.maximum.reduce([p[0] for p in parts]), min(p[1] for p in parts)))
        kids[node] = children
        below[node] = np.concatenate([below[k] if k >= n else [k] for k in children]).astype(np.int64)
        return node

    def shared(a: np.ndarray, b: np.ndarray) -> int:
        size = min(len(a), len(b))
        differs = np.flatnonzero(a[:size] != b[:size])
        return int(differs[0]) if len(differs) else size

    stack: list[tuple[int, list[int]]] = [(0, [])]
    for i, at in enumerate(order):
        depth = shared(sequences[at], sequences[order[i + 1]]) if i + 1 < n else -1
        node = at
        while stack and stack[-1][0] > depth:
            children = stack.pop()[1]
            children.append(node)
            node = close(children)
        if depth < 0:
            break
        if stack[-1][0] < depth:
            stack.append((depth, [node]))
        else:
            stack[-1][1].append(node)
    if made:
        rows.append(np.stack([r for r, _ in made]))
        smallest.append(np.array([s for _, s in made], m.dtype))
    return Tree(np.concatenate(rows), np.concatenate(smallest), kids, below, node)


class Best:
    """The k best documents of each item, and the score that a further one must reach."""

    def __init__(self, items: int, k: int):
        self.k, self.kth = k, np.ones(items, np.int64)
        self.kth_id = np.full(items, np.iinfo(np.int64).max)
        self.kept = tuple(np.empty(0, np.int64) for _ in range(4))  # item, score, id, id is null
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def offer(self, item, score, doc, missing) -> None:
        self.waiting.append((item, score, doc, missing))
        self.size += len(item)
        if self.size >= WAITING:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        item, score, doc, missing = (np.concatenate(c) for c in zip(self.kept, *self.waiting))
        order = np.lexsort((doc, missing, -score, item))
        item, score, doc, missing = item[order], score[order], doc[order], missing[order]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(first, np.diff(first, append=len(item)))
        last = place == self.k - 1
        self.kth[item[last]], self.kth_id[item[last]] = score[last], np.where(missing[last], np.iinfo(np.int64).max, doc[last])
        top = place < self.k
        self.kept = item[top], score[top], doc[top], missing[top]
        self.waiting, self.size = [], 0


class Searcher:
    """Searches chunk after chunk for all items of a block."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, frequency: np.ndarray, k: int):
        self.items, self.weights = items, weights
        self.rank = np.empty(len(weights), np.int64)
        self.rank[np.lexsort((np.arange(len(weights)), -frequency))] = np.arange(len(weights))
        self.best = Best(len(items), k)

    def chunk(self, ids, missing, m, sizes, flat, counts) -> None:
        """Documents with their terms (``flat``, by document) and how often they occur."""
        used = np.unique(flat)
        if len(sizes) > 1 and len(sizes) * len(used) > CELLS:
            half = len(sizes) // 2
            cut = int(sizes[:half].sum())
            self.chunk(ids[:half], missing[:half], m[:half], sizes[:half], flat[:cut], counts[:cut])
            self.chunk(ids[half:], missing[half:], m[half:], sizes[half:], flat[cut:], counts[cut:])
            return
        ranks = np.sort(self.rank[used])
        term_at = {int(r): i for i, r in enumerate(ranks.tolist())}  # columns go by rank
        column = np.searchsorted(ranks, self.rank[flat])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        table = np.zeros((len(sizes), len(used)), np.int64)
        table[owner, column] = counts
        ends = np.cumsum(sizes)
        by_rank = column[np.lexsort((column, owner))]
        tree = build([by_rank[a:b] for a, b in zip(ends - sizes, ends)], table, m)
        weights = np.empty(len(used), np.int64)
        weights[np.searchsorted(ranks, self.rank[used])] = self.weights[used]
        own = [np.array([c for r in self.rank[t].tolist() if (c := term_at.get(r)) is not None], np.int64) for t in self.items]
        self._search(tree, weights, own, ids, missing)

    def _search(self, tree: Tree, weights, own, ids, missing) -> None:
        best, n = self.best, len(ids)
        able = np.array([i for i, c in enumerate(own) if len(c)], np.int64)
        stack = [(tree.root, able)]
        while stack:
            node, items = stack.pop()
            if node < n or len(tree.below[node]) <= FEW:
                kids = np.array([node]) if node < n else tree.below[node]
            else:
                kids = np.array(tree.kids[node])
            # thresholds have grown since the node was put aside
            if node >= n:
                items = items[self._scores(tree, np.array([node]), weights, own, items)[0] >= best.kth[items]]
            if not len(items):
                continue
            inner = []
            width = sum(len(own[i]) for i in items.tolist())
            step = max(1, CELLS // max(1, width))
            for a in range(0, len(kids), step):
                some = kids[a : a + step]
                scores = self._scores(tree, some, weights, own, items)
                good = scores >= best.kth[items]
                leaf = some < n
                row, item = np.nonzero(good & leaf[:, None])
                doc, score = some[row], scores[row, item]
                later = (score == best.kth[items[item]]) & (ids[doc] > best.kth_id[items[item]])
                row, item, doc, score = row[~later], item[~later], doc[~later], score[~later]
                if len(doc):
                    best.offer(items[item], score, ids[doc], missing[doc])
                for r in np.flatnonzero(~leaf & good.any(axis=1)).tolist():
                    inner.append((int(scores[r].max()), int(some[r]), items[good[r]]))
            inner.sort(key=lambda x: x[0])  # the most promising is taken first
            stack += [(k, i) for _, k, i in inner]

    @staticmethod
    def _scores(tree: Tree, rows, weights, own, items) -> np.ndarray:
        """Scores of documents, bounds of inner nodes, for the given items."""
        flat = np.concatenate([own[i] for i in items.tolist()])
        used, place = np.unique(flat, return_inverse=True)
        tf = tree.counts[rows][:, used]
        part = weights[used] * (1_000_000_000 * tf // (1000 * tf + 20 * tree.m[rows][:, None]))
        starts = np.cumsum([0, *(len(own[i]) for i in items.tolist())])[:-1]
        return np.add.reduceat(part[:, place], starts, axis=1)


# -------------------------------------------------------------------- operator


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """(id, distinct terms) of the items, in blocks of about BLOCK characters; the driver holds one."""
    rows, size = [], 0
    for item, words in items.select(F.col(item_id), F.col(text).cast("string")).toLocalIterator():
        rows.append((item, sorted(set(terms(words)))))
        size += len(words or "")
        if size >= BLOCK:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def restricted(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str) -> DataFrame:
    """doc_id, n, terms and their counts: a document by the numbers of the vocabulary's terms."""
    number = {t: i for i, t in enumerate(vocabulary)}

    @F.pandas_udf("n long, terms array<int>, counts array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        sizes, found, counts = [], [], []
        for t in texts:
            words = terms(t)
            held = [(number[w], c) for w, c in Counter(words).items() if w in number]
            sizes.append(len(words))
            both = np.array(held, np.int32).reshape(-1, 2)
            found.append(both[:, 0].copy())
            counts.append(both[:, 1].copy())
        return pd.DataFrame({"n": sizes, "terms": found, "counts": counts})

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), run(F.col(text).cast("string")).alias("t"))
    return found.select("doc_id", "t.*")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents with a score above 0 of every item."""
    kind = items.schema[item_id].dataType
    found = None
    for block in _blocks(items, item_id, item_text):
        part = _search_block(docs, block, kind, k, doc_id, text)
        found = part if found is None else found.unionAll(part)
    if found is None:
        empty = f"item_id {kind.simpleString()}, rank int, doc_id long, score long"
        return docs.sparkSession.createDataFrame([], empty)
    return found


def _search_block(docs: DataFrame, block: list[tuple], kind, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, words in block for t in words})
    number = {t: i for i, t in enumerate(vocabulary)}
    lists = [np.array([number[t] for t in words], np.int64) for _, words in block]
    vectors = materialize(restricted(docs, vocabulary, doc_id, text), "search-vectors")
    whole = vectors.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("l")).first()
    documents, length = whole["n"], whole["l"] or 0
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = np.zeros(len(vocabulary), np.int64)
    for row in held.collect():  # one row per term of the block
        frequency[row["term"]] = row["df"]
    weights = np.array([weight(documents, f) for f in frequency.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(lists, weights, frequency, k)
        for batch in batches:
            ids = batch.column("doc_id")
            lengths = batch.column("n").to_numpy()
            searcher_rows = batch.column("terms")
            flat = searcher_rows.flatten().to_numpy().astype(np.int64)
            counts = batch.column("counts").flatten().to_numpy().astype(np.int64)
            sizes = searcher_rows.value_lengths().to_numpy().astype(np.int64)
            some = sizes > 0
            if not some.any():
                continue
            missing = ids.is_null().to_numpy(zero_copy_only=False)[some].astype(np.int64)
            known = ids.fill_null(np.iinfo(np.int64).max).to_numpy()[some]
            m = 50 + 50 * lengths[some] * documents // length
            searcher.chunk(known, missing, m, sizes[some], flat, counts)
        searcher.best.settle()
        item, score, doc, missing = searcher.best.kept
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(doc, mask=missing.astype(bool)), pa.array(score)],
            names=["item", "doc_id", "score"],
        )

    rows = vectors.where(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(shuffle_partitions(spark)))
    salted = rows.withColumn("salt", salt)
    for by in (["item", "salt"], ["item"]):
        rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], _named(kind))
    # one row per item of the block
    return salted.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _named(kind):
    from pyspark.sql.types import LongType, StructField, StructType

    return StructType([StructField("item", LongType()), StructField("item_id", kind)])
