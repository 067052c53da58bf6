"""Benchmark passages in documents, by shared character q-grams and banded alignment.

Texts are compared in lower case with runs of white space as one blank. A passage
of m characters may differ by k = rate * m edits. A place in a text that
matches shares at least m + 1 - Q (k + 1) q-grams with the passage (q-gram lemma),
all on diagonals at most k apart. Shared q-grams are counted in overlapping
bands of diagonals, wide enough that some band holds all of a match; bands that reach the
bound are verified by alignment inside the band.

The benchmark is the query set. It is read in blocks of BLOCK characters; a task
holds the index of one block and a window of a text. Passages that have too few different q-grams in
the window are left before anything is spread out, so a phrase that many passages share costs no more than its
entries in the index; the others' shared q-grams are spread out SLICE at a time.

Defined results: a null text matches nothing, an empty table on either side gives no rows. Texts of
any length are searched whole. Columns other than id and text may have any names. A passage shorter than Q
characters cannot identify a leak and matches nothing. Of overlapping places of one passage
the one with fewest edits is given. Repeated passages each match; a passage with a null id
counts like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm import codepoints
from loanloom.session import materialize

Q = 8
RATE = 0.1
BLOCK = 4_000_000
WINDOW = 1 << 20
SHORTER = (6, 4)  # shorter q-grams that candidates are held against as well
SLICE = 1 << 20  # shared q-grams spread out at once
LANES = 1 << 18  # diagonals aligned at once
FILTER_BITS = 20


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points with single blanks, and where each stands in the text."""
    points = codepoints.array_of(text)
    space = codepoints.classes()[points] == codepoints.SPACE
    keep = np.flatnonzero(~(space & np.concatenate(([True], space[:-1]))))
    kept = np.where(space[keep], 32, codepoints.lower()[points[keep]]).astype(np.uint32)
    if len(kept) and kept[-1] == 32:
        kept, keep = kept[:-1], keep[:-1]
    return kept, keep


def grams(points: np.ndarray) -> np.ndarray:
    """Hashes of all Q = 8 consecutive code points."""
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mult, step = 0xD6E8FEB86659FD93, 1
    while step < Q:
        if len(h) <= step:
            return np.empty(0, np.uint64)
        h = h[:-step] * np.uint64(mult) + h[step:]
        mult, step = mult * mult % (1 << 64), step * 2
    return h ^ (h >> np.uint64(29))


def short_grams(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q consecutive code points, for q below Q."""
    n = max(0, len(points) - q + 1)
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : n + j].astype(np.uint64) + np.uint64(1)
    return h


class Index:
    """The q-grams of one block of passages."""

    def __init__(self, passages: tuple[str, ...], rate: float):
        self.points = [normal(p)[0] for p in passages]
        self.size = np.array([len(p) for p in self.points], np.int64)
        allowed = np.minimum((self.size * rate).astype(np.int64), (self.size - Q) // Q)
        self.edits = np.maximum(allowed, 0)
        self.bound = self.size + 1 - Q * (self.edits + 1)
        self.width = np.maximum(self.edits, 4)  # half a band, so that any k + 1 diagonals share one
        codes, owner, place = [], [], []
        for k, p in enumerate(self.points):
            g = grams(p)
            codes.append(g)
            owner.append(np.full(len(g), k))
            place.append(np.arange(len(g)))
        codes = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.owner = np.concatenate(owner)[order] if len(order) else np.empty(0, np.int64)
        self.place = np.concatenate(place)[order] if len(order) else np.empty(0, np.int64)
        self.codes, self.start, self.count = np.unique(codes[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self._slot(self.codes)] = True
        some = self.size >= Q
        self.least = int(self.bound[some].min()) if some.any() else 0
        self.longest = int(self.size[some].max() + self.edits[some].max()) if some.any() else 0

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    @lru_cache(maxsize=4096)
    def _short(self, k: int, q: int) -> np.ndarray:
        return short_grams(self.points[k], q)

    def may_hold(self, points: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Whether the lemma holds for shorter q-grams too, wherever they stand; these ask for more of a passage."""
        left = np.ones(len(owners), bool)
        for q in SHORTER:
            some = np.flatnonzero(left)
            if not len(some):
                break
            own = [self._short(k, q) for k in owners[some].tolist()]
            there = np.isin(np.concatenate(own), short_grams(points, q))
            which = np.repeat(np.arange(len(own)), [len(o) for o in own])
            shared = np.bincount(which, there, minlength=len(own))
            k = owners[some]
            left[some] = shared >= self.size[k] + 1 - q * (self.edits[k] + 1)
        return left

    def meet(self, points: np.ndarray) -> Meeting | None:
        """The q-grams a text shares with the passages that have enough of theirs in it."""
        codes = grams(points)
        at = np.flatnonzero(self.seen[self._slot(codes)])
        if len(at) < self.least:
            return None
        row = np.searchsorted(self.codes, codes[at])
        row[row == len(self.codes)] = 0
        same = self.codes[row] == codes[at]
        at, row = at[same], row[same]
        if len(at) < self.least:
            return None
        # each distinct q-gram once: how many places of a passage occur, and how often in all
        codes_, times = np.unique(row, return_counts=True)
        entry = _spans(self.start[codes_], self.count[codes_])
        owner = self.owner[entry]
        places = np.bincount(owner, minlength=len(self.size))
        hits = np.bincount(owner, np.repeat(times, self.count[codes_]), minlength=len(self.size)).astype(np.int64)
        good = (places >= self.bound) & (self.size >= Q)
        good[good] = self.may_hold(points, np.flatnonzero(good))
        if not good.any():
            return None
        kept = good[owner]
        return Meeting(self, at, row, np.where(good, hits, 0), entry[kept], np.repeat(codes_, self.count[codes_])[kept])


def _spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every span, one after another."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Meeting:
    """Shared q-grams of a text, given out for some passages at a time."""

    def __init__(self, index: Index, at: np.ndarray, row: np.ndarray, hits: np.ndarray, entry: np.ndarray, code: np.ndarray):
        self.index, self.hits, self.entry, self.code = index, hits, entry, code
        order = np.argsort(row, kind="stable")
        self.at = at[order]  # text places by q-gram
        self.first = np.searchsorted(row[order], np.arange(len(index.codes) + 1))

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Passage, place in it and diagonal (place in text minus that); at most SLICE of them,
        or those of one passage, are spread out at once."""
        owners = np.flatnonzero(self.hits)
        part = np.empty(len(self.hits), np.int64)
        number, size = 0, 0
        for k in owners.tolist():
            if size and size + self.hits[k] > SLICE:
                number, size = number + 1, 0
            part[k], size = number, size + self.hits[k]
        owner = self.index.owner[self.entry]
        for k in range(number + 1):
            own = part[owner] == k
            entry, code = self.entry[own], self.code[own]
            n = self.first[code + 1] - self.first[code]
            place = np.repeat(self.index.place[entry], n)
            yield np.repeat(self.index.owner[entry], n), place, self.at[_spans(self.first[code], n)] - place


def banded(passage: np.ndarray, text: np.ndarray, starts: np.ndarray, lanes: np.ndarray, anchored: bool = False):
    """Fewest edits between the whole passage and a part of the text, and where that part ends, in many bands.

    A band looks at the diagonals start + lane only. ``anchored``: the part begins at the band's start.
    """
    far = len(passage) + len(text) + 1
    padded = np.concatenate((text.astype(np.int64), [-1]))
    diagonal = starts[:, None] + lanes
    lowest = starts[:, None] if anchored else np.zeros((len(starts), 1), np.int64)
    row = np.where((diagonal >= lowest) & (diagonal <= len(text)), lanes if anchored else 0, far)
    steps = np.arange(len(lanes))
    for i, point in enumerate(passage.tolist()):
        column = i + diagonal  # the text character that meets this one
        inside = (column >= lowest) & (column < len(text))
        differs = padded[np.where(inside, column, -1)] != point
        best = np.where(inside, row + differs, far)
        best[:, :-1] = np.minimum(best[:, :-1], row[:, 1:] + 1)
        best = np.where((column + 1 >= lowest) & (column < len(text)), best, far)
        row = np.minimum.accumulate(best - steps, axis=1) + steps
    row = np.where(len(passage) + diagonal <= len(text), row, far)
    k = row.argmin(axis=1)
    bands = np.arange(len(starts))
    return row[bands, k], len(passage) + diagonal[bands, k]


def find(text: str | None, index: Index) -> list[tuple[int, int, int, int]]:
    """(passage, start, end, edits) of every place, in characters of the text as given."""
    if not text or not index.least:
        return []
    points, origin = normal(text)
    places: dict[int, list[tuple[int, int, int]]] = {}
    begin = 0
    while begin < len(points):
        window = WINDOW
        meeting = index.meet(part := points[begin : begin + window + index.longest])
        # a passage that repeats itself in a text that does too: look at less of the text at once
        while meeting and window > index.longest and meeting.hits.max() > SLICE:
            window //= 2
            meeting = index.meet(part := points[begin : begin + window + index.longest])
        for owner, place, diagonal in meeting.slices() if meeting else ():
            for k, cost, a, b in _places(index, part, owner, place, diagonal):
                places.setdefault(k, []).append((cost, begin + a, begin + b))
        begin += window
    found = []
    for k, spots in places.items():
        taken: list[tuple[int, int]] = []
        for edits, a, b in sorted(set(spots)):
            if all(b <= c or a >= d for c, d in taken):
                taken.append((a, b))
                found.append((k, int(origin[a]), int(origin[b - 1]) + 1, edits))
    return sorted(found)


def _places(index: Index, part: np.ndarray, owner: np.ndarray, place: np.ndarray, diagonal: np.ndarray):
    """(passage, edits, start, end) of the best place in every band that holds enough shared q-grams."""
    band = diagonal // index.width[owner]
    both = np.concatenate((band, band - 1))  # band b holds diagonals [b, b + 2) * width
    who, where = np.concatenate((owner, owner)), np.concatenate((place, place))
    order = np.lexsort((where, both, who))
    who, both, where, hit = who[order], both[order], where[order], order % len(owner)
    new = np.concatenate(([True], (who[1:] != who[:-1]) | (both[1:] != both[:-1])))
    edge = np.flatnonzero(new)
    # the shared q-grams must be different ones of the passage
    different = np.add.reduceat(new | np.concatenate(([True], where[1:] != where[:-1])), edge, dtype=np.int64)
    reach = different >= index.bound[who[edge]]
    ends = np.append(edge[1:], len(who))
    open_: dict[int, list[int]] = {}
    for a, b in zip(edge[reach].tolist(), ends[reach].tolist()):
        k, found = int(who[a]), np.sort(diagonal[hit[a:b]])
        edits, bound, size = int(index.edits[k]), int(index.bound[k]), int(index.size[k])
        # and lie on some k + 1 diagonals
        if (np.searchsorted(found, found + edits, "right") - np.arange(len(found))).max() < bound:
            continue
        values, counts = np.unique(found, return_counts=True)
        top = int(values[counts.argmax()])
        if top >= 0 and np.array_equal(part[top : top + size], index.points[k]):
            yield k, 0, top, top + size
            continue
        low = int(both[a]) * int(index.width[k])
        region = part[max(0, low) : low + 2 * int(index.width[k]) + size + edits]
        if index.may_hold(region, np.array([k])).all():
            open_.setdefault(k, []).append(int(both[a]))
    for k, bands in open_.items():
        yield from _aligned(index, part, k, np.array(bands))


def _aligned(index: Index, part: np.ndarray, k: int, bands: np.ndarray):
    """Bands of one passage verified by alignment, many at once."""
    passage, edits, width = index.points[k], int(index.edits[k]), int(index.width[k])
    step = max(1, LANES // (2 * width))
    for a in range(0, len(bands), step):
        cost, end = banded(passage, part, bands[a : a + step] * width, np.arange(2 * width))
        good = (cost <= edits) & (cost < len(passage))
        ends, first = np.unique(end[good], return_index=True)
        if not len(ends):
            continue
        cost = cost[good][first]
        # backwards from where the places end
        _, back = banded(passage[::-1], part[::-1], len(part) - ends, np.arange(-edits, edits + 1), anchored=True)
        for c, start, stop in zip(cost.tolist(), (len(part) - back).tolist(), ends.tolist()):
            yield k, c, start, stop


@lru_cache(maxsize=2)
def index_of(passages: tuple[str, ...], rate: float) -> Index:
    return Index(passages, rate)


# ------------------------------------------------------------------- operators


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about BLOCK characters; the driver holds one at a time."""
    rows, size = [], 0
    chosen = benchmark.select(F.col(item_id), F.col(text).cast("string")).where(F.col(text).isNotNull())
    for item, passage in chosen.toLocalIterator():
        rows.append((item, passage))
        size += len(passage)
        if size >= BLOCK:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def _search(items: list, passages: tuple[str, ...], rate: float, kind: str):
    """UDF: all places of a block's passages in a text."""
    names = ("item_id", "start", "end", "edits")

    @F.pandas_udf(f"array<struct<item_id: {kind}, start: bigint, end: bigint, edits: int>>")
    def search(texts: pd.Series) -> pd.Series:
        own = index_of(passages, rate)
        found = [[dict(zip(names, (items[k], *place))) for k, *place in find(t, own)] for t in texts]
        return pd.Series(found, dtype=object)

    return search


def _clean(passages: tuple[str, ...], rate: float):
    """UDF: whether a text holds none of a block's passages."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        own = index_of(passages, rate)
        return pd.Series([not find(t, own) for t in texts], dtype=bool)

    return clean


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per place: doc_id, item_id, start, end, edits."""
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType.simpleString()
    id_kind = docs.schema[doc_id].dataType.simpleString()
    found = spark.createDataFrame([], f"doc_id {id_kind}, item_id {kind}, start long, end long, edits int")
    for block in blocks(benchmark, item_id, item_text):
        search = _search([b[0] for b in block], tuple(b[1] for b in block), rate, kind)
        hits = docs.select(
            F.col(doc_id).alias("doc_id"), F.explode(search(F.col(text).cast("string"))).alias("hit")
        )
        found = found.unionAll(materialize(hits.select("doc_id", "hit.*"), "leaks"))
    return found


def drop_leaked(
    docs: DataFrame,
    benchmark: DataFrame,
    rate: float = RATE,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark. Nothing is shuffled."""
    kept = docs
    for number, block in enumerate(blocks(benchmark, item_id, item_text)):
        clean = _clean(tuple(b[1] for b in block), rate)
        so_far = materialize(kept, "clean-so-far") if number else kept
        kept = so_far.where(clean(F.col(text).cast("string")))
    return kept
