"""Periodic runs of words: places where a text repeats itself without a break.

A run of period q is a longest stretch of words in which words q apart are equal, q the
smallest such distance, at least ``least`` = 12 words and two periods long.

Block convolution. A run of period q holds q words more than its last period, and so an aligned block
of about half that size whose copy q words on lies in the run as well. So at each dyadic scale
the text is cut into blocks of B words, and every block is looked for in the window that follows it at
distances 2 B - 1 to 4 B - 2 (1 to 6 at the first scale, B = 2): the sums of squared differences of word
numbers at all distances come from one convolution, by a number-theoretic
transform over integers modulo a prime. Where the sum is zero the block occurs; equality of the words is
checked, since a sum may also be a multiple of the prime. The distance is the seed's period; the
stretch is extended to both sides word by word. Scales and distances go up, so a stretch that turns up again
at a multiple of its period is known already.

Two things are not transformed, since they cannot hold a new occurrence: blocks with a word that does not come
again within the window, and blocks whose whole window lies in a known run with a period of at most B (there
every occurrence is at a multiple of that period).

A text is worked on by one task, in O(n log^2 n); nothing is shuffled. Texts of a batch share the
transforms.

Defined results: a null text has no words. White space is space and the ASCII controls 9 to 13. Repeated rows
are each given their runs. Extra columns are left out. A text of any length is looked at whole, up to
2 ** 27 words (more raise an error; an Arrow string cannot hold many more).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
PRIME = 2013265921  # 15 * 2 ** 27 + 1
GENERATOR = 31
LARGEST = 1 << 27  # longest transform
TOGETHER = 1 << 20  # array cells transformed at once
BATCH = 1 << 19  # words looked at together, or one text


# ----------------------------------------------------------------- convolution


def _reduced(x: np.ndarray) -> np.ndarray:
    """x mod PRIME for x < 2 ** 63, without a slow remainder."""
    x -= x // np.uint64(PRIME) * np.uint64(PRIME)
    return x


@lru_cache(maxsize=None)
def _roots(half: int, back: bool) -> np.ndarray:
    """The first ``half`` powers of a root of unity of order 2 * half."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if back else root
    powers = np.ones(half, np.uint64)
    size, factor = 1, root
    while size < half:
        powers[size : 2 * size] = _reduced(powers[:size] * np.uint64(factor))
        size, factor = 2 * size, factor * factor % PRIME
    return powers


def transform(rows: np.ndarray) -> np.ndarray:
    """Transforms of the rows, their values in bit-reversed order."""
    m, size = rows.shape
    half, p = size // 2, np.uint64(PRIME)
    while half:
        a = rows.reshape(m, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1]
        added, less = u + v, u + (p - v)
        rows = np.stack((np.minimum(added, added - p), _reduced(less * _roots(half, False))), axis=2)
        half //= 2
    return rows.reshape(m, size)


def back(rows: np.ndarray) -> np.ndarray:
    """The inverse of :func:`transform`."""
    m, size = rows.shape
    half, p = 1, np.uint64(PRIME)
    while half < size:
        a = rows.reshape(m, -1, 2, half)
        u, v = a[:, :, 0], _reduced(a[:, :, 1] * _roots(half, True))
        added, less = u + v, u + (p - v)
        rows = np.stack((np.minimum(added, added - p), np.minimum(less, less - p)), axis=2)
        half *= 2
    return _reduced(rows.reshape(m, size) * np.uint64(pow(size, PRIME - 2, PRIME)))


def square_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo PRIME, of each block laid at every place of its window."""
    m, b = blocks.shape
    places, size = windows.shape[1] - b + 1, 1 << (windows.shape[1] - 1).bit_length()
    first, second = np.zeros((m, size), np.uint64), np.zeros((m, size), np.uint64)
    first[:, :b], second[:, : windows.shape[1]] = blocks[:, ::-1], windows
    both = back(_reduced(transform(first) * transform(second)))[:, b - 1 : b - 1 + places]
    p = np.uint64(PRIME)
    own = _reduced((blocks * blocks).sum(axis=1, dtype=np.uint64))[:, None]
    sums = np.concatenate((np.zeros((m, 1), np.uint64), np.cumsum(windows * windows, axis=1, dtype=np.uint64)), axis=1)
    there = _reduced(sums[:, b:] - sums[:, :-b])
    return _reduced(own + there + np.uint64(2) * (p - both))


# ------------------------------------------------------------------------ runs


def _equal_after(words: np.ndarray, a: int, b: int, limit: int) -> int:
    """How many words from a and from b > a on are pairwise equal, below ``limit``."""
    done, step = 0, 64
    while b + done < limit:
        m = min(step, limit - b - done)
        differs = words[a + done : a + done + m] != words[b + done : b + done + m]
        k = int(differs.argmax())
        if differs[k]:
            return done + k
        done, step = done + m, min(2 * step, 1 << 20)
    return done


def _equal_before(words: np.ndarray, a: int, b: int, limit: int) -> int:
    """How many words before a and before b > a are pairwise equal, from ``limit`` on."""
    done, step = 0, 64
    while a - done > limit:
        m = min(step, a - done - limit)
        differs = (words[a - done - m : a - done] != words[b - done - m : b - done])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return done + k
        done, step = done + m, min(2 * step, 1 << 20)
    return done


class Search:
    """Runs in several texts, whose word numbers stand one after another."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, least: int = LEAST):
        self.words, self.least = words, least
        sizes = np.diff(bounds)
        self.begin, self.end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
        self.absent = np.uint64(words.max() + 1 if len(words) else 0)
        self.longest = int(sizes.max()) if len(sizes) else 0
        self.again = self._next_distance()
        # of some known run that holds the word: its end and period
        self.cover_end, self.cover_period = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        self.found: dict[tuple[int, int], int] = {}

    def _next_distance(self) -> np.ndarray:
        """How far on in its text each word comes again."""
        far = np.full(len(self.words), np.iinfo(np.int64).max)
        order = np.argsort(self.words, kind="stable")
        a, b = order[:-1], order[1:]
        same = (self.words[a] == self.words[b]) & (self.end[a] == self.end[b])
        far[a[same]] = (b - a)[same]
        return far

    def runs(self) -> dict[tuple[int, int], int]:
        """Period by (start, end) of every run."""
        room = self.end - self.begin
        at = np.flatnonzero(((np.arange(len(self.words)) - self.begin) & 1 == 0) & (room >= self.least))
        size, low, count = 2, 1, 6
        while 2 * low <= self.longest:
            at = at[((at - self.begin[at]) & (size - 1) == 0) & (room[at] >= 2 * low)]
            self._scale(at, size, low, count)
            size *= 2
            low, count = 2 * size - 1, 2 * size
        return self.found

    def _scale(self, at: np.ndarray, size: int, low: int, count: int) -> None:
        high = low + count - 1
        lost = np.concatenate(([0], np.cumsum(self.again > high)))
        at = at[at + size + low <= self.end[at]]
        at = at[lost[at + size] == lost[at]]
        known = (self.cover_period[at] <= size) & (np.minimum(at + size + high, self.end[at]) <= self.cover_end[at])
        at = at[~known]
        if not len(at):
            return
        if size + count > LARGEST:
            raise ValueError(f"a text of {self.longest} words is too long")
        step = max(1, TOGETHER // (4 * size))
        seeds = [self._occurrences(at[k : k + step], size, low, count) for k in range(0, len(at), step)]
        where, period = (np.concatenate(s) for s in zip(*seeds))
        order = np.lexsort((where, period))
        where, period = where[order], period[order]
        edges = np.flatnonzero(np.diff(period, prepend=0, append=0))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            self._extend(where[a:b], int(period[a]), size)

    def _occurrences(self, at: np.ndarray, size: int, low: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, distance) of every occurrence in the blocks' windows."""
        blocks = self.words[at[:, None] + np.arange(size)].astype(np.uint64)
        place = at[:, None] + low + np.arange(count + size - 1)
        inside = place < self.end[at][:, None]
        windows = self.words[np.where(inside, place, 0)].astype(np.uint64)
        windows[~inside] = self.absent
        row, distance = np.nonzero(square_differences(blocks, windows) == 0)
        where, period = at[row], low + distance
        fresh = ~self._known(where, period, size)
        where, period = where[fresh], period[fresh]
        good = np.ones(len(where), bool)
        step = max(1, TOGETHER // size)
        for k in range(0, len(where), step):
            one = where[k : k + step, None] + np.arange(size)
            two = np.minimum(one + period[k : k + step, None], len(self.words) - 1)
            good[k : k + step] = (self.words[one] == self.words[two]).all(axis=1)
        good &= where + period + size <= self.end[where]
        return where[good], period[good]

    def _known(self, where: np.ndarray, period: np.ndarray | int, size: int) -> np.ndarray:
        """Occurrences inside a known run at a multiple of its period."""
        covered = self.cover_period[where]
        inside = (covered > 0) & (self.cover_end[where] >= where + period + size)
        return inside & (period % np.maximum(covered, 1) == 0)

    def _extend(self, where: np.ndarray, period: int, size: int) -> None:
        upto = 0
        for x in where[~self._known(where, period, size)].tolist():
            if x + size <= upto:
                continue
            first, last = int(self.begin[x]), int(self.end[x])
            start = x - _equal_before(self.words, x, x + period, first)
            upto = x + size + _equal_after(self.words, x + size, x + size + period, last)
            stop = upto + period
            if stop - start >= max(self.least, 2 * period) and (start, stop) not in self.found:
                self.found[start, stop] = period
                better = np.flatnonzero(self.cover_end[start:stop] < stop) + start
                self.cover_end[better], self.cover_period[better] = stop, period


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def find(texts: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs, in this order; texts are lists of words."""
    number = _Numbers()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.concatenate([np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts] or [np.empty(0, np.int64)])
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (start, stop), period in Search(words, bounds, least).runs().items():
        k = int(np.searchsorted(bounds, start, "right")) - 1
        found[k].append((start - int(bounds[k]), stop - start, period))
    return [sorted((s, n, p) for s, n, p in one) for one in found]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


# -------------------------------------------------------------------- operator


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batches(texts: Iterator[str | None]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        words = (text or "").encode().split()  # bytes are cut at exactly the six ASCII blanks
        group.append(words)
        size += len(words)
        if size >= BATCH:
            yield group
            group, size = [], 0
    yield group


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period) and the text with each run cut to one period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id"), 0
            for group in _batches(iter(batch.column("text").to_pylist())):
                found = [sorted(runs, key=lambda r: (r[0], r[2])) for runs in find(group, least)]
                kept = [collapse(words, runs).decode() for words, runs in zip(group, found)]
                flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
                inner = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(RUN))
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                columns = [ids.slice(at, len(group)), pa.ListArray.from_arrays(pa.array(ends), inner), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])
                at += len(group)

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    runs = "array<struct<start: bigint, length: bigint, period: bigint>>"
    return chosen.mapInArrow(run, f"doc_id {kind}, runs {runs}, collapsed string")
