"""Near-duplicates by SimHash fingerprints and tables of pivot distances.

A fingerprint's bits are the majority of its shingles' hash bits. Equal
fingerprints are one class, found by an aggregation, so copies never meet.

Classes within ``max_bits`` are found with reference fingerprints (pivots).
The 64 positions are cut into ``max_bits + 1`` blocks, and what lies outside a
block again into so many: two fingerprints within ``max_bits`` are equal in some
block and, outside it, in some part. Restricted to that region, their
distances to every pivot are then the same. So the table of distances of each
region to all pivots is the key of a cell; pairs are looked for only inside cells.
There a pair is discarded when its distances to some pivot over all 64 positions
differ by more than ``max_bits`` (triangle inequality); survivors are verified
bit by bit. A cell gives a spanning forest of its links, never all pairs.

A cell with more than CELL members is dealt out again, as pairs of tiles to
separate tasks, and compared whole.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; a null identifier is larger than any other; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import fresh, shuffle_partitions
from loanloom.llm.components import components
from loanloom.session import materialize

PIVOTS = 16
CELL = 2048
BATCH = 200_000
BLOCK = 100_000  # shingles hashed at a time


def pivot_fingerprints(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(str(i), seed=7) for i in range(count)], dtype=np.uint64)


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    spans = list(zip(starts[: len(last)].tolist(), last.tolist()))
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), BLOCK):
        part = spans[at : at + BLOCK]
        hashes = np.array([digest(joined[a:b], seed) for a, b in part], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    majority = (2 * set_bits > len(spans)).astype(np.uint8)
    return int(np.packbits(majority, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, row: str | None = None
) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row per row of ``docs``; the column ``row`` is kept as row."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64)
        return pd.Series(found.view(np.int64))

    also = [] if row is None else [F.col(row).alias("row")]
    return docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text).cast("string")).alias("fp"), *also)


# ----------------------------------------------------------------------- links


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _split(positions: list[int], parts: int) -> list[list[int]]:
    return [p.tolist() for p in np.array_split(np.array(positions), parts)]


def regions(max_bits: int) -> list[int]:
    """Masks such that fingerprints within ``max_bits`` agree on one of them."""
    masks = []
    for block in _split(list(range(64)), max_bits + 1):
        rest = [p for p in range(64) if p not in block]
        for part in _split(rest, max_bits + 1):
            masks.append(sum(1 << p for p in [*block, *part]))
    return masks


def cell_keys(fp: Column, max_bits: int) -> Column:
    """Array with one cell per region: a hash of the region's distances to all pivots."""
    pivots = pivot_fingerprints().tolist()
    cells = []
    for number, mask in enumerate(regions(max_bits)):
        inside = F.lit(_signed(mask))
        distances = [
            F.bit_count(fp.bitwiseXOR(F.lit(_signed(p))).bitwiseAND(inside)).cast("byte") for p in pivots
        ]
        cells.append(F.xxhash64(F.lit(number), *distances))
    return F.array(*cells)


def _linked(fp: np.ndarray, cell: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of neighbours in equal cells; rows are sorted by cell."""
    edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
    sizes = np.diff(edge)
    left = np.repeat(edge[1:], sizes) - np.arange(len(cell)) - 1  # rows of the cell that follow
    table = np.bitwise_count(fp[:, None] ^ pivot_fingerprints()[None, :]).astype(np.int8)
    first, second = [], []
    for step in range(1, int(sizes.max(initial=0))):
        a = np.flatnonzero(left >= step)
        b = a + step
        for p in range(table.shape[1]):  # maximum coordinate difference
            near = np.abs(table[a, p] - table[b, p]) <= max_bits
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        first.append(a[near])
        second.append(b[near])
    if not first:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(first), np.concatenate(second)


def _forest(a: np.ndarray, b: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    """Links of ``fp[a]`` and ``fp[b]`` as one link per fingerprint to its group's smallest."""
    nodes, ends = np.unique(np.concatenate((fp[a], fp[b])), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    inner = root != np.arange(len(nodes))
    signed = nodes.view(np.int64)
    return pd.DataFrame({"u": signed[inner], "v": signed[root[inner]], "cell": pd.array([None] * inner.sum(), "Int64")})


def _search(max_bits: int, most: int | None):
    """Worker: rows (cell, fp) sorted by cell -> links, or whole cells that are too large."""

    def links(cell, fp):
        size = np.unique(cell, return_counts=True)[1]
        many = np.repeat(size > 1, size)
        a, b = _linked(fp[many], cell[many], max_bits)
        return _forest(a, b, fp[many])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_cell = None  # a cell that is being handed on unsearched
        cell, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def hand_on(c, f):
            return pd.DataFrame({"u": f.view(np.int64), "v": f.view(np.int64), "cell": pd.array(c, "Int64")})

        for batch in batches:
            c, f = batch["cell"].to_numpy(), batch["fp"].to_numpy().view(np.uint64)
            if open_cell is not None:
                same = int(np.searchsorted(c != open_cell, True))  # they come first
                if same:
                    yield hand_on(c[:same], f[:same])
                c, f = c[same:], f[same:]
                if not len(c):
                    continue
                open_cell = None
            cell, fp = np.concatenate((cell, c)), np.concatenate((fp, f))
            if len(cell) < BATCH:
                continue
            # the last cell may go on in the next batch
            tail = len(cell) - int(np.argmax(cell[::-1] != cell[-1])) if cell[0] != cell[-1] else 0
            yield from _ready(cell[:tail], fp[:tail], hand_on)
            cell, fp = cell[tail:], fp[tail:]
            if most is not None and len(cell) > most:
                yield hand_on(cell, fp)
                open_cell = cell[0]
                cell, fp = cell[:0], fp[:0]
        yield from _ready(cell, fp, hand_on)

    def _ready(cell, fp, hand_on):
        if not len(cell):
            return
        edge = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1], [True])))
        size = np.repeat(np.diff(edge), np.diff(edge))
        large = np.zeros(len(cell), bool) if most is None else size > most
        if large.any():
            yield hand_on(cell[large], fp[large])
        keep = ~large & (size > 1)
        if keep.any():
            yield links(cell[keep], fp[keep])

    return run


def near_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints ``fp`` within ``max_bits``."""
    spark = fps.sparkSession
    parts = shuffle_partitions(spark)
    schema = "u long, v long, cell long"
    cells = fps.select("fp", F.explode(cell_keys(F.col("fp"), max_bits)).alias("cell"))
    dealt = cells.repartition(parts, "cell").sortWithinPartitions("cell").select("cell", "fp")
    found = materialize(dealt.mapInPandas(_search(max_bits, CELL), schema), "near-links")
    links = found.where("cell is null").select("u", "v")

    large = found.where("cell is not null").select("cell", F.col("u").alias("fp"))
    sizes = large.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("tiles"))
    tiled = large.join(sizes, "cell").withColumn(
        "tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    )
    # a tile meets every other one once; a tile pair holds about 2 CELL rows
    other = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("tile"))
    pairs = tiled.withColumn("other", F.explode(other)).select(
        F.xxhash64("cell", F.least("tile", "other"), F.greatest("tile", "other")).alias("cell"), "fp"
    )
    again = pairs.repartition(parts, "cell").sortWithinPartitions("cell").select("cell", "fp")
    return links.unionAll(again.mapInPandas(_search(max_bits, None), schema).select("u", "v"))


# ------------------------------------------------------------------- operators


def _rooted(rows: DataFrame, least: Column, max_bits: int) -> DataFrame:
    """Every distinct ``fp`` of ``rows`` with its smallest ``least`` and the root of its component."""
    classes = materialize(rows.groupBy("fp").agg(F.min(least).alias("least")), "fingerprint-classes")
    stars = materialize(components(near_links(classes.select("fp"), max_bits)), "fingerprint-stars")
    # every class with its root; roots without links are their own
    return classes.join(stars, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 3,
    max_bits: int = 3,
    seed: int = 42,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    rows = materialize(fingerprints(docs, doc_id, text, width, seed), "fingerprints")
    rooted = _rooted(rows, F.col("doc_id"), max_bits)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3
) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each component.

    It is the one with the smallest identifier; where that is repeated, or no
    row has one, the first of these rows in the order of the table's parts.
    """
    (own,) = fresh(docs, "row_number")
    numbered = materialize(docs.withColumn(own, F.monotonically_increasing_id()), "numbered-rows")
    rows = materialize(fingerprints(numbered, doc_id, text, width, row=own), "fingerprints")
    me = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row")
    least = _rooted(rows, me, max_bits).groupBy("root").agg(F.min("least").alias("least"))
    kept = numbered.join(least.select(F.col("least.row").alias(own)), own, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
