"""Token ids in binary shards, with keyed access through a minimal perfect hash.

A shard is two files. NAME.ids holds the ids of its documents one after another, two or
four bytes each, nothing else. NAME.idx finds a document by its key: a minimal
perfect hash sends each of the shard's k distinct keys to a slot of its own from 0 to k - 1; the
slot holds a fingerprint of the key, which refuses nearly all keys the shard does not have, and the key's
place in key order, which gives the key itself (compared at last) and its documents' offsets. A
lookup reads a constant number of words, however many keys there are.

The perfect hash is a cascade of bit arrays: keys that meet no other at their position
of a level are done there, the others go on to the next, smaller level. A key's slot is the number of set
bits before its own.

Documents are put in key order by one exchange of their ids over ranges of keys, chosen beforehand from the keys
alone; rows of one key are split by a hash of the text and by a row number, so a key with a third of all
rows, or a row with as many copies, spreads over shards like any others. Tasks write files
under names of their own attempt and return the names; only what the committed manifest
lists counts, so a lost or repeated task leaves nothing behind that is read.

Defined results: a null text is empty; an empty text is only the end id. Null keys come first and
are a key like any other; rows with one key follow each other in the order of a hash of the text, and equal rows are stored each.
An empty table gives no files and no rows. Only the key and the text are read, so other
columns may have any names. A text of any length is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm.common import shuffle_partitions
from loanloom.operators.ordered import count_below
from loanloom.session import materialize

# -------------------------------------------------------------------- encoding

CACHED = 500_000  # pieces a worker remembers before it starts anew
TOGETHER = 1 << 20  # characters encoded in one go
ONE_INPUT = 1000  # pieces handed to the library as the words of one input
# fixed values: the code points with Unicode's White_Space property
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(points: list[int]) -> str:
    """A character class body of ascending code points."""
    edges = np.flatnonzero(np.diff(points, prepend=-2) != 1).tolist()
    return "".join(f"\\u{points[a]:04x}-\\u{points[b - 1]:04x}" for a, b in zip(edges, [*edges[1:], len(points)]))


@lru_cache(maxsize=None)
def _pieces() -> re.Pattern:
    """How the byte-level tokenizers cut a text of the basic plane into pieces."""
    kinds = [unicodedata.category(chr(p))[0] for p in range(1 << 16)]
    letters, numbers = (_ranges([p for p, k in enumerate(kinds) if k == kind]) for kind in "LN")
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+"
        rf"|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


@lru_cache(maxsize=None)
def _other() -> re.Pattern:
    """Code points above the basic plane, or unknown to Python's tables: libraries may class them differently."""
    unknown = [p for p in range(1 << 16) if unicodedata.category(chr(p)) in ("Cn", "Cs")]
    return re.compile(f"[{_ranges(unknown)}\\U00010000-\\U0010ffff]")


class _Numbers(dict):
    """Numbers of pieces in the order of their first use; new ones are listed."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.fresh.append(piece)
        return number


class Encoder:
    """Ids of texts by the tokenizer library, which sees each distinct piece once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark uses the cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.by_piece = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for one in (self.library, self.by_piece):
            one.encode_special_tokens = True  # their strings in a text are ordinary text
        # a piece is not cut again
        self.by_piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # bytes of each id, where ids spell all bytes of a text
        vocab, self.spelled = self.library.get_vocab(), None
        if self.library.normalizer is None and vocab.keys() >= set(pre_tokenizers.ByteLevel.alphabet()):
            self.spelled = np.zeros(max(vocab.values()) + 1, np.int64)
            self.spelled[list(vocab.values())] = [len(token) for token in vocab]
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.flat, self.start, self.size = (np.empty(0, np.int64) for _ in range(3))

    def _learn(self) -> None:
        flat, sizes = self._apart(self.number.fresh) if self.spelled is None else self._as_words(self.number.fresh)
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, flat))
        self.number.fresh.clear()

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        ids = [e.ids for e in self.by_piece.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for one in ids for i in one], np.int64), np.fromiter(map(len, ids), np.int64, len(ids))

    def _as_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, many pieces to an input; a piece ends where its bytes are spelled."""
        inputs = [pieces[k : k + ONE_INPUT] for k in range(0, len(pieces), ONE_INPUT)]
        found = self.by_piece.encode_batch_fast(inputs, is_pretokenized=True, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.int64) for e in found])
        n_bytes = np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in pieces), np.int64, len(pieces))
        ends = np.searchsorted(np.cumsum(self.spelled[flat]), np.cumsum(n_bytes)) + 1
        return flat, np.diff(ends, prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > CACHED:
            self._forget()
        numbers = []
        for text in texts:
            if text.isascii() or not _other().search(text):
                pieces = _pieces().findall(text)
                numbers.append(np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces)))
            else:
                numbers.append(None)
        if self.number.fresh:
            self._learn()
        return [
            self._joined(n) if n is not None else self._whole(text) for n, text in zip(numbers, texts)
        ]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)

    def _joined(self, numbers: np.ndarray) -> np.ndarray:
        n = self.size[numbers]
        return self.flat[np.repeat(self.start[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def id_bytes(path: str, end_id: int) -> int:
    """Two bytes an id where the vocabulary allows it, else four."""
    return 2 if max(encoder(path).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def _payload(path: str, end_id: int, width: int):
    """UDF: the ids of a text and the end id, as little-endian integers of ``width`` bytes."""
    kind = f"<u{width}"

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        own, group, size, found = encoder(path), [], 0, []

        def flush():
            found.extend(np.append(ids, end_id).astype(kind).tobytes() for ids in own.encode(group))
            group.clear()

        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= TOGETHER:
                flush()
                size = 0
        flush()
        return pd.Series(found, dtype=object)

    return run


# ---------------------------------------------------------------- perfect hash

LEVELS = 40
ROOM = 2  # positions of a level per key


def _place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each key in a level of ``size`` < 2 ** 32 positions."""
    z = first + np.uint64(2 * level + 1) * second
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Slots 0 to k - 1 for k keys, each given by two 64-bit hashes (distinct pairs)."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.placed = int(counts.sum())
        self.left = {(int(a), int(b)): self.placed + i for i, (a, b) in enumerate(rest)}

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while len(first) and len(sizes) < LEVELS:
            size = -(-ROOM * len(first) // 64) * 64
            at = _place(first, second, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            met = ~alone[at]
            first, second = first[met], second[met]
        bits = np.concatenate(words) if words else np.empty(0, np.uint64)
        return cls(np.array(sizes, np.int64), bits, np.stack((first, second), axis=1))

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Each key's slot; other keys get any slot or -1."""
        found, open_, base = np.full(len(first), -1), np.arange(len(first)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = base + _place(first[open_], second[open_], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            found[open_[hit]] = (self.before[at >> 6] + np.bitwise_count(lower))[hit]
            open_, base = open_[~hit], base + size
        if self.left:
            for k in open_.tolist():
                found[k] = self.left.get((int(first[k]), int(second[k])), -1)
        return found


def _fingerprint(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """32 bits that no level's position is made of."""
    return ((first * np.uint64(0x9E3779B97F4A7C15) ^ second) >> np.uint64(32)).astype("<u4")


def _marked(key: Column) -> Column:
    """A key as text; a null one differs from all others."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def _hashes(marked: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    first = np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in marked), np.uint64, len(marked))
    return first, np.fromiter((xxhash.xxh64_intdigest(k, 43) for k in marked), np.uint64, len(marked))


# ----------------------------------------------------------------------- files

MAGIC = b"TOKIDX01"
PART = 8 << 20  # bytes of ids read at a time


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder as a file system of the tasks: local or mounted, hdfs, s3, gs."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _index_bytes(width: int, keys: list[bytes], first_doc: list[int], starts: np.ndarray) -> bytes:
    """The index file: header, then arrays of little-endian integers."""
    first, second = _hashes(keys)
    hash_ = PerfectHash.of(first, second)
    slot = hash_.slots(first, second)
    fingerprint, entry = np.empty(len(keys), "<u4"), np.empty(len(keys), "<u4")
    fingerprint[slot], entry[slot] = _fingerprint(first, second), np.arange(len(keys))
    ends = np.cumsum([0, *map(len, keys)])
    parts = [
        hash_.sizes.astype("<i8"), hash_.words.astype("<u8"), hash_.rest.astype("<u8"), fingerprint, entry,
        np.array([*first_doc, len(starts) - 1], "<i8"), starts.astype("<i8"), ends.astype("<i8"),
    ]
    counts = (width, len(keys), len(starts) - 1, len(hash_.sizes), len(hash_.words), len(hash_.rest))
    return b"".join([MAGIC, struct.pack("<6q", *counts), *(p.tobytes() for p in parts), *keys])


class Shard:
    """One shard's index, and its ids read by parts."""

    def __init__(self, path: str):
        self.system, self.path = _folder(path)
        with self.system.open_input_file(f"{self.path}.idx") as file:
            raw = file.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"not an index of token ids: {path}.idx")
        self.width, n_keys, n_docs, n_levels, n_words, n_rest = struct.unpack_from("<6q", raw, 8)
        at = 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(raw, kind, count, at)
            at += found.nbytes
            return found

        sizes, words = take("<i8", n_levels), take("<u8", n_words)
        self.hash = PerfectHash(sizes, words, take("<u8", 2 * n_rest).reshape(-1, 2))
        self.fingerprint, self.entry = take("<u4", n_keys), take("<u4", n_keys)
        self.first_doc, self.starts, ends = take("<i8", n_keys + 1), take("<i8", n_docs + 1), take("<i8", n_keys + 1)
        text = raw[at:]
        self.keys = [text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def find(self, marked: list[bytes]) -> np.ndarray:
        """Place in key order of each key, -1 for keys the shard does not have."""
        first, second = _hashes(marked)
        slot = self.hash.slots(first, second)
        there = slot >= 0
        there[there] = self.fingerprint[slot[there]] == _fingerprint(first, second)[there]
        found = np.full(len(marked), -1)
        found[there] = self.entry[slot[there]]
        return np.array([e if e >= 0 and self.keys[e] == k else -1 for e, k in zip(found.tolist(), marked)], np.int64)

    def documents(self, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """(which of the entries, documents, their ids as unsigned 32-bit integers), by parts."""
        n = self.first_doc[entries + 1] - self.first_doc[entries]
        which = np.repeat(np.arange(len(entries)), n)
        docs = np.repeat(self.first_doc[entries] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        size = (self.starts[docs + 1] - self.starts[docs]) * self.width
        part = (np.cumsum(size) - 1) // PART
        with self.system.open_input_file(f"{self.path}.ids") as file:
            for k in np.unique(part):
                own = np.flatnonzero(part == k)
                yield which[own], docs[own], list(self._read(file, docs[own]))

    def _read(self, file, docs: np.ndarray) -> Iterator[bytes]:
        edges = np.flatnonzero(np.diff(docs, prepend=-2) != 1)  # neighbours are read together
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(docs)]):
            bounds = self.starts[docs[a] : docs[b - 1] + 2]
            file.seek(int(bounds[0]) * self.width)
            ids = np.frombuffer(file.read(int(bounds[-1] - bounds[0]) * self.width), f"<u{self.width}").astype("<u4")
            for c, d in zip((bounds[:-1] - bounds[0]).tolist(), (bounds[1:] - bounds[0]).tolist()):
                yield ids[c:d].tobytes()


MANIFEST = "name string, documents long, ids long, first_key binary, last_key binary"


def _writer(folder: str, width: int):
    """Task: sorted rows (marked, ids) into one shard; gives its row of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _folder(folder)
        name = f"shard-{uuid.uuid4().hex}"
        keys, first_doc, sizes, out = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}.ids")
            done = sum(map(len, sizes))
            for k, key in enumerate(batch.column("marked").to_pylist()):
                if not keys or keys[-1] != key:
                    keys.append(key)
                    first_doc.append(done + k)
            ids = batch.column("ids")
            sizes.append(np.diff(np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]) // width)
            for value in ids:
                out.write(value.as_buffer())
        if out is None:
            return
        out.close()
        starts = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        with system.open_output_stream(f"{path}/{name}.idx") as file:
            file.write(_index_bytes(width, keys, first_doc, starts))
        row = {
            "name": [name], "documents": [len(starts) - 1], "ids": [int(starts[-1])],
            "first_key": [keys[0]], "last_key": [keys[-1]],
        }
        yield pa.RecordBatch.from_pydict(row, _ARROW_MANIFEST)

    return run


_ARROW_MANIFEST = pa.schema(
    [("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())]
)


@dataclass
class TokenFiles:
    """Written shards in key order: (path, ids before, documents, first and last key)."""

    spark: SparkSession
    key_type: str
    shards: list[tuple[str, int, int, str | None, str | None]]

    def _at(self) -> DataFrame:
        """One row per shard, each in a partition of its own."""
        rows = [(i, s[0], s[1]) for i, s in enumerate(self.shards)]
        found = self.spark.createDataFrame(rows, "shard int, path string, base long")
        return found.coalesce(1).repartition(max(1, len(rows)))

    def read(self) -> DataFrame:
        """All documents by way of their keys: key, start, n_tokens, ids (little-endian, 32 bits)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                    shard = Shard(path)
                    yield from _rows(shard, base, shard.keys, shard.find(shard.keys))

        return self._typed(self._at().select("path", "base").mapInArrow(run, _OUT))

    def lookup(self, keys: DataFrame, key: str) -> DataFrame:
        """The documents of the keys in a column: key, start, n_tokens, ids; absent keys give no row.

        A key goes to the shards whose range holds it, mostly one.
        """
        bounds = [(s[3], s[4]) for s in self.shards]
        rows = [([a for a, _ in bounds], [b for _, b in bounds])]
        # two keys a shard; null keys come first, so no bound behind one is null
        known = self.spark.createDataFrame(rows, "firsts array<string>, lasts array<string>")
        nulls_first, nulls_last = (sum(b[i] is None for b in bounds) for i in (0, 1))
        arrays = [
            F.slice(F.col(c).cast(f"array<{self.key_type}>"), n + 1, max(1, len(bounds))).alias(c)
            for c, n in (("firsts", nulls_first), ("lasts", nulls_last))
        ]
        wanted = keys.select(F.col(key).cast(self.key_type).alias("key")).distinct()
        wanted = wanted.withColumn("b", known.select(F.struct(*arrays)).scalar())
        low = F.when(F.col("key").isNull(), 0).otherwise(
            nulls_last + count_below(F.col("key"), F.col("b.lasts"), len(bounds))
        )
        high = nulls_first + F.when(F.col("key").isNull(), 0).otherwise(
            count_below(F.col("key"), F.col("b.firsts"), len(bounds), inclusive=True)
        )
        routed = wanted.withColumns({"low": low, "high": high}).where("low < high")
        routed = routed.select(_marked(F.col("key")).cast("binary").alias("marked"), F.explode(F.sequence("low", F.col("high") - 1)).alias("shard"))
        paths = [(s[0], s[1]) for s in self.shards]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, shard = None, None
            for batch in batches:
                numbers = batch.column("shard").to_numpy()
                marked = batch.column("marked").to_pylist()
                for number in np.unique(numbers).tolist():
                    if number != at:
                        at, shard = number, Shard(paths[number][0])
                    asked = [m for m, n in zip(marked, numbers.tolist()) if n == number]
                    yield from _rows(shard, paths[number][1], asked, shard.find(asked))

        parts = routed.repartition(shuffle_partitions(self.spark), "shard").sortWithinPartitions("shard")
        return self._typed(parts.mapInArrow(run, _OUT))

    def _typed(self, rows: DataFrame) -> DataFrame:
        text = F.col("marked").cast("string")
        key = F.when(text != "", F.substring(text, 2, 1 << 30)).cast(self.key_type)
        return rows.select(key.alias("key"), "start", "n_tokens", "ids")


_OUT = "marked binary, start long, n_tokens long, ids binary"


def _rows(shard: Shard, base: int, marked: list[bytes], entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    there = np.flatnonzero(entries >= 0)
    for which, docs, ids in shard.documents(entries[there]):
        starts, ends = shard.starts[docs], shard.starts[docs + 1]
        found = [marked[there[w]] for w in which.tolist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.binary()), pa.array(base + starts), pa.array(ends - starts), pa.array(ids, pa.binary())],
            names=["marked", "start", "n_tokens", "ids"],
        )


def _cuts(keyed: DataFrame, parts: int) -> Column:
    """The smallest (key, tie, row) of each of ``parts`` ranges of about as many rows; no text is moved."""
    order = ["key", "tie", "row"]
    ranges = keyed.select(*order).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    lowest = ranges.groupBy("part").agg(F.min(F.struct(*order)).alias("low"))
    # one row per range
    return lowest.agg(F.sort_array(F.collect_list("low")).alias("lows")).scalar()


def write(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> TokenFiles:
    """Encode every text, append ``end_id``, and write shards in ascending key order.

    ``docs`` should be a stored table: its keys are read once more before, to choose the shards' ranges.
    """
    spark, width = docs.sparkSession, id_bytes(tokenizer, end_id)
    key_type = docs.schema[doc_id].dataType.simpleString()
    parts, words = shuffle_partitions(spark), F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(doc_id).alias("key"),
        F.xxhash64(words).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
        words.alias("words"),
    )
    encoded = keyed.select("key", "tie", "row", _payload(tokenizer, end_id, width)("words").alias("ids"))
    here = F.struct("key", "tie", "row")
    dealt = encoded.withColumn("lows", _cuts(keyed, parts))
    shard = F.greatest(count_below(here, F.col("lows"), parts, inclusive=True) - 1, F.lit(0))
    ordered = dealt.withColumn("shard", shard).drop("lows").repartitionById(parts, "shard").sortWithinPartitions("key", "tie", "row")
    rows = ordered.select(_marked(F.col("key")).cast("binary").alias("marked"), "ids").mapInArrow(_writer(folder, width), MANIFEST)
    numbered = rows.withColumn("part", F.spark_partition_id())
    manifest = materialize(numbered, "token-manifest").orderBy("part").collect()  # one row per shard
    shards, base = [], 0
    for r in manifest:
        first, last = (None if k == b"" else bytes(k[1:]).decode() for k in (r["first_key"], r["last_key"]))
        shards.append((f"{folder}/{r['name']}", base, r["documents"], first, last))
        base += r["ids"]
    return TokenFiles(spark, key_type, shards)
