"""A word bigram model in Elias-Fano tries, and the scores of texts under it.

p(w | v) = (c(v, w) + MU * p(w)) / (c(v) + MU),   p(w) = (c(w) + 1) / (N + V + 1).

Texts are cut into chunks of CHUNK tokens. A chunk numbers its distinct words, and only its
distinct words and word pairs travel, packed, to the shard that owns them:

1. words: a shard adds up the chunks' counts and answers every chunk's list with the totals;
2. pairs: a shard adds up the counts, builds its trie and answers every chunk's list
   from it. A context with much of all tokens is spread over several shards by next word;
3. each chunk puts its answers together and adds up its documents.

Chunks are written in buckets, so they stay where they are when answers come back.

The trie of a shard has two levels: the contexts' hashes, and for each context its
successors, made one monotone sequence by the context's rank. Both levels and the
pointers between them are Elias-Fano coded; each successor has its smoothed probability
quantised to one byte. The levels lie in a memory-mapped temporary file of the task. A pair is looked up by a
successor search relative to its context. Words are known by 64-bit hashes, a successor
within its context by NEXT_BITS bits.

Defined results: a null or empty text is one token, the end. Repeated rows count, and are scored, each.
Without training rows N and V are 0. A very long text is spread over several chunks.
"""

from __future__ import annotations

import pickle
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import bucketed, shuffle_partitions
from loanloom.session import materialize

CHUNK = 2_000_000
MU = 200.0
NEXT_BITS = 40  # bits of a successor's hash
LEVELS, DECADES = 255, 10.0  # quantised log10 probabilities from -DECADES to 0
BEGIN, END = b" begin", b" end"  # no word holds a blank

# ------------------------------------------------------------------ Elias-Fano


class EliasFano:
    """A nondecreasing sequence of unsigned integers: low bits packed, high bits unary."""

    def __init__(self, values: np.ndarray):
        values = values.astype(np.uint64)
        self.n = len(values)
        top = int(values[-1]) if self.n else 0
        self.low_bits = min(56, max(0, (top // max(1, self.n)).bit_length() - 1))
        low = values & np.uint64((1 << self.low_bits) - 1)
        shifts = np.arange(self.low_bits, dtype=np.uint64)
        packed = []
        for at in range(0, self.n, 1 << 15):  # whole bytes, as the step is a multiple of 8
            bits = (low[at : at + (1 << 15), None] >> shifts) & np.uint64(1)
            packed.append(np.packbits(bits.astype(np.uint8), bitorder="little"))
        self.low = np.concatenate([*packed, np.zeros(16, np.uint8)])
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        size = self.n + (int(high[-1]) if self.n else 0) + 2
        unary = np.zeros(-(-size // 64) * 64, np.uint8)
        unary[high + np.arange(self.n)] = 1
        self.high = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones = np.concatenate(([0], np.cumsum(ones)))  # ones before each word
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones

    def arrays(self) -> list[str]:
        return ["low", "high", "ones", "zeros"]

    @staticmethod
    def _in_word(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the set bit number ``rank`` (from 0) in each word."""
        place = np.zeros(len(word), np.uint64)
        rank = rank.astype(np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = (word >> place) & np.uint64((1 << width) - 1)
            below = np.bitwise_count(part).astype(np.int64)
            on = rank >= below
            rank = np.where(on, rank - below, rank)
            place = np.where(on, place + np.uint64(width), place)
        return place.astype(np.int64)

    def bucket(self, high: np.ndarray) -> np.ndarray:
        """How many elements have smaller high bits: the place of a zero, less the zeros."""
        wanted = high - 1  # the number of the zero that ends the bucket before
        found = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        total = int(self.zeros[-1])
        past = some[wanted[some] >= total]
        found[past] = self.n
        some = some[wanted[some] < total]
        word = np.searchsorted(self.zeros, wanted[some], "right") - 1
        place = word * 64 + self._in_word(~self.high[word], wanted[some] - self.zeros[word])
        found[some] = np.minimum(place - wanted[some], self.n)
        return found

    def lows(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), np.uint64)
        bit = index * self.low_bits
        view = np.ndarray((len(self.low) - 7,), "<u8", buffer=self.low, strides=(1,))
        word = view[bit >> 3] >> (bit & 7).astype(np.uint64)
        return word & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, index, "right") - 1
        place = word * 64 + self._in_word(self.high[word], index - self.ones[word])
        return ((place - index).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(index)

    def find(self, values: np.ndarray, first=None, last=None) -> np.ndarray:
        """Index of each value, -1 if absent; only inside first..last if given."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        start, end = self.bucket(high), self.bucket(high + 1)
        if first is not None:
            start, end = np.maximum(start, first), np.minimum(end, last)
        a, b = start.copy(), end.copy()
        while (open_ := np.flatnonzero(a < b)).size:  # successor search
            middle = (a[open_] + b[open_]) >> 1
            less = self.lows(middle) < low[open_]
            a[open_[less]], b[open_[~less]] = middle[less] + 1, middle[~less]
        hit = np.flatnonzero(a < end)
        hit = hit[self.lows(a[hit]) == low[hit]]
        found = np.full(len(values), -1, np.int64)
        found[hit] = a[hit]
        return found


class Trie:
    """Contexts, their successors and a byte of probability for each, memory-mapped."""

    def __init__(self, context: np.ndarray, successor: np.ndarray, code: np.ndarray):
        """Sorted by (context, successor), without repetitions."""
        new = np.concatenate(([True], context[1:] != context[:-1])) if len(context) else np.empty(0, bool)
        starts = np.flatnonzero(new)
        rank = np.cumsum(new) - 1
        if len(starts) >= 1 << (64 - NEXT_BITS):
            raise ValueError("too many contexts in one shard: raise spark.sql.shuffle.partitions")
        self.contexts = EliasFano(context[starts])
        self.pointers = EliasFano(np.concatenate((starts, [len(context)])))
        self.successors = EliasFano((rank.astype(np.uint64) << np.uint64(NEXT_BITS)) | successor)
        self.codes = code
        self._map()

    def _map(self) -> None:
        self.file = tempfile.TemporaryFile()  # has no name, so it goes with the task
        owners = [(e, a) for e in (self.contexts, self.pointers, self.successors) for a in e.arrays()]
        owners.append((self, "codes"))
        at = 0
        places = []
        for owner, name in owners:
            data = np.ascontiguousarray(getattr(owner, name))
            at += -at % 64
            self.file.seek(at)
            self.file.write(data.tobytes())
            places.append((owner, name, data.dtype, data.shape, at))
            at += data.nbytes
        self.file.flush()
        for owner, name, kind, shape, where in places:
            if shape[0]:
                setattr(owner, name, np.memmap(self.file, kind, "r", where, shape))

    def lookup(self, context: np.ndarray, runs: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 if absent: ``context`` once for each run of successors."""
        rank = self.contexts.find(context)
        known = rank >= 0
        first, last = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        first[known] = self.pointers[rank[known]].astype(np.int64)
        last[known] = self.pointers[rank[known] + 1].astype(np.int64)
        pairs = np.flatnonzero(np.repeat(known, runs))
        r, f, e = (np.repeat(x, runs)[pairs] for x in (rank, first, last))
        key = (r.astype(np.uint64) << np.uint64(NEXT_BITS)) | successor[pairs]
        at = self.successors.find(key, f, e)
        codes = np.zeros(len(successor), np.uint8)
        hit = at >= 0
        codes[pairs[hit]] = self.codes[at[hit]]
        return codes


def quantised(p: np.ndarray) -> np.ndarray:
    """1..LEVELS for a probability's logarithm."""
    step = DECADES / (LEVELS - 1)
    return np.clip(np.rint((np.log10(p) + DECADES) / step) + 1, 1, LEVELS).astype(np.uint8)


_STEP = DECADES / (LEVELS - 1)
PROBABILITY = np.concatenate(([0.0], 10 ** ((np.arange(LEVELS)) * _STEP - DECADES)))

# --------------------------------------------------------------------- packing


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed."""
    rows = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        planes = planes[: max(1, int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1)]
        rows.append((a.dtype.str, len(a), planes.tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(rows))


def unpack(data: bytes) -> list[np.ndarray]:
    found = []
    for kind, n, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        kind = np.dtype(kind)
        full = np.zeros((kind.itemsize, n), np.uint8)
        if n:
            some = np.frombuffer(planes, np.uint8).reshape(-1, n)
            full[: len(some)] = some
        found.append(np.ascontiguousarray(full.T).reshape(-1).view(kind))
    return found


# ---------------------------------------------------------------------- chunks


def _hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


class _Chunk:
    """Tokens of some documents as numbers of the chunk's distinct words."""

    def __init__(self):
        self.number: defaultdict = defaultdict()
        self.number.default_factory = self.number.__len__
        self.begin, self.end = self.number[BEGIN], self.number[END]
        self.tokens: list[list[int]] = []
        self.rows: list[tuple[int, int, bool, int, bool]] = []  # row, id, has no id, size, training
        self.before: list[int] = []
        self.size = 0

    def add(self, row: int, doc_id, train: bool, words: list[bytes], before: bytes | None, last: bool) -> None:
        ids = list(map(self.number.__getitem__, words))
        if last:
            ids.append(self.end)
        self.before.append(self.begin if before is None else self.number[before])
        self.tokens.append(ids)
        self.rows.append((row, 0 if doc_id is None else int(doc_id), doc_id is None, len(ids), train))
        self.size += len(ids)

    def tables(self, chunk: int, shards: int) -> Iterator[dict]:
        tokens = np.fromiter((t for part in self.tokens for t in part), np.uint32, self.size)
        row, doc, none, size, train = (np.array(c) for c in zip(*self.rows))
        hashes = _hashes(list(self.number))
        counted = np.repeat(train, size)
        counts = np.bincount(tokens[counted], minlength=len(hashes)).astype(np.uint32)
        before = np.array(self.before, np.uint32)
        counts[self.begin] = int((train & (before == self.begin)).sum())
        body = pack(
            row.astype(np.int64), doc.astype(np.int64), none.astype(np.uint8), size.astype(np.int64),
            train.astype(np.uint8), before, tokens, hashes,
        )
        trained = int(counted.sum())
        yield {"chunk": chunk, "shard": -1, "trained": trained, "tokens": body, "words": None}
        order, cuts = by_shard(hashes, shards)
        for s in range(shards):
            part = order[cuts[s] : cuts[s + 1]]
            if len(part):
                words = pack(hashes[part], counts[part])
                yield {"chunk": chunk, "shard": s, "trained": 0, "tokens": None, "words": words}


def by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by (shard, hash), and where each shard begins."""
    shard = ((hashes >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((hashes, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


CHUNKS = "chunk long, shard int, trained long, tokens binary, words binary"


def _cut(shards: int, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        number, row = 0, 0
        chunk = _Chunk()

        def flush():
            nonlocal number, chunk
            for table in chunk.tables((part << 32) + number, shards):
                yield pd.DataFrame([table])
            number, chunk = number + 1, _Chunk()

        for batch in batches:
            ids = [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
            for doc_id, train, text in zip(ids, batch["train"], batch["text"]):
                words = (text or "").encode("utf-8", "surrogatepass").lower().split()
                key, before, at = (part << 40) + row, None, 0
                row += 1
                while True:
                    room = size - chunk.size
                    last = len(words) - at <= room
                    some = words[at : at + room]
                    chunk.add(key, doc_id, bool(train), some, before, last)
                    if chunk.size >= size:
                        yield from flush()
                    if last:
                        break
                    before, at = some[-1] if some else before, at + len(some)
        if chunk.rows:
            yield from flush()

    return run


# ----------------------------------------------------------------------- words


def _count_words(lists: pd.DataFrame) -> pd.DataFrame:
    """A shard's totals, as answers to each chunk; its number of trained words as ``distinct``."""
    parts = [unpack(w) for w in lists["words"]]
    hashes = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts]).astype(np.int64)
    words, place = np.unique(hashes, return_inverse=True)
    totals = np.bincount(place, weights=counts, minlength=len(words)).astype(np.int64)
    begin = _hashes([BEGIN])[0]
    distinct = int(((totals > 0) & (words != begin)).sum())
    ends = np.cumsum([len(p[0]) for p in parts])
    answers = [pack(totals[place[e - len(p[0]) : e]]) for p, e in zip(parts, ends)]
    own = np.zeros(len(parts), np.int64)
    own[0] = distinct
    return pd.DataFrame(
        {"chunk": lists["chunk"], "shard": lists["shard"], "kind": "words", "answer": answers, "distinct": own}
    )


ANSWERS = "chunk long, shard int, kind string, answer binary, distinct long"

# ----------------------------------------------------------------------- pairs


class _Read:
    """A chunk with the totals of its words."""

    def __init__(self, body: bytes, answers: pd.DataFrame, shards: int):
        self.row, self.doc, self.none, self.size, self.train, self.before, self.tokens, self.hashes = unpack(body)
        order, cuts = by_shard(self.hashes, shards)
        self.totals = np.zeros(len(self.hashes), np.int64)
        for shard, answer in zip(answers["shard"], answers["answer"]):
            self.totals[order[cuts[shard] : cuts[shard + 1]]] = unpack(answer)[0]
        starts = np.cumsum(self.size) - self.size
        self.context = np.concatenate(([0], self.tokens[:-1])).astype(np.uint32) if len(self.tokens) else self.tokens
        filled = self.size > 0
        self.context[starts[filled]] = self.before[filled]

    def pairs(self, shards: int, total: int):
        """Distinct pairs by (shard, context, successor): context, next, shard, and each token's pair."""
        key = self.context.astype(np.int64) * len(self.hashes) + self.tokens
        distinct, which = np.unique(key, return_inverse=True)
        context, following = distinct // len(self.hashes), distinct % len(self.hashes)
        near = self.hashes[following] >> np.uint64(64 - NEXT_BITS)
        own = self.hashes[context]
        # a context with more than a quarter of a shard's share is dealt out by next word
        pieces = (self.totals[context] * 4 * shards // max(total, 1) + 1).astype(np.uint64)
        spread = near % np.minimum(pieces, np.uint64(shards))
        shard = (((own >> np.uint64(20)) + spread) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((near, own, shard))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return context[order], near[order], shard[order], place[which]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start, and how long they are."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(values)])))


def _list_pairs(shards: int, total: int):
    def run(bodies: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for chunk, body in zip(bodies["chunk"], bodies["tokens"]):
            read = _Read(body, answers, shards)
            context, near, shard, place = read.pairs(shards, total)
            trained = np.repeat(read.train, read.size).astype(bool)
            counts = np.bincount(place[trained], minlength=len(near)).astype(np.uint32)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            for s in range(shards):
                a, b = cuts[s], cuts[s + 1]
                if a == b:
                    continue
                starts, runs = _runs(context[a:b])
                words = context[a:b][starts]
                data = pack(
                    read.hashes[words], runs.astype(np.uint32), read.totals[words], near[a:b], counts[a:b]
                )
                rows.append((chunk, s, data))
        return pd.DataFrame(rows, columns=["chunk", "shard", "pairs"])

    return run


def _answer_pairs(lists: pd.DataFrame) -> pd.DataFrame:
    """Build a shard's trie from the lists of all chunks and look each list up in it."""
    parts = [unpack(p) for p in lists["pairs"]]
    context = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
    total = np.concatenate([np.repeat(p[2], p[1]) for p in parts])
    near = np.concatenate([p[3] for p in parts])
    counts = np.concatenate([p[4] for p in parts]).astype(np.int64)
    some = np.flatnonzero(counts)
    order = some[np.lexsort((near[some], context[some]))]
    c, n = context[order], near[order]
    new = np.concatenate(([True], (c[1:] != c[:-1]) | (n[1:] != n[:-1]))) if len(order) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(counts[order], starts) if len(starts) else np.empty(0, np.int64)
    p = sums / (total[order][starts] + MU)
    trie = Trie(c[starts], n[starts], quantised(p))
    answers = [pack(trie.lookup(p[0], p[1].astype(np.int64), p[3])) for p in parts]
    return pd.DataFrame(
        {"chunk": lists["chunk"], "shard": lists["shard"], "kind": "pairs", "answer": answers, "distinct": 0}
    )


# ---------------------------------------------------------------------- scores


def _score(shards: int, total: int, distinct: int):
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

    def run(bodies: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        tables = []
        for body in bodies["tokens"]:
            read = _Read(body, answers[answers["kind"] == "words"], shards)
            _, near, shard, place = read.pairs(shards, total)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            codes = np.zeros(len(near), np.uint8)
            for _, answer in answers[answers["kind"] == "pairs"].iterrows():
                codes[cuts[answer["shard"]] : cuts[answer["shard"] + 1]] = unpack(answer["answer"])[0]
            count = read.totals[read.tokens]
            alone = (count + 1) / (total + distinct + 1)
            kept = MU / (read.totals[read.context] + MU)
            p = PROBABILITY[codes[place]] + kept * alone
            owner = np.repeat(np.arange(len(read.size)), read.size)
            add = lambda x: np.bincount(owner, weights=x, minlength=len(read.size))
            tables.append(
                pd.DataFrame(
                    {
                        "row": read.row,
                        "doc_id": pd.array(np.where(read.none == 1, None, read.doc), "Int64"),
                        "held_out": read.train == 0,
                        "n_tokens": read.size,
                        "n_known": add(count > 0).astype(np.int64),
                        "base_score": add(np.log10(alone)),
                        "score": add(np.log10(p)),
                    }
                )
            )
        return pd.concat(tables) if tables else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return run, schema


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Learns from the rows where ``held_out`` is false. ``doc_id`` is an integer column.
    """
    shards = shuffle_partitions(docs.sparkSession)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (~held_out).alias("train"), F.col(text).cast("string").alias("text")
    )
    chunks = bucketed(rows.mapInPandas(_cut(shards, chunk), CHUNKS), "lm_chunks", "chunk")
    bodies = chunks.where("shard = -1").select("chunk", "tokens").groupBy("chunk")
    lists = chunks.where("shard >= 0").select("chunk", "shard", "words")
    words = materialize(lists.groupBy("shard").applyInPandas(_count_words, ANSWERS), "lm-words")
    total = chunks.agg(F.sum("trained")).first()[0] or 0
    distinct = words.agg(F.sum("distinct")).first()[0] or 0
    pairs = bodies.cogroup(words.groupBy("chunk")).applyInPandas(
        _list_pairs(shards, total), "chunk long, shard int, pairs binary"
    )
    answers = materialize(pairs.groupBy("shard").applyInPandas(_answer_pairs, ANSWERS), "lm-pairs")
    run, schema = _score(shards, total, distinct)
    parts = bodies.cogroup(words.unionAll(answers).groupBy("chunk")).applyInPandas(run, schema)
    # a document is one row, or as many as the chunks it is spread over
    return parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")
