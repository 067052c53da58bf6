"""Byte-level BPE: pieces by array scans, merges by rank, ids back to bytes.

Pieces. The pattern of the rank files is a finite automaton over character
classes when a symbol also tells what the next characters are. A text becomes
an array of symbols; the automaton's transition functions are composed in many
lanes at once (composition is associative): every lane first runs from all
states until they agree, then the lanes are chained, then each lane runs once
more from its true state. Where a transition opens a piece there is a boundary.
No regular expression is used.

Merges. A piece that is a token is that token; any other starts as single
bytes, and the leftmost pair with the lowest rank is merged until none is
left, for all new pieces of a batch at once. Pieces are cached.

Defined results: a null text is empty; an empty text has no tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm import codepoints

# ---------------------------------------------------------------------- pieces

# states: nothing open, in letters, numbers, others, spaces, a space that belongs to
# what follows, a contraction that lacks one or two letters
CLOSED, LETTERS, NUMBERS, OTHERS, SPACES, JOINED, LACKS_ONE, LACKS_TWO = range(8)
# symbols: letter, number, other, apostrophe of a short or long contraction, white
# space before white space or the end, a blank or other white space before something else
LET, NUM, OTH, SHORT, LONG, WIDE, BLANK, GAP = range(8)
STATES = 8
BLOCK = 1 << 20  # code points per scan
LANES = 2048


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "opens a piece", by symbol * STATES + state."""
    after = np.zeros((8, STATES), np.uint8)
    opens = np.ones((8, STATES), bool)
    for symbol, state in ((LET, LETTERS), (NUM, NUMBERS), (OTH, OTHERS), (SHORT, LACKS_ONE), (LONG, LACKS_TWO)):
        after[symbol] = state
    for symbol, state in ((LET, LETTERS), (NUM, NUMBERS), (OTH, OTHERS), (SHORT, OTHERS), (LONG, OTHERS)):
        for open_state in (state, JOINED):
            after[symbol, open_state], opens[symbol, open_state] = state, False
    after[LET, LACKS_ONE], opens[LET, LACKS_ONE] = CLOSED, False
    after[LET, LACKS_TWO], opens[LET, LACKS_TWO] = LACKS_ONE, False
    after[WIDE], opens[WIDE, SPACES] = SPACES, False
    after[BLANK], after[GAP] = JOINED, CLOSED
    return after.ravel(), opens.ravel()


AFTER, OPENS = _automaton()


def symbols(points: np.ndarray) -> np.ndarray:
    """One symbol per code point; the array's end counts as the text's end."""
    kind = codepoints.classes()[points]
    found = np.array([OTH, LET, NUM, GAP], np.uint8)[kind]
    space = kind == codepoints.SPACE
    next_space = np.concatenate((space[1:], [True]))
    found[space & next_space] = WIDE
    found[(points == 32) & ~next_space] = BLANK
    quote = np.flatnonzero(points == 39)
    if len(quote):
        padded = np.concatenate((points, [0, 0]))
        one, two = padded[quote + 1], padded[quote + 2]
        is_short = np.isin(one, [ord(c) for c in "stmd"])
        is_long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        is_long |= (one == ord("l")) & (two == ord("l"))
        found[quote[is_short]] = SHORT
        found[quote[is_long]] = LONG
    return found


def scan(sym: np.ndarray) -> np.ndarray:
    """Whether each symbol opens a piece, starting with nothing open."""
    n = len(sym)
    steps = max(1, -(-n // LANES))
    lanes = -(-n // steps)
    padded = np.full(lanes * steps, GAP, np.uint8)
    padded[:n] = sym
    by_step = np.ascontiguousarray(padded.reshape(lanes, steps).T).astype(np.intp) * STATES
    # each lane's transition function: images of all states, one once they agree
    image = np.broadcast_to(np.arange(STATES, dtype=np.intp), (lanes, STATES))
    at = 0
    while at < steps and not (at % 8 == 0 and (image == image[:, :1]).all()):
        image = AFTER[by_step[at][:, None] + image].astype(np.intp)
        at += 1
    one = image[:, 0] if at < steps else None
    while at < steps:
        one = AFTER[by_step[at] + one].astype(np.intp)
        at += 1
    start, state = np.empty(lanes, np.intp), CLOSED
    for lane in range(lanes):  # chain the lanes
        start[lane] = state
        state = int(image[lane, state] if one is None else one[lane])
    opens = np.empty((steps, lanes), bool)
    for k in range(steps):
        index = by_step[k] + start
        opens[k] = OPENS[index]
        start = AFTER[index].astype(np.intp)
    return opens.T.ravel()[:n]


def boundaries(points: np.ndarray) -> np.ndarray:
    """Where pieces start, in code points. Long texts go block by block."""
    found, at, size = [], 0, BLOCK
    while at < len(points):
        # two more code points decide the last symbols
        sym = symbols(points[at : at + size + 3])[:size]
        opens = np.flatnonzero(scan(sym))
        if at + size >= len(points):
            found.append(opens + at)
            break
        if len(opens) == 1:  # one piece fills the block
            size *= 2
            continue
        # a piece opens the same way whatever came before it, so start anew there
        found.append(opens[:-1] + at)
        at, size = at + int(opens[-1]), BLOCK
    return np.concatenate(found) if found else np.empty(0, np.int64)


# ---------------------------------------------------------------------- merges

CACHED = 250_000  # pieces a worker remembers before it starts anew
LONG_PIECE = 512
NONE = np.int64(1) << 40


class Vocabulary:
    """Ranks of a tiktoken file, and for each pair of tokens the token it makes."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            rows = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        size = max(self.token) + 1
        lengths = np.zeros(size, np.int64)
        for rank, token in self.token.items():
            lengths[rank] = len(token)
        self.length = lengths
        self.start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(self.token.get(r, b"") for r in range(size)), np.uint8)
        pairs = {}
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self._index(pairs)

    def _index(self, pairs: dict[int, int]) -> None:
        """Open-addressed table of the pairs, for arrays of lookups."""
        self.bits = max(4, (4 * len(pairs) + 1).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.made = np.zeros(1 << self.bits, np.int64)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        made = np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._slot(keys)
        while len(keys):
            free = self.key[slot] == -1
            self.key[slot[free]] = keys[free]  # of several the last one wins
            won = self.key[slot] == keys
            self.made[slot[won]] = made[won]
            keys, made, slot = keys[~won], made[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, NONE if there is none."""
        keys = a << 32 | b
        found = np.full(len(keys), NONE)
        slot, open_ = self._slot(keys), np.arange(len(keys))
        while len(open_):
            there = self.key[slot]
            hit = there == keys[open_]
            found[open_[hit]] = self.made[slot[hit]]
            on = ~hit & (there != -1)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_long(vocab: Vocabulary, piece: bytes) -> list[int]:
    """Merge one long piece with a heap of pairs over a linked list."""
    ids = vocab.byte[np.frombuffer(piece, np.uint8)].tolist()
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    pairs = vocab.pairs
    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j], after[i] = rank, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left in (before[i], i):
            if left >= 0 and after[left] < n:
                x, y = ids[left], ids[after[left]]
                if (r := pairs.get(x << 32 | y)) is not None:
                    heapq.heappush(heap, (r, left, x, y))
    return [t for t, there in zip(ids, alive) if there]


def merge_all(vocab: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """Token ids of many pieces, none of them a token itself."""
    done: list[np.ndarray] = [np.empty(0, np.int64)] * len(pieces)
    short = [i for i, p in enumerate(pieces) if len(p) <= LONG_PIECE]
    for i, p in enumerate(pieces):
        if len(p) > LONG_PIECE:
            done[i] = np.array(merge_long(vocab, p), np.int64)
    owner = np.array(short, np.int64)
    sizes = np.fromiter((len(pieces[i]) for i in short), np.int64, len(short))
    ids = vocab.byte[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
    while len(owner):
        ends = np.cumsum(sizes)
        starts = ends - sizes
        pair = np.full(len(ids), NONE)
        pair[:-1] = vocab.merged(ids[:-1], ids[1:])
        pair[ends - 1] = NONE  # not across pieces
        # lowest rank, then leftmost: the place is in the low bits
        least = np.minimum.reduceat(pair << 22 | (np.arange(len(ids)) - np.repeat(starts, sizes)), starts)
        more = least >> 22 < NONE
        for k in np.flatnonzero(~more).tolist():
            done[owner[k]] = ids[starts[k] : ends[k]]
        spot = starts[more] + (least[more] & ((1 << 22) - 1))
        ids[spot] = least[more] >> 22
        keep = np.repeat(more, sizes)
        keep[spot + 1] = False
        ids, owner, sizes = ids[keep], owner[more], sizes[more] - 1
    return done


class Encoder:
    """Encodes batches of texts with one vocabulary; remembers pieces."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        rank = self.vocab.rank
        whole = [rank.get(p) for p in pieces]
        hard = [p for p, r in zip(pieces, whole) if r is None]
        merged = iter(merge_all(self.vocab, hard))
        ids = [np.array([r], np.int64) if r is not None else next(merged) for r in whole]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate((self.flat, *ids))
        self.start, self.length = np.concatenate((self.start, starts)), np.concatenate((self.length, lengths))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its ids and the byte offset at which each token starts."""
        if len(self.index) > CACHED:
            self._forget()
        # a separator no text is joined across: it closes whatever is open
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        points = codepoints.array_of("".join(texts))
        ends = np.cumsum(lengths)
        where, first = [], 0
        while first < len(texts):  # group texts into blocks
            last = first + 1
            while last < len(texts) and ends[last] - (ends[first] - lengths[first]) <= BLOCK // 2:
                last += 1
            begin = ends[first] - lengths[first]
            if last == first + 1:
                where.append(boundaries(points[begin : ends[first]]) + begin)
            else:
                where.append(self._joined(points, ends[first:last], begin) + begin)
            first = last
        cuts = np.concatenate(where) if where else np.empty(0, np.int64)
        width = np.ones(len(points), np.int64)
        for limit in (0x80, 0x800, 0x10000):
            width += points >= limit
        byte_at = np.concatenate(([0], np.cumsum(width)))
        raw = "".join(texts).encode("utf-8", "surrogatepass")
        opens = byte_at[cuts]
        closes = np.concatenate((opens[1:], [len(raw)])) if len(opens) else opens
        index, fresh = self.index, []
        spot = []
        for a, b in zip(opens.tolist(), closes.tolist()):
            piece = raw[a:b]
            k = index.get(piece)
            if k is None:
                k = index[piece] = len(index)
                fresh.append(piece)
            spot.append(k)
        if fresh:
            self._learn(fresh)
        spot = np.array(spot, np.int64)
        n = self.length[spot]
        ids = self.flat[np.repeat(self.start[spot] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        size = self.vocab.length[ids]
        at = np.cumsum(size) - size
        limits = np.searchsorted(at, byte_at[np.concatenate(([0], ends))], "left")
        begins = byte_at[ends - lengths]
        return [(ids[a:b], at[a:b] - c) for a, b, c in zip(limits[:-1], limits[1:], begins)]

    @staticmethod
    def _joined(points: np.ndarray, ends: np.ndarray, begin: int) -> np.ndarray:
        """Boundaries of several texts in one scan."""
        ends = ends - begin
        part = points[begin : begin + ends[-1]]
        # a line feed after each text leaves nothing open
        shift = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends))))
        spread = np.full(len(part) + len(ends), 10, np.uint32)
        spread[np.arange(len(part)) + shift] = part
        marks = ends + np.arange(len(ends))
        sym = symbols(spread)
        sym[marks] = GAP
        opens = scan(sym)
        return np.flatnonzero(opens[np.arange(len(part)) + shift])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        n = self.vocab.length[ids]
        at = np.repeat(self.vocab.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.vocab.flat[at].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ------------------------------------------------------------------- operators

STEP = 1 << 20  # characters encoded together


def _groups(texts: list[str]):
    """Neighbouring texts of about STEP characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= STEP:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids and the byte offset of each token, for every row of ``docs``."""

    @F.pandas_udf("ids array<int>, offsets array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = encoder(path)
        rows = [r for g in _groups([t or "" for t in texts]) for r in own.encode(g)]
        return pd.DataFrame({"ids": [r[0].astype(np.int32) for r in rows], "offsets": [r[1] for r in rows]})

    found = docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text).cast("string")).alias("t"))
    return found.select("doc_id", "t.ids", "t.offsets")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes of its ids; null ids give no bytes."""

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        own = encoder(path)
        return pd.Series([own.decode(np.asarray([] if v is None else v, dtype=np.int64)) for v in values])

    return encoded.withColumn("decoded", run(F.col(ids)))


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode, and only keep digests."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        own, rows = encoder(path), []
        for group in _groups([t or "" for t in texts]):
            for ids, _ in own.encode(group):
                packed = hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()
                rows.append((len(ids), packed, hashlib.sha256(own.decode(ids)).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    found = docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text).cast("string")).alias("t"))
    return found.select("doc_id", "t.*")
