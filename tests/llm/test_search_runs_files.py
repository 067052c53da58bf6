"""Ranked search, periodic runs and token files against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from loanloom.llm import ranked_search, repeats, token_files
from loanloom.llm.catalog import TOKENIZER, with_planted_runs
from loanloom.session import scratch_path

BLANKS = " \t\n\x0b\x0c\r"

# --------------------------------------------------------------- ranked search


def ranked(docs, items, k):
    """(item number, rank, doc_id, score) by scoring every document for every item."""
    held = [(d, Counter(ranked_search.terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    found = []
    for number, (_, text) in enumerate(items):
        scores = []
        for d, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_all
            score = 0
            for t in set(ranked_search.terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        scores.sort(key=lambda s: s[:3])
        found += [(number, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return found


def test_terms_lower_ascii_only():
    assert ranked_search.terms("Ab_É9-x\x7f\x00É z") == ["ab".encode(), "É9".encode(), b"x", "É z".encode()]
    assert ranked_search.terms(None) == []


@pytest.mark.parametrize("k,cells", [(1, 1 << 22), (5, 200), (50, 60)])
def test_search_equals_scoring_everything(spark, monkeypatch, k, cells):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = []
    for i in range(250):
        size = rng.choice([0, 1, 3, 10, 40])
        docs.append((i, " ".join(rng.choice(vocabulary[: rng.choice([4, 30])]) for _ in range(size))))
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, "w1 w2"), (None, "w1 w2"), (3, docs[3][1]), (9, None)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.randint(1, 6)))) for i in range(12)]
    items += [(5, "w1 W2"), (None, "w3"), (20, ""), (21, None), (22, "unseen")]
    want = [(items[n][0], *rest) for n, *rest in ranked(docs, items, k)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, rank string, item int")
    asked = spark.createDataFrame([(*i, 2) for i in items], "item_id int, text string, score int")
    monkeypatch.setattr(ranked_search, "CELLS", cells)
    got = ranked_search.search(frame.repartition(3), asked, k).collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_chunks_and_waiting_do_not_matter(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ranked_search, "WAITING", 20)
    monkeypatch.setattr(ranked_search, "CELLS", 300)
    monkeypatch.setattr(ranked_search, "FEW", 2)
    n, v = 200, 25
    counts = rng.integers(0, 4, (n, v)) * (rng.random((n, v)) < 0.3)
    counts[:, 0] = np.maximum(counts[:, 0], 1)
    m, weights = rng.integers(50, 400, n), rng.integers(0, 9000, v)
    items = [np.sort(rng.choice(v, 5, replace=False)) for _ in range(8)]
    own = ranked_search.Searcher(items, weights, (counts > 0).sum(axis=0), 6)
    doc, term = np.nonzero(counts)
    own.chunk(np.arange(n), np.zeros(n, np.int64), m, (counts > 0).sum(axis=1), term, counts[doc, term])
    own.best.settle()
    item, score, found, _ = own.best.kept
    for i, terms in enumerate(items):
        c = counts[:, terms]
        exact = (weights[terms] * (1_000_000_000 * c // (1000 * c + 20 * m[:, None]))).sum(axis=1)
        order = np.lexsort((np.arange(n), -exact))[:6]
        assert found[item == i].tolist() == order.tolist()
        assert score[item == i].tolist() == exact[order].tolist()


def test_tree_nodes_bound_their_documents():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (60, 12))
    counts[:, 0] = 1
    m = rng.integers(50, 90, 60)
    tree = ranked_search.build([np.flatnonzero(c) for c in counts], counts, m)
    assert sorted(tree.below[tree.root].tolist()) == list(range(60))
    for node, docs in tree.below.items():
        assert (tree.counts[node] == counts[docs].max(axis=0)).all() and tree.m[node] == m[docs].min()
        assert sorted(docs.tolist()) == sorted(
            d for k in tree.kids[node] for d in ([k] if k < 60 else tree.below[k].tolist())
        )


def test_search_without_documents_or_items(spark, nothing, awkward):
    items = spark.createDataFrame([(1, "fox")], "item_id int, text string")
    assert ranked_search.search(nothing, items).collect() == []
    assert ranked_search.search(awkward, items.where("1 = 0")).collect() == []
    docs = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    got = ranked_search.search(awkward, items).collect()
    assert Counter(map(tuple, got)) == Counter((1, *r[1:]) for r in ranked(docs, [(1, "fox")], 50))


# --------------------------------------------------------------- periodic runs


def plain_runs(words, least=12):
    """Every run, by comparing the words at every distance."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def plain_row(doc_id, text):
    words = [w for w in "".join(" " if c in BLANKS else c for c in text or "").split(" ") if w]
    code = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if code % 10 == 0 and words:
        g, n = code // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(((-n, s, q) for s, n, q in runs), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)))


def test_sums_of_squared_differences_are_exact():
    rng = np.random.default_rng(2)
    for b, places in ((2, 6), (4, 8), (32, 64)):
        blocks = rng.integers(0, 90_000, (5, b)).astype(np.uint64)
        windows = rng.integers(0, 90_000, (5, b + places - 1)).astype(np.uint64)
        got = repeats.square_differences(blocks, windows)
        want = [
            [sum((int(x) - int(y)) ** 2 for x, y in zip(p, w[d:])) % repeats.PRIME for d in range(places)]
            for p, w in zip(blocks, windows)
        ]
        assert got.tolist() == want


def test_runs_of_many_kinds():
    rng = random.Random(4)
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 300:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    texts = [fibonacci[1], [b"x"] * 500, [b"x"] * 11, [b"x"] * 12, [], [b"a", b"b"] * 6, [b"a", b"b"] * 5 + [b"a"]]
    for _ in range(150):
        n, v = rng.choice([11, 12, 13, 25, 60, 200]), rng.choice([1, 2, 3, 50])
        words = [b"%d" % rng.randrange(v) for _ in range(n)]
        for _ in range(rng.randint(0, 3)):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, min(n, a + p * rng.randint(2, 5) + rng.randrange(p))):
                words[i] = words[a + (i - a) % p]
        texts.append(words)
    assert repeats.find(texts) == [plain_runs(t) for t in texts]
    assert repeats.find([]) == []


@pytest.mark.parametrize("period", [1, 3, 1000, 49_999])
def test_long_texts(period):
    words = [b"%d" % (i % period) for i in range(100_000)]
    assert repeats.find([words, words[:5]]) == [[(0, 100_000, period)], []]


def test_run_operator_on_awkward_rows(awkward, nothing):
    rows = awkward.select("doc_id", "text").collect()
    got = repeats.periodic_runs(awkward).collect()
    blanks = [(d, t.encode().split() if t else []) for d, t in rows if not t or len(t) < 10_000]
    want = Counter((d, tuple(plain_runs(w))) for d, w in blanks)
    assert Counter((r[0], tuple(map(tuple, r[1]))) for r in got if r[0] not in (7, 8)) == want
    # "word" 30000 times, then one long word
    assert [(tuple(r[1][0]), len(r[2])) for r in got if r[0] in (7, 8)] == [((0, 30_000, 1), 20_005)] * 2
    assert repeats.periodic_runs(nothing).collect() == []


def test_run_query_equals_plain_python(spark, folder, documents):
    query = entry.queries()["op12_periodic_runs"](spark, folder)
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert query.columns == names
    rows = [r for r in documents.select("doc_id", "text").collect() if len((r["text"] or "").split()) < 2500]
    got = {r["doc_id"]: tuple(r) for r in query.collect()}
    assert len(got) == documents.count() and sum(r[1] for r in got.values()) > 10
    assert all(got[d] == plain_row(d, t) for d, t in rows)


def test_planting_leaves_null_ids_alone(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    rows = [(i, "a b\tc d\ne f g h") for i in ids] + [(None, "a b  c"), (ids[0], None), (ids[1], " "), (ids[2], "one")]
    got = with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for d, t in got[:6]:
        g = zlib.crc32(str(d).encode()) // 10
        words, a = "abcdefgh", g % 8
        p = 1 + (8 - a) // (3 + g % 8)
        assert t.split(" ") == [words[i if i < a else a + (i - a) % p] for i in range(8)]
    assert [t for _, t in got[6:]] == ["a b  c", "", " ", "one"]


# ----------------------------------------------------------------- token files


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(TOKENIZER)
    found.encode_special_tokens = True
    return lambda t: found.encode(t or "", add_special_tokens=False).ids


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def written(spark, docs):
    return token_files.write(docs, TOKENIZER, scratch_path(spark, "token-files"), end_id=2)


def test_new_pieces_share_inputs_of_the_library():
    class Counted:
        def __init__(self, library):
            self.library, self.inputs = library, 0

        def encode_batch_fast(self, inputs, **settings):
            self.inputs += len(inputs)
            return self.library.encode_batch_fast(inputs, **settings)

    texts = [" ".join(f"w{k}é{k * k}\u4e2d {k}'s  \n" for k in range(a, a + 300)) for a in (0, 300)] + ["", "\x00\x7f"]
    together, apart = token_files.Encoder(TOKENIZER), token_files.Encoder(TOKENIZER)
    together.by_piece, apart.spelled = Counted(together.by_piece), None
    want = [apart.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in together.encode(texts)] == want
    assert [ids.tolist() for ids in apart.encode(texts)] == want
    pieces = len(together.number)
    assert pieces > token_files.ONE_INPUT and together.by_piece.inputs == -(-pieces // token_files.ONE_INPUT)


def test_pieces_give_the_ids_of_whole_texts(library):
    rng = random.Random(1)
    own = token_files.encoder(TOKENIZER)
    texts = ["", " ", "  a  b ", "it's they'll I'M", "<|endoftext|>", "x" * 5000, "a  b\n\n c", "1\x1c2 \x1f3\x85 4"]
    for _ in range(300):
        points = [rng.choice([rng.randrange(128), rng.randrange(0x3000), rng.randrange(0xE000, 0x110000), 32]) for _ in range(25)]
        texts.append("".join(map(chr, points)))
    # letters of later Unicode versions
    texts += [f"a{chr(p)}a 1{chr(p)}1" for p in (0x10D40, 0x1C89, 0x11380, 0x88F, 0x208F, 0x1E6C0)]
    assert [x.tolist() for x in own.encode(texts)] == [library(t) for t in texts]


def test_query_equals_the_library(spark, folder, documents, library):
    want, at = [], 0
    for r in sorted(documents.select("doc_id", "text").collect()):
        ids = [*library(r["text"]), 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(packed(ids))))
        at += len(ids)
    assert sorted(map(tuple, entry.queries()["op13_token_files"](spark, folder).collect())) == want


def test_awkward_rows_in_files(spark, awkward, nothing, library):
    files = written(spark, awkward)
    got = sorted(files.read().collect(), key=lambda r: r["start"])
    rows = sorted(awkward.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["key"] for r in got] == [r["doc_id"] for r in rows]
    assert Counter((r["key"], bytes(r["ids"])) for r in got) == Counter((d, packed([*library(t), 2])) for d, t in rows)
    sizes = [r["n_tokens"] for r in got]
    assert [r["start"] for r in got] == [sum(sizes[:k]) for k in range(len(sizes))]
    assert written(spark, nothing).read().collect() == []


def test_lookup_finds_every_document_of_a_key(spark, awkward):
    files = written(spark, awkward)
    everything = files.read().collect()
    wanted = spark.createDataFrame([(k,) for k in (2, 9, 7, None, 7, 55, -1, 10**12)], "k long")
    got = files.lookup(wanted, "k").collect()
    assert sorted(got, key=str) == sorted((r for r in everything if r["key"] in (2, 9, 7, None)), key=str)
    assert files.lookup(wanted.where("1 = 0"), "k").collect() == []


def test_one_hot_key_over_many_shards(spark):
    rows = [(5 if i % 3 else i, f"text {i % 7}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast("string"))
    files = written(spark, docs)
    assert len(files.shards) > 3
    found = files.lookup(docs.where("doc_id = '5'"), "doc_id").collect()
    assert len(found) == sum(k == 5 for k, _ in rows) and {r["key"] for r in found} == {"5"}
    assert len(files.read().collect()) == 600


def test_only_listed_files_are_read(spark, awkward):
    folder = scratch_path(spark, "token-files")
    files = token_files.write(awkward, TOKENIZER, folder, end_id=2)
    before = files.read().count()
    system, path = token_files._folder(folder)
    with system.open_output_stream(f"{path}/shard-of-a-lost-task.ids") as out:
        out.write(b"123")
    assert files.read().count() == before


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = [b"=%d" % i for i in range(n)]
    first, second = token_files._hashes(keys)
    own = token_files.PerfectHash.of(first, second)
    assert sorted(own.slots(first, second).tolist()) == list(range(n))
    # one first hash for all keys: still distinct pairs
    first = np.zeros(n, np.uint64)
    own = token_files.PerfectHash.of(first, second)
    assert sorted(own.slots(first, second).tolist()) == list(range(n))


def test_perfect_hash_lists_what_no_level_places(monkeypatch):
    monkeypatch.setattr(token_files, "LEVELS", 1)
    first, second = token_files._hashes([b"=%d" % i for i in range(1000)])
    own = token_files.PerfectHash.of(first, second)
    assert len(own.rest) and sorted(own.slots(first, second).tolist()) == list(range(1000))


def test_wide_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    files = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-files"), end_id=70_000)
    assert [np.frombuffer(r["ids"], "<u4")[-1] for r in files.read().collect()] == [70_000, 70_000]
