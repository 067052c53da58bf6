"""Exact duplicates, shards and SimHash against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loanloom.llm import exact_dedup, sharding, simhash
from loanloom.llm.components import components

# ----------------------------------------------------------------- exact dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_marks(rows, docs):
    groups = collections.defaultdict(list)
    for doc_id, text in docs:
        groups[hashlib.sha256(normal(text).encode()).hexdigest()].append(doc_id)
    assert len(rows) == len(docs)
    kept = collections.Counter()
    for r in rows:
        ids = groups[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (min(known) if known else None)
        if r["kept"]:
            kept[r["text_sha256"]] += 1
            assert r["doc_id"] == r["keep_id"]
    assert set(kept) == set(groups) and set(kept.values()) <= {1}


def test_marks_of_documents(documents, texts):
    check_marks(exact_dedup.mark_duplicates(documents).collect(), list(texts.items()))


def test_marks_of_awkward_rows(awkward):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check_marks(exact_dedup.mark_duplicates(awkward).collect(), docs)


def test_many_runs_take_several_rounds(documents, texts):
    spread = documents.repartition(80)
    check_marks(exact_dedup.mark_duplicates(spread).collect(), list(texts.items()))


def test_kept_rows_keep_their_columns(awkward):
    left = exact_dedup.drop_duplicates(awkward)
    assert left.columns == awkward.columns
    rows = left.collect()
    assert len(rows) == len({normal(r["text"]) for r in awkward.collect()})
    assert len({normal(r["text"]) for r in rows}) == len(rows)


def test_dedup_of_an_empty_table(nothing):
    assert exact_dedup.mark_duplicates(nothing).count() == 0
    assert exact_dedup.drop_duplicates(nothing).count() == 0


def test_dedup_runs_no_python(documents):
    plan = exact_dedup.mark_duplicates(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ---------------------------------------------------------------------- shards


def check_shards(rows, docs, shards=8):
    assert len(rows) == len(docs)
    want = collections.Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    assert want == collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    by_shard = collections.defaultdict(list)
    for r in rows:
        by_shard[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(by_shard) <= set(range(shards))
    for s in range(shards):
        own = sorted(by_shard[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= largest
        ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in own]
        assert ids == sorted(ids)
    spans = [[r["doc_id"] if r["doc_id"] is not None else -1 for r in by_shard[s]] for s in sorted(by_shard) if by_shard[s]]
    assert all(max(a) <= min(b) for a, b in zip(spans, spans[1:]))


def test_shards_of_documents(documents, texts):
    check_shards(sharding.byte_shards(documents).collect(), list(texts.items()))


def test_shards_of_awkward_rows(awkward):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check_shards(sharding.byte_shards(awkward).collect(), docs)


def test_shards_of_an_empty_table(nothing):
    assert sharding.byte_shards(nothing).count() == 0


def test_sharding_runs_no_python(documents):
    plan = sharding.byte_shards(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --------------------------------------------------------------------- simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, bits=3):
    """Smallest root per fingerprint, by looking at all pairs."""
    values = np.array(sorted(set(fps)), dtype=np.uint64)
    root = np.arange(len(values))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= bits)
        least = root[near].min()
        for old in set(root[near].tolist()):
            root[root == old] = least
    return dict(zip(values.tolist(), root.tolist()))


def check_near(rows, docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    root = plain_components(fps)
    least = {}
    for (doc_id, _), fp in zip(docs, fps):
        if doc_id is not None:
            least[root[fp]] = min(doc_id, least.get(root[fp], doc_id))
    want = collections.Counter((i, f"{fp:016x}", least.get(root[fp])) for (i, _), fp in zip(docs, fps))
    assert want == collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows)


def test_near_duplicates_of_documents(documents, texts):
    check_near(simhash.near_duplicates(documents).collect(), list(texts.items()))


def test_near_duplicates_of_awkward_rows(awkward):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    check_near(simhash.near_duplicates(awkward).collect(), docs)


def test_near_duplicates_of_an_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0


def test_one_of_each_component_stays(documents):
    left = simhash.keep_one(documents)
    assert left.columns == documents.columns
    marks = simhash.near_duplicates(documents).collect()
    assert {r["doc_id"] for r in left.collect()} == {r["component_id"] for r in marks}


def test_one_row_stays_where_identifiers_are_null_or_repeated(spark):
    x, y, z = (" ".join(f"{w}{i}" for i in range(40)) for w in "xyz")
    rows = [(7, x), (3, y), (7, y), (None, x), (None, y), (None, z), (None, z.upper()), (None, z)]
    docs = spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id int, text string, row_number int")
    left = simhash.keep_one(docs.repartition(3))
    assert left.columns == docs.columns
    found = sorted((r["doc_id"] or 0, r["text"].lower()) for r in left.collect())
    assert found == [(0, z), (3, y), (7, x)]


def test_one_of_each_component_stays_of_awkward_rows(awkward):
    roots = plain_components([plain_fingerprint(r["text"]) for r in awkward.collect()])
    left = simhash.keep_one(awkward).collect()
    assert sorted(roots[plain_fingerprint(r["text"])] for r in left) == sorted(set(roots.values()))


def test_hash_is_the_engines(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("añb c")).alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest("añb c".encode(), seed=42)


def clustered(count, seed):
    """Fingerprints of which many lie within a few bits of a few centres."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    found = rng.integers(0, 1 << 63, count, dtype=np.uint64).tolist()
    for _ in range(count):
        value = int(centres[rng.integers(4)])
        for bit in rng.integers(0, 64, rng.integers(0, 7)):
            value ^= 1 << int(bit)
        found.append(value)
    return sorted(set(found))


def roots_of(spark, values, bits=3):
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    fps = spark.createDataFrame(signed, "fp long")
    stars = {r["node"] % (1 << 64): r["root"] for r in components(simhash.near_links(fps, bits)).collect()}
    return [stars.get(v, v - (1 << 64) if v >= 1 << 63 else v) for v in values]


def same_parts(values, found):
    want = plain_components(values)
    pairs = {(want[v], f) for v, f in zip(values, found)}
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_links_connect_what_all_pairs_connect(spark):
    values = clustered(1500, 1)
    assert same_parts(values, roots_of(spark, values))


def test_large_cells_are_dealt_out_as_tiles(spark, monkeypatch):
    # the workers read the size from the closure, so a small one is used everywhere
    monkeypatch.setattr(simhash, "CELL", 8)
    values = clustered(600, 2)
    assert same_parts(values, roots_of(spark, values))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(50)] + [(5, 5)]
    stars = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert stars == {**{i: 0 for i in range(1, 101)}, **{200 + i: 200 for i in range(1, 50)}}
