"""WARC revisits, the bigram model and the pipeline against plain Python."""

import collections
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loanloom.llm import bpe, catalog, decontaminate, exact_dedup, language, lm, simhash, warc
from loanloom.llm.common import held_out, table

# ------------------------------------------------------------------------ WARC


def raw_record(kind, number, uri, seconds, http, body=b""):
    block = b"".join(line.encode() + b"\r\n" for line in http) + b"\r\n" + body
    date = "" if seconds is None else f"WARC-Date: 2024-01-01T00:00:{seconds:02d}Z\r\n"
    target = "" if uri is None else f"WARC-Target-URI: {uri}\r\n"
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {number}\r\n{target}{date}Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


OK = "HTTP/1.1 200 OK"
SAME = "HTTP/1.1 304 Not Modified"
RECORDS = [
    raw_record("response", "r1", "http://www.a.org/x/?b=2&a=1#top", 1, [OK, 'ETag: "1"', "Age: 1", "Content-Type: t"], b"one"),
    raw_record("response", "r2", "https://A.org/x?a=1&b=2&utm_source=z", 5, [OK, 'ETag: "2"', "Last-Modified: d"], b"two"),
    raw_record("response", "r3", "https://a.org/x?a=1&b=2", 5, [OK, 'ETag: "3"'], b"tie, larger id"),
    raw_record("revisit", "v1", "http://a.org/x?a=1&b=2", 3, [SAME, 'ETag: W/"1"', "Age: 2", "Content-Type: q"]),
    raw_record("revisit", "v2", "http://a.org/x?a=1&b=2", 5, [SAME, 'ETag: "2"']),
    raw_record("revisit", "v3", "http://a.org/x?a=1&b=2", 9, [SAME, 'ETag: "2"']),
    raw_record("revisit", "v3", "http://a.org/x?a=1&b=2", 9, [SAME, 'ETag: "2"']),
    raw_record("revisit", "v4", "http://a.org/x?a=1&b=2", 9, [SAME, "Last-Modified: d"]),
    raw_record("revisit", "v5", "http://a.org/x?a=1&b=2", 9, [SAME]),
    raw_record("revisit", "v6", "http://a.org/x?a=1&b=2", 1, [SAME, 'ETag: "1"']),
    raw_record("revisit", "v7", "http://other.org/", 9, [SAME, 'ETag: "1"']),
    raw_record("revisit", "v8", None, None, [SAME, 'ETag: "1"']),
    raw_record("request", "q", "http://a.org/x", 1, ["GET / HTTP/1.1"]),
    b"junk",
    b"",
    None,
]


def resolved(spark, records):
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "kept int, record binary")
    parsed = warc.parse(rows)
    return warc.resolve(parsed.withColumn("payload_sha256", F.sha2("payload", 256)).drop("payload")).collect()


def test_revisits_take_the_latest_earlier_response(spark):
    rows = resolved(spark, RECORDS)
    assert len(rows) == len(RECORDS)
    found = {r["record_id"]: r for r in rows if r["record_id"]}
    assert {k: (r["status"], r["response_id"]) for k, r in found.items()} == {
        "r1": ("full", None), "r2": ("full", None), "r3": ("full", None),
        "v1": ("resolved", "r1"), "v2": ("mismatch", None), "v3": ("resolved", "r2"), "v4": ("resolved", "r2"),
        "v5": ("unverified", None), "v6": ("no_response", None), "v7": ("no_response", None),
        "v8": ("no_response", None), "q": ("other", None),
    }
    assert found["v1"]["stored"] == {"etag": 'W/"1"', "age": "2", "content-type": "t"}
    assert found["v1"]["resolved_sha256"] == found["r1"]["resolved_sha256"] is not None
    assert [r["status"] for r in rows if r["record_id"] is None] == ["other"] * 3


def test_only_complete_responses_answer_revisits(spark):
    url = "http://a.org/"
    records = [raw_record("response", "r", url, 1, [OK, 'ETag: "1"'], b"one")]
    for t, status in enumerate(["206 Partial Content", "404 Not Found", "503 Unavailable", "304 Not Modified", "x"], 2):
        records.append(raw_record("response", f"s{t}", url, t, [f"HTTP/1.1 {status}", 'ETag: "no"'], b"part"))
    records.append(raw_record("revisit", "v", url, 9, [SAME, 'ETag: "1"']))
    found = {r["record_id"]: r for r in resolved(spark, records)}
    assert (found["v"]["status"], found["v"]["response_id"]) == ("resolved", "r")
    assert found["v"]["resolved_sha256"] == found["r"]["resolved_sha256"] is not None


def test_responses_without_a_record_id_answer_revisits(spark):
    def nameless(record):
        return re.sub(rb"WARC-Record-ID: [^\r]*\r\n", b"", record)

    one = nameless(raw_record("response", "", "http://a.org/", 1, [OK, 'ETag: "1"'], b"one"))
    tie = raw_record("response", "r", "http://b.org/", 1, [OK, 'ETag: "2"'], b"two")
    other = nameless(raw_record("response", "", "http://b.org/", 1, [OK, 'ETag: "3"'], b"three"))
    asked = [raw_record("revisit", f"v{k}", f"http://{k}.org/", 9, [SAME, f'ETag: "{n}"']) for k, n in (("a", 1), ("b", 2))]
    rows = resolved(spark, [one, tie, other, *asked])
    found = {r["record_id"]: r for r in rows if r["kind"] == "revisit"}
    assert (found["va"]["status"], found["va"]["response_id"]) == ("resolved", None)
    assert found["va"]["resolved_sha256"] == hashlib.sha256(b"one").hexdigest()
    assert (found["vb"]["status"], found["vb"]["response_id"]) == ("resolved", "r")


def test_resolution_of_no_records(spark):
    empty = spark.createDataFrame([], "record binary")
    parsed = warc.parse(empty).withColumn("payload_sha256", F.sha2("payload", 256))
    assert warc.resolve(parsed).count() == 0


def test_a_busy_url_over_many_buckets(spark):
    rows = []
    for t in range(4000):
        kind = "response" if t % 7 == 0 else "revisit"
        rows.append((kind, f"{kind}{t:05d}", "http://a.org/", t, 200 if t % 7 == 0 else 304, {"etag": str(t // 70)}))
    records = spark.createDataFrame(
        rows, "kind string, record_id string, target_uri string, t int, http_status int, headers map<string,string>"
    ).select("*", F.timestamp_seconds("t").alias("captured_at"), F.lit("p").alias("payload_sha256"))
    for r in warc.resolve(records).where("kind = 'revisit'").collect():
        last = (r["t"] - 1) // 7 * 7
        right = str(last // 70) == r["headers"]["etag"]
        assert (r["status"], r["response_id"]) == (("resolved", f"response{last:05d}") if right else ("mismatch", None))


def test_query_equals_a_plain_walk(spark, folder):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = catalog.op6_warc_revisits(spark, folder).collect()
    assert len(rows) == 2 * len(pages)
    full = collections.defaultdict(list)
    for r in rows:
        if r["kind"] == "response":
            full[r["canonical_url"]].append((r["captured_s"], r["record_id"], r["page_id"], r["resolved_sha256"]))
    seen = collections.Counter()
    for r in rows:
        if r["kind"] != "revisit":
            continue
        earlier = [x for x in full[r["canonical_url"]] if x[0] < r["captured_s"]]
        latest = max(x[0] for x in earlier)
        at, record, page, digest = min(x for x in earlier if x[0] == latest)
        number = r["page_id"]
        same_text = pages[page]["html"] == pages[number]["html"]
        if number % 7 == 0:
            want = "unverified"
        elif number % 5 == 0:
            want = "resolved" if (number % 8640 * 10) // 3600 == (page % 8640 * 10) // 3600 else "mismatch"
        else:
            want = "resolved" if same_text and number % 11 else "mismatch"
        assert r["status"] == want
        assert r["response_id"] == (record if want == "resolved" else None)
        if want == "resolved":
            assert r["resolved_sha256"] == digest and "cache-control: max-age=3600" in r["headers"]
        seen[want] += 1
    assert set(seen) == {"resolved", "mismatch", "unverified"}


def test_reading_plain_and_compressed_files(spark, tmp_path):
    whole = [r for r in RECORDS if r and r.startswith(b"WARC")]
    (tmp_path / "a.warc").write_bytes(b"".join(whole))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in whole))
    found = warc.parse(warc.read_warc(spark, str(tmp_path))).collect()
    assert len(found) == 2 * len(whole)
    assert collections.Counter(r["record_id"] for r in found)["r1"] == 2
    assert {bytes(r["payload"]) for r in found if r["record_id"] == "r2"} == {b"two"}


@pytest.mark.parametrize("piece", [1, 7, 1 << 16])
def test_members_of_several_records(monkeypatch, piece):
    monkeypatch.setattr(warc, "MEMBER_PIECE", piece)
    whole = [r for r in RECORDS if r and r.startswith(b"WARC")]
    bare = [r[: -len(b"\r\n\r\n")] for r in whole]
    assert list(warc.split_records(gzip.compress(b"".join(whole)))) == bare
    assert list(warc.split_records(gzip.compress(b"".join(whole[:3])) + gzip.compress(b"".join(whole[3:])))) == bare
    # what is left over in a member is not lost
    assert list(warc.split_records(gzip.compress(whole[0] + b"junk\r\n") + gzip.compress(whole[1]))) == [bare[0], b"junk", bare[1]]
    assert list(warc.split_records(gzip.compress(whole[0] + b"junk\r\n" + whole[1]))) == [bare[0], b"junk", bare[1]]


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://www.A.org:80/x/?b=1&a=2&utm_x=3#f", "a.org/x?a=2&b=1"),
        ("https://a.org", "a.org"),
        ("https://a.org:8080/p?", "a.org:8080/p"),
        ("urn:x#y", "urn:x"),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, want):
    row = spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u")).alias("c")).first()
    assert row["c"] == want


# ---------------------------------------------------------------- bigram model


@pytest.mark.parametrize("bits", [0, 7, 20, 45, 63])
def test_elias_fano(bits):
    rng = np.random.default_rng(bits)
    values = np.unique(rng.integers(0, 1 << bits, 3000, dtype=np.uint64)) if bits else np.zeros(5, np.uint64)
    coded = lm.EliasFano(values)
    assert np.array_equal(coded[np.arange(len(values))], values)
    asked = np.concatenate((values, rng.integers(0, 1 << max(bits, 1), 1000, dtype=np.uint64), values + np.uint64(1)))
    for x, at in zip(asked.tolist(), coded.find(asked).tolist()):
        assert (values[at] == x) if at >= 0 else x not in values
    assert lm.EliasFano(np.empty(0, np.uint64)).find(asked[:3]).tolist() == [-1] * min(3, len(asked))


def plain_model(docs, fold=2):
    """Scores of (id, text) pairs by dictionaries."""
    tokens = [(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None]) for _, t in docs]
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == fold for i, _ in docs]
    one, two, starts = collections.Counter(), collections.Counter(), 0
    for ts, held in zip(tokens, out):
        if not held:
            one.update(ts)
            two.update(zip(["<s>", *ts], ts))
            starts += 1
    n, v = sum(one.values()), len(one)
    rows = []
    for (i, _), ts, held in zip(docs, tokens, out):
        base = sum(math.log10((one[t] + 1) / (n + v + 1)) for t in ts)
        total = 0.0
        for before, t in zip(["<s>", *ts], ts):
            seen = starts if before == "<s>" else one[before]
            total += math.log10((two[before, t] + lm.MU * (one[t] + 1) / (n + v + 1)) / (seen + lm.MU))
        rows.append((i, held, len(ts), sum(one[t] > 0 for t in ts), n, base, total))
    return rows


def check_scores(found, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    assert len(found) == len(want)
    for a, b in zip(sorted(map(tuple, found), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], abs=0.02 * b[2])  # one byte per probability


def test_scores_equal_dictionaries(spark, documents, texts):
    found = lm.score(documents, held_out("doc_id", 7, 2)).collect()
    check_scores(found, plain_model(list(texts.items())))


def test_small_chunks_spread_long_texts(documents, texts, awkward):
    docs = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for size in (50, 1000):
        found = lm.score(awkward, held_out("doc_id", 7, 2), chunk=size).collect()
        check_scores(found, plain_model(docs))


def test_scores_without_rows_or_training(nothing, awkward):
    assert lm.score(nothing, held_out("doc_id", 7, 2)).count() == 0
    rows = lm.score(awkward, F.lit(True)).collect()
    assert {r["train_tokens"] for r in rows} == {0} and all(r["n_known"] == 0 for r in rows)
    assert all(math.isclose(r["base_score"], 0) and math.isclose(r["score"], 0, abs_tol=1e-9) for r in rows)


# -------------------------------------------------------------------- pipeline


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe",
    ]


def test_every_stage_by_its_operator(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, folder)
        before = ids(docs)
        if name == "language_id":
            marks = language.identify(docs).where("lang_pred <> 'und'")
            assert ids(got) == ids(marks)
        elif name == "exact_dedup":
            assert ids(got) == ids(exact_dedup.mark_duplicates(docs).where("kept"))
        elif name == "simhash_near_dedup":
            assert ids(got) == ids(simhash.near_duplicates(docs).where("doc_id = component_id"))
        elif name == "decontamination":
            assert ids(got) == before - ids(decontaminate.leaks(docs, table(spark, folder, "benchmark")))
            assert ids(got) != before
        else:
            assert sorted(map(str, got.collect())) == sorted(map(str, bpe.digests(docs, catalog.VOCABULARY).collect()))
            break
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, whole.collect())) == sorted(map(str, got.collect()))
