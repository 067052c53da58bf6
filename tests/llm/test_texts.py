"""Decontamination, languages, licences, token counts and byte BPE against plain Python."""

import base64
import collections
import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loanloom.llm import bpe, catalog, codepoints, decontaminate, language, licenses, token_counts
from loanloom.llm.common import held_out

# ------------------------------------------------------------- decontamination


def squeezed(text):
    return " ".join(text.lower().split())


def edits_inside(passage, text):
    """Fewest edits between a passage and any part of a text."""
    row = np.zeros(len(text) + 1, int)
    points = np.array([ord(c) for c in text])
    steps = np.arange(len(text) + 1)
    for i, c in enumerate(passage):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (points != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def test_leaks_are_those_of_full_alignment(spark, documents, texts, folder):
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = {r["item_id"]: squeezed(r["text"]) for r in benchmark.collect()}
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(documents, benchmark).collect()}
    short = {i: t for i, t in texts.items() if len(t) < 3000}
    want = {
        (d, i) for d, t in short.items() for i, p in items.items()
        if edits_inside(p, squeezed(t)) <= min(int(len(p) * decontaminate.RATE), (len(p) - 8) // 8)
    }
    assert {(d, i) for d, i in found if d in short} == want
    assert want


def test_edited_passages_are_found_where_they_are():
    rng = random.Random(1)
    passage = "A passage of a benchmark, long enough that some edits still leave many shared pieces of text."
    index = decontaminate.Index((passage,), 0.1)
    for edits in range(int(index.edits[0]) + 1):
        chars = list(passage)
        for place in rng.sample(range(len(chars)), edits):
            chars[place] = "#"
        text = "before it " * 5 + "".join(chars).upper().replace(" ", "\n") + " after it" * 5
        ((k, a, b, found),) = decontaminate.find(text, index)
        assert (k, found) == (0, edits) and abs(a - 50) <= edits and abs(b - 50 - len(passage)) <= edits


def test_a_window_border_hides_nothing(monkeypatch):
    passage = "something that stands on the border of two windows of a long text"
    index = decontaminate.Index((passage,), 0.1)
    monkeypatch.setattr(decontaminate, "WINDOW", 100)
    for shift in range(60, 140, 7):
        text = "y z" * 400
        text = text[:shift] + passage + text[shift:]
        assert [f[3] for f in decontaminate.find(text, index)] == [0]


def test_a_phrase_that_many_passages_share_stays_cheap():
    """Neither the work nor the memory grows with passages times repetitions."""
    rng = random.Random(6)
    phrase = "the quick brown fox jumps over a lazy dog and runs "
    passages = tuple(phrase + "".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(2000))
    index = decontaminate.Index(passages, 0.1)
    text = phrase * 640 + passages[7]
    tracemalloc.start()
    begun = time.process_time()
    found = decontaminate.find(text, index)
    assert [f[0] for f in found] == [7] and found[0][3] == 0
    assert time.process_time() - begun < 10 and tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_passages_that_repeat_themselves():
    phrase = "one more time around "
    passages = tuple(phrase * 12 + str(i) * 9 for i in range(20))
    index = decontaminate.Index(passages, 0.1)
    begun = time.process_time()
    found = decontaminate.find(phrase * 190, index)
    assert time.process_time() - begun < 20
    text = squeezed(phrase * 190)
    for k, a, b, edits in found:
        assert edits == edits_inside(squeezed(passages[k]), text[a:b]) <= int(index.edits[k])
    assert {f[0] for f in found} == set(range(20))


def test_small_slices_and_windows_find_the_same(monkeypatch):
    rng = random.Random(2)
    passages = tuple("".join(rng.choice("abcd ") for _ in range(rng.choice([40, 90, 200]))) for _ in range(30))
    index = decontaminate.Index(passages, 0.1)

    def changed(p):
        return "".join(c for c in p if rng.random() > 0.02)

    text = " ".join("".join(rng.choice("abcd ") for _ in range(300)) + changed(rng.choice(passages)) for _ in range(25))
    want = decontaminate.find(text, index)
    assert len(want) > 15 and len(text) > 3000
    monkeypatch.setattr(decontaminate, "SLICE", 50)
    monkeypatch.setattr(decontaminate, "LANES", 10)
    assert decontaminate.find(text, index) == want


def test_recall_on_long_texts():
    """Every passage that full alignment finds in texts beyond 3,000 characters is found."""
    rng = random.Random(8)
    passages = tuple("".join(rng.choice("abcdefgh ") for _ in range(rng.choice([60, 120]))) for _ in range(12))
    index = decontaminate.Index(passages, 0.1)
    for _ in range(4):
        parts = []
        for p in passages:
            rate = rng.choice([0.0, 0.03, 0.08, 0.3])
            parts.append("".join(rng.choice("xyz") if rng.random() < rate else c for c in p))
            parts.append("".join(rng.choice("ijklmn ") for _ in range(400)))
        text = "".join(parts)
        got = {f[0] for f in decontaminate.find(text, index)}
        want = {
            k for k, p in enumerate(passages) if edits_inside(squeezed(p), squeezed(text)) <= int(index.edits[k])
        }
        assert got == want and len(text) > 3000


def test_leaks_of_awkward_rows(spark, awkward, nothing):
    items = [(1, "quick brown fox jumps over the lazy"), (None, "noch mehr wörter für die sprache"), (3, None), (4, ""), (5, "a")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    rows = decontaminate.leaks(awkward, benchmark).collect()
    assert collections.Counter((r["doc_id"], r["item_id"]) for r in rows) == {
        (1, 1): 1, (2, 1): 2, (3, 1): 1, (9, None): 2,
    }
    left = decontaminate.drop_leaked(awkward, benchmark)
    assert left.columns == awkward.columns and left.count() == awkward.count() - 6
    assert decontaminate.leaks(nothing, benchmark).count() == 0
    assert decontaminate.leaks(awkward, benchmark.where("1 = 0")).count() == 0
    assert decontaminate.drop_leaked(awkward, benchmark.where("1 = 0")).count() == awkward.count()


def test_blocks_of_the_benchmark_give_the_same(spark, awkward, monkeypatch):
    items = [(1, "quick brown fox jumps over the lazy"), (2, "noch mehr wörter für die sprache")]
    benchmark = spark.createDataFrame(items, "item_id int, text string")
    want = sorted(map(str, decontaminate.leaks(awkward, benchmark).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 10)
    assert sorted(map(str, decontaminate.leaks(awkward, benchmark).collect())) == want
    assert decontaminate.drop_leaked(awkward, benchmark).count() == awkward.count() - 6


# ------------------------------------------------------------------- languages


def test_languages_of_held_out_documents(spark, documents):
    rows = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    tested = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(tested) / len(tested) >= 0.95


def test_languages_of_awkward_rows(awkward, nothing):
    rows = language.identify(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["lang_pred"] in ("en", "de", "fr", "und")
    blank = [r for r in rows if r["doc_id"] in (4, 5, 6, 10)]
    assert {(r["lang_pred"], r["score"]) for r in blank} == {("und", 0.0)}
    assert language.identify(nothing).count() == 0
    unlabelled = awkward.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}
    left = language.keep_known(awkward)
    assert left.columns == awkward.columns
    assert left.where("doc_id in (4, 5, 6, 10)").count() == 0


def test_texts_with_a_letter_stay_where_nothing_was_learned(awkward):
    for unlabelled in (
        awkward.withColumn("lang", F.lit(None).cast("string")),
        awkward.withColumn("lang", F.when(held_out("doc_id", 3, 1), F.col("lang"))),
    ):
        left = language.keep_known(unlabelled)
        assert left.columns == unlabelled.columns
        lettered = [r["row"] for r in unlabelled.collect() if any(c.isalpha() for c in r["text"] or "")]
        assert sorted(r["row"] for r in left.collect()) == sorted(lettered)


def test_prediction_uses_the_text_alone(documents):
    shuffled = documents.withColumn("source", F.lit("z"))
    learned = language.fit(documents, ~held_out("doc_id", 3, 1))
    again = language.fit(shuffled, ~held_out("doc_id", 3, 1))
    assert all(np.array_equal(learned.pair[k], again.pair[k]) for k in learned.pair)
    assert set(learned.members) == {"germanic", "romance"}
    assert set(learned.pair) == {("de", "en"), ("es", "fr")}


def learned_from(docs, monkeypatch):
    """How many rows of de and en the machine that tells them apart is fitted on."""
    seen = []

    def fitted(x, positive):
        seen.append((int(positive.sum()), int((~positive).sum())))
        return np.zeros(x.shape[1], np.float32)

    monkeypatch.setattr(language, "fit_machine", fitted)
    language.fit(docs, F.lit(True))
    return seen[0] if seen else (0, 0)


@pytest.mark.parametrize("doc_id", ["null", "5", "id % 2", "id"])
@pytest.mark.parametrize("text", ["'gleich'", "concat('wort ', id)"])
def test_sample_is_bounded_whatever_the_identifiers_are(spark, monkeypatch, doc_id, text):
    monkeypatch.setattr(language, "ROWS_PER_LANGUAGE", 100)
    rows = spark.range(6000).selectExpr(
        f"cast({doc_id} as long) as doc_id", f"{text} as text", "if(id % 3 = 0, 'de', 'en') as lang"
    )
    found = learned_from(rows, monkeypatch)
    assert all(60 <= n <= 140 for n in found)
    assert learned_from(rows.repartition(7), monkeypatch) == found


def test_small_languages_are_learned_whole(awkward, monkeypatch):
    counts = {r["lang"]: r["count"] for r in awkward.where("text rlike '[a-zü]'").groupBy("lang").count().collect()}
    assert learned_from(awkward, monkeypatch) == (counts["de"], counts["en"])


# -------------------------------------------------------------------- licences


def plain_scan(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(labels))


LICENSED = [
    "MIT License, CC BY 4.0; the Apache License and again MIT license",
    "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */",
    "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\nMIT License",
    "gnu general public license mit license mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-license; MITLICENSE; mit licensé",
]


def test_base_places_equal_a_plain_scan(documents, texts):
    for r in licenses.scan(documents).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(
            texts[r["doc_id"]]
        )


def test_licences_of_awkward_rows(spark, awkward, nothing):
    rows = licenses.scan(awkward).collect()
    assert len(rows) == awkward.count() and {r["score"] for r in rows} == {0.0}
    assert licenses.scan(nothing).count() == 0
    for text in LICENSED:
        r = licenses.scan_text(text)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(text)
        assert 0 <= r["score"] <= 1
    labels = [licenses.scan_text(t)["labels"] for t in LICENSED]
    assert labels == ["apache,cc-by,mit", "apache,bsd,mit", "gpl,mit", "gpl,mit", "mit", "mit"]


@pytest.mark.parametrize(
    "expression, order, labels, permissive",
    [
        ("MIT", "mit", {"mit"}, True),
        ("MIT OR GPL-3.0-only", "mit gpl-3.0-only or", {"mit", "gpl"}, True),
        ("GPL-3.0-only or mit", "gpl-3.0-only mit or", {"mit", "gpl"}, True),
        ("MIT AND GPL-3.0-only OR ISC", "mit gpl-3.0-only and isc or", {"mit", "gpl", "isc"}, True),
        ("MIT AND (GPL-3.0-only OR LGPL-2.1)", "mit gpl-3.0-only lgpl-2.1 or and", {"mit", "gpl", "lgpl"}, False),
        ("GPL-2.0 WITH x AND MIT", "gpl-2.0 x with mit and", {"gpl", "mit"}, False),
        ("(MIT", "mit", {"mit"}, True),
        ("MIT AND", "mit", {"mit"}, True),
        ("MIT) foo", "mit", {"mit"}, True),
        ("LicenseRef-own", "licenseref-own", set(), False),
        ("AND MIT", "", set(), False),
    ],
)
def test_expressions(expression, order, labels, permissive):
    found = licenses.postfix(expression)
    assert " ".join(found) == order
    assert licenses.evaluate(found) == (labels, permissive)


# ---------------------------------------------------------------- token counts


def lengths_of(texts, path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return [len(own.encode_ordinary(t or "")) for t in texts]


def test_every_context_limit(spark, folder, texts):
    lengths = lengths_of(texts.values(), catalog.COUNTED_BY)
    rows = catalog.op9_token_counts(spark, folder).collect()
    assert sorted(r["context"] for r in rows) == sorted(set(lengths))
    for r in rows:
        limit = r["context"]
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_upto"] == sum(x <= limit for x in lengths) == len(lengths) - r["docs_over"]
        assert r["tokens_over"] == sum(x for x in lengths if x > limit) == sum(lengths) - r["tokens_upto"]
        assert r["truncated_tokens"] == sum(min(x, limit) for x in lengths)
        assert (r["total_docs"], r["total_tokens"]) == (len(lengths), sum(lengths))


def test_limits_between_lengths_and_quantiles(spark):
    lengths = [0, 0, 3, 7, 7, 7, 2000, 5000]
    counts = token_counts.histogram(spark.createDataFrame([(x,) for x in lengths], "length long"))
    sums = token_counts.suffix_sums(counts)
    for r in token_counts.at_limits(sums, [1, 5, 7, 2500, 9000]).collect():
        assert r["truncated_tokens"] == sum(min(x, r["context"]) for x in lengths)
        assert r["docs_upto"] == sum(x <= r["context"] for x in lengths)
    found = {r["share"]: r["length"] for r in token_counts.quantiles(sums, [0.25, 0.5, 1.0]).collect()}
    assert found == {0.25: 0, 0.5: 7, 1.0: 5000}


def test_counts_of_awkward_rows(awkward, nothing):
    counts = token_counts.token_lengths(awkward, catalog.COUNTED_BY, public_tokenizers.PATTERN)
    want = lengths_of([r["text"] for r in awkward.collect()], catalog.COUNTED_BY)
    assert sorted(r["length"] for r in counts.collect()) == sorted(want)
    empty = token_counts.token_lengths(nothing, catalog.COUNTED_BY, public_tokenizers.PATTERN)
    assert token_counts.suffix_sums(token_counts.histogram(empty)).count() == 0


# -------------------------------------------------------------------- byte BPE


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(catalog.VOCABULARY, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", "s", "t", "re", "ve", "ll", "'", "'", " ", " ", "\n", "\t", "1", "é", "ß", "!", "-", "中",
         "😀", "́", "m", "d", "\x1c", "\x85", "　", "٣", "X", "R", " ", "\r\n", "\x00"]


def test_encoding_equals_the_library(reference):
    rng = random.Random(5)
    cases = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    cases += ["", " ", "  ", " a", "a  ", "\n\n\n", "'s's 's", " " * 5000 + "a", "ab" * 3000, "x" * 700, "ñ" * 900]
    own = bpe.Encoder(catalog.VOCABULARY)
    for text, (ids, offsets) in zip(cases, own.encode(cases)):
        assert ids.tolist() == reference.encode_ordinary(text)
        raw = text.encode()
        assert own.decode(ids) == raw
        ends = [*offsets.tolist()[1:], len(raw)]
        assert [raw[a:b] for a, b in zip(offsets.tolist(), ends)] == [reference.decode_single_token_bytes(i) for i in ids]


def test_blocks_and_lanes_change_nothing(reference, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choice(PARTS) for _ in range(20_000)) + " " * 3000 + "a" * 3000
    for block, lanes in ((500, 8), (2000, 3), (1 << 20, 1)):
        monkeypatch.setattr(bpe, "BLOCK", block)
        monkeypatch.setattr(bpe, "LANES", lanes)
        assert bpe.Encoder(catalog.VOCABULARY).encode([text])[0][0].tolist() == reference.encode_ordinary(text)


def test_digests_and_round_trip(spark, documents, texts, awkward, nothing, reference):
    for docs, want in ((documents, texts.items()), (awkward, [(r["doc_id"], r["text"]) for r in awkward.collect()])):
        found = bpe.digests(docs, catalog.VOCABULARY).collect()
        plain = []
        for doc_id, text in want:
            ids = reference.encode_ordinary(text or "")
            packed = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            plain.append((doc_id, len(ids), packed, hashlib.sha256((text or "").encode()).hexdigest()))
        assert collections.Counter(map(tuple, found)) == collections.Counter(plain)
    assert bpe.digests(nothing, catalog.VOCABULARY).count() == 0
    decoded = bpe.decode(bpe.encode(awkward, catalog.VOCABULARY), catalog.VOCABULARY).collect()
    assert sorted(bytes(r["decoded"]) for r in decoded) == sorted((r["text"] or "").encode() for r in awkward.collect())


def test_classes_of_every_code_point_are_the_librarys():
    """A letter joins the a before it, a number the 1: then the probe's own token for the two bytes appears."""
    ranks = {bytes([i]): i for i in range(256)}
    for lead in range(0x80, 0x100):
        for mark in b"a1":
            ranks[bytes([mark, lead])] = len(ranks)
    probe = tiktoken.Encoding("p", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [p for p in range(0x80, 0x110000) if not 0xD800 <= p < 0xE000]

    def joined(mark):
        found = []
        for i in range(0, len(points), 10_000):
            ids = np.array(probe.encode_ordinary("".join(f"{mark}{chr(p)};" for p in points[i : i + 10_000])))
            ends = np.flatnonzero(ids == ord(";"))
            found.append(ids[np.concatenate(([0], ends[:-1] + 1))] >= 256)
        return np.concatenate(found)

    kinds = codepoints.classes()[points]
    assert (joined("a") == (kinds == codepoints.LETTER)).all()
    assert (joined("1") == (kinds == codepoints.NUMBER)).all()


def test_newer_letters_are_encoded_like_the_library():
    ranks = bpe.vocabulary(catalog.VOCABULARY).rank
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    new = [p for a, b in codepoints.NEW_LETTERS + codepoints.NEW_NUMBERS for p in (a, b)]
    texts = [f"a{chr(p)}a 1{chr(p)}1" for p in new]
    got = bpe.Encoder(catalog.VOCABULARY).encode(texts)
    assert [g[0].tolist() for g in got] == [own.encode_ordinary(t) for t in texts]
