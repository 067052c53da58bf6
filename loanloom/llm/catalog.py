"""The registered queries of this package, and SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanloom.llm import bpe, decontaminate, exact_dedup, language, licenses, lm, ranked_search, repeats
from loanloom.llm import sharding, simhash, token_counts, token_files, warc
from loanloom.llm.common import held_out, table, text_of
from loanloom.session import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTED_BY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, folder, "documents")).drop("n_bytes")


def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.byte_shards(table(spark, folder, "documents"), shards=8)


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), width=3, max_bits=3)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of ``pages``: each is fetched, and asked for again a day later.

    The second answer is a 304 with an entity tag (a stale one for every eleventh page), for
    every fifth page only a date, for every seventh no validator at all.
    """
    end = F.lit("\r\n")
    html, number = F.coalesce("html", F.lit("")), F.col("page_id")
    url = F.coalesce("url", F.lit(""))
    fetched = F.coalesce(number, F.lit(0)) % 8640 * 10
    tag = F.substring(F.md5(html), 1, 16)

    def stamp(seconds, pattern):
        return F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + seconds), pattern)

    def lines(*parts):
        return F.concat(*[x for p in parts for x in (p, end)], end)

    def record(kind, seconds, http, body, *extra):
        block = F.concat(http, body)
        head = lines(
            F.lit("WARC/1.1"),
            F.lit(f"WARC-Type: {kind}"),
            F.concat(F.lit(f"WARC-Record-ID: <urn:{kind}:"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">")),
            F.concat(F.lit("WARC-Target-URI: "), url),
            F.concat(F.lit("WARC-Date: "), stamp(seconds, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            *extra,
            F.lit("Content-Type: application/http;msgtype=response"),
            F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
        )
        return F.concat(head, block, end, end).cast("binary")

    date = F.concat(F.lit("Last-Modified: day "), F.floor(fetched / 3600).cast("string"))
    full = lines(
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.octet_length(html).cast("string")),
        F.lit("Cache-Control: max-age=60"),
        date,
        F.concat(F.lit('ETag: "'), tag, F.lit('"')),
    )
    stale = F.when(number % 11 == 0, F.reverse(tag)).otherwise(tag)
    validator = (
        F.when(number % 7 == 0, F.lit("X-Checked: no"))
        .when(number % 5 == 0, date)
        .otherwise(F.concat(F.lit('ETag: W/"'), stale, F.lit('"')))
    )
    again = lines(
        F.lit("HTTP/1.1 304 Not Modified"),
        F.lit("Content-Length: 0"),
        F.lit("Cache-Control: max-age=3600"),
        validator,
    )
    profile = F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified")
    both = F.array(
        record("response", fetched, full, html),
        record("revisit", fetched + 86_400, again, F.lit(""), profile),
    )
    return pages.select("page_id", F.explode(both).alias("record"))


def op6_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.parse(captures(table(spark, folder, "pages")))
    digested = records.withColumn("payload_sha256", F.sha2("payload", 256)).drop("payload")
    found = warc.resolve(digested)
    pairs = F.transform(F.map_entries("stored"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "page_id",
        "record_id",
        "kind",
        "canonical_url",
        F.unix_timestamp("captured_at").alias("captured_s"),
        "status",
        "response_id",
        F.array_join(F.array_sort(pairs), "\n").alias("headers"),
        "resolved_sha256",
    )


def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents"), held_out("doc_id", 7, 2))


def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents"))
    as_text = F.transform("expressions", lambda e: e["postfix"])
    return found.withColumn("expressions", F.array_join(as_text, "; "))


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    lengths = token_counts.token_lengths(
        table(spark, folder, "documents"), COUNTED_BY, public_tokenizers.PATTERN
    )
    return token_counts.suffix_sums(token_counts.histogram(lengths))


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), VOCABULARY)


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of every tenth doc_id, by its CRC-32, repeat themselves from some word on; a null id plants none."""
    code = F.crc32(F.col("doc_id").cast("string"))
    seed = F.floor(code / 10)
    words = F.regexp_extract_all(text_of("text"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(w):
        n = F.size(w)
        first = seed % n
        period = F.lit(1) + F.floor((n - first) / (F.lit(3) + seed % 8))
        source = F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get(w, F.when(i < first, i).otherwise(first + (i - first) % period).cast("int")),
        )
        return F.when(n > 0, F.array_join(source, " "))

    planted = F.when(code % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0)))
    return docs.select("doc_id", F.coalesce(planted, text_of("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.periodic_runs(with_planted_runs(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        found.withColumns({"longest": longest, "lines": F.array_join(lines, "")})
        .withColumns({"length": F.col("longest.length"), "period": -F.col("longest.col3")})
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("longest.col2")).alias("start"),
            "length",
            "period",
            F.floor(F.col("length") * 1000 / F.col("period")).alias("exponent_milli"),
            F.sha2("lines", 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "token-files")
    files = token_files.write(table(spark, folder, "documents"), TOKENIZER, target, end_id=2)
    return files.read().select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_sharding,
        op3_simhash,
        op4_decontamination,
        op5_language_id,
        op6_warc_revisits,
        op7_lm_scoring,
        op8_license_scan,
        op9_token_counts,
        op10_byte_bpe,
        op11_ranked_search,
        op12_periodic_runs,
        op13_token_files,
    )
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
    # CRC-32 byte by byte; its table comes from the reversed polynomial
    "op2_sharding": """
        WITH steps AS MATERIALIZED (
            SELECT list(c ORDER BY b) AS step FROM (
                SELECT b, list_reduce(list_prepend(b, range(8)),
                    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
                FROM range(256) t(b))
        ),
        b AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
        d AS (
            SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size,
                CAST(xor(list_reduce(
                    list_prepend(CAST(4294967295 AS BIGINT), list_transform(b, lambda h: CAST('0x' || h AS BIGINT))),
                    lambda c, x: xor(c // 256, step[xor(c, x) % 256 + 1])), 4294967295) AS BIGINT) AS text_crc32
            FROM b, steps
        ),
        s AS (
            SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total FROM d
            WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
        ),
        c AS (SELECT *, CAST((8 * (2 * before + size)) // (2 * total) AS INTEGER) AS shard FROM s)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
            row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
            CAST(NULL AS INTEGER) AS grown_shard
        FROM c
    """,
    "op6_warc_revisits": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, trim(coalesce(url, '')) AS url,
                substr(md5(coalesce(html, '')), 1, 16) AS tag, 1700000000 + coalesce(page_id, 0) % 8640 * 10 AS t,
                'day ' || coalesce(page_id, 0) % 8640 * 10 // 3600 AS day, coalesce(CAST(page_id AS VARCHAR), 'none') AS name
            FROM pages
        ),
        u AS (
            SELECT *, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?' AS pattern,
                list_sort(list_filter(string_split(regexp_extract(url, pattern, 3), '&'),
                    lambda f: NOT regexp_full_match(f, '(utm_[^=]*(=.*)?)?'))) AS fields
            FROM p
        ),
        c AS (
            SELECT *, CASE WHEN regexp_matches(url, pattern) THEN
                    regexp_replace(lower(regexp_extract(url, pattern, 1)), '^www\.|:(80|443)?$', '', 'g')
                    || regexp_replace(regexp_extract(url, pattern, 2), '/+$', '')
                    || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END
                ELSE regexp_replace(url, '#.*$', '') END AS canonical_url
            FROM u
        ),
        full_ AS (
            SELECT page_id, '<urn:response:' || name || '>' AS record_id, canonical_url, t, tag, day,
                octet_length(encode(html)) AS bytes, sha256(html) AS digest
            FROM c
        ),
        points AS (
            SELECT * FROM full_
            QUALIFY row_number() OVER (PARTITION BY canonical_url, t ORDER BY record_id) = 1
        ),
        asked AS (
            SELECT page_id, '<urn:revisit:' || name || '>' AS record_id, canonical_url, t + 86400 AS t,
                CASE WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN NULL
                    WHEN page_id % 11 = 0 THEN reverse(tag) ELSE tag END AS sent_tag,
                CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 5 = 0 THEN day END AS sent_day
            FROM c
        ),
        met AS (
            SELECT a.*, r.record_id AS old_id, r.tag AS old_tag, r.day AS old_day, r.bytes, r.digest,
                CASE WHEN r.record_id IS NULL THEN 'no_response'
                    WHEN coalesce(sent_tag, sent_day) IS NULL THEN 'unverified'
                    WHEN coalesce(sent_tag = r.tag, sent_day = r.day) THEN 'resolved' ELSE 'mismatch' END AS status
            FROM asked a ASOF LEFT JOIN points r ON a.canonical_url = r.canonical_url AND a.t > r.t
        )
        SELECT page_id, record_id, 'response' AS kind, canonical_url, t AS captured_s, 'full' AS status, NULL AS response_id,
            concat_ws(chr(10), 'cache-control: max-age=60', 'content-length: ' || bytes, 'content-type: text/html',
                'etag: "' || tag || '"', 'last-modified: ' || day) AS headers, digest AS resolved_sha256
        FROM full_
        UNION ALL
        SELECT page_id, record_id, 'revisit', canonical_url, t, status, CASE WHEN status = 'resolved' THEN old_id END,
            CASE WHEN status = 'resolved' THEN
                concat_ws(chr(10), 'cache-control: max-age=3600', 'content-length: ' || bytes, 'content-type: text/html',
                    'etag: ' || coalesce('W/"' || sent_tag || '"', '"' || old_tag || '"'), 'last-modified: ' || old_day)
            ELSE
                concat_ws(chr(10), 'cache-control: max-age=3600', 'content-length: 0', 'etag: W/"' || sent_tag || '"',
                    'last-modified: ' || sent_day, CASE WHEN coalesce(sent_tag, sent_day) IS NULL THEN 'x-checked: no' END)
            END, CASE WHEN status = 'resolved' THEN digest END
        FROM met
    """,
    "op11_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents)
        ),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM words GROUP BY ALL),
        whole AS (SELECT count(*) AS n_docs, sum(n) AS n_all FROM (SELECT DISTINCT doc_id, n FROM tf)),
        wanted AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
        ),
        w AS (
            SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, whole WHERE term IN (SELECT term FROM wanted) GROUP BY term
        ),
        scored AS (
            SELECT item_id, doc_id, CAST(sum(w * (1000000000 * tf
                // (1000 * tf + 20 * (50 + 50 * n * n_docs // n_all)))) AS BIGINT) AS score
            FROM wanted JOIN w USING (term) JOIN tf USING (term), whole GROUP BY item_id, doc_id
        )
        SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER o <= 50
    """,
}
