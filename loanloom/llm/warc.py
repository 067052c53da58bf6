"""WARC records, and revisits resolved to the response they stand for.

A revisit with status 304 says that a page has not changed. It is joined as of its
time with the latest strictly earlier complete response (status 200, the one a 304
stands for, RFC 9110) of the same canonical URL.
Its validators are checked: an entity tag (weak comparison), else the date of last
modification. The stored headers are then updated with those the 304 answer may
change; payloads stay where they are and are referred to.

The as-of join works on the distinct (URL, time) points. Time is cut into
equi-depth buckets, at least as many as a shuffle has partitions. The last response of each
bucket is carried to later buckets (one row per URL and bucket), and a window inside the bucket
does the rest: a URL with a third of all captures is spread over the buckets.

Defined results: records without URL or time, or revisits without an earlier response, are
``no_response``; a revisit without validators is ``unverified``, one with other
validators ``mismatch``; none of these is merged. Of responses with the same URL
and time the smallest record id counts, a null one being larger than any other. Repeated revisits are each resolved. Broken
records give nulls.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.operators.ordered import bucket_count, count_below
from loanloom.session import materialize

COMPLETE = 200  # http_status of a response that a revisit can stand for
MEMBER_PIECE = 1 << 16  # bytes of a gzip file looked at together

# fixed values: header fields a 304 answer does not change (RFC 9110, RFC 9111)
UNCHANGED = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te",
    "trailer", "transfer-encoding", "upgrade",
]

RECORD = (
    "kind string, record_id string, target_uri string, captured_at timestamp, profile string, "
    "http_status int, headers map<string,string>, payload binary"
)

# --------------------------------------------------------------------- reading


def _fields(block: bytes) -> dict[str, str]:
    """Header lines as lower-case name -> value; repeated names are joined by commas."""
    found: dict[str, str] = {}
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            name, value = name.strip().lower(), value.strip()
            found[name] = f"{found[name]}, {value}" if name in found else value
    return found


def parse_record(raw: bytes | None) -> dict:
    """One WARC record with its HTTP head taken apart; the date is left as text."""
    empty = dict.fromkeys([c.split()[0] for c in RECORD.split(", ")])
    if not raw or not raw.startswith(b"WARC/"):
        return empty
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head.partition(b"\r\n")[2])
    size = warc.get("content-length", "")
    block = rest[: int(size)] if size.isdigit() else rest
    found = empty | {
        "kind": warc.get("warc-type"),
        "record_id": warc.get("warc-record-id"),
        "target_uri": warc.get("warc-target-uri"),
        "captured_at": warc.get("warc-date"),
        "profile": warc.get("warc-profile"),
    }
    if block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        status, _, lines = http.partition(b"\r\n")
        code = status.split(b" ")[1:2]
        found["http_status"] = int(code[0]) if code and code[0].isdigit() else None
        found["headers"], found["payload"] = _fields(lines), payload
    return found


def parse(raw: DataFrame, record: str = "record") -> DataFrame:
    """``raw`` with its binary column taken apart, see RECORD; other columns are kept behind."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    @F.pandas_udf(RECORD.replace("captured_at timestamp", "captured_at string"))
    def run(records: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([parse_record(r) for r in records], columns=names)
        found["http_status"] = found["http_status"].astype("Int64")
        return found

    parsed = raw.select(run(F.col(record)).alias("r"), *[F.col(f"`{c}`") for c in raw.columns if c not in names])
    date = F.col("r.captured_at").try_cast("timestamp").alias("captured_at")
    fields = [date if n == "captured_at" else F.col(f"r.{n}") for n in names]
    return parsed.select(*fields, *[F.col(f"`{c}`") for c in parsed.columns if c not in ("r", record)])


def _record_end(held: bytearray) -> int | None:
    """Where the record that ``held`` begins with ends, None without a head or a length."""
    end = held.find(b"\r\n\r\n") if held.startswith(b"WARC/") else -1
    size = _fields(bytes(held[:end])).get("content-length", "") if end >= 0 else ""
    return end + 4 + int(size) if size.isdigit() else None


def _member_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a gzip member; bytes between or after them are a record of their own."""
    held, seen, stop = bytearray(), 0, None
    for piece in pieces:
        held += piece
        while held:
            if held[:1] in (b"\r", b"\n"):
                held = held.lstrip(b"\r\n")
            start = held.find(b"WARC/", seen) if stop is None else 0
            if start < 0:
                seen = max(0, len(held) - 4)
                break
            if start > 0:
                yield bytes(held[:start].rstrip(b"\r\n"))
                del held[:start]
                seen = 0
            stop = _record_end(held) if stop is None else stop
            if stop is None or stop > len(held):
                break
            yield bytes(held[:stop])
            del held[:stop]
            seen, stop = 0, None
    if held:
        yield bytes(held.rstrip(b"\r\n"))


def split_records(content: bytes) -> Iterator[bytes]:
    """The records of a WARC file, plain or in gzip members of one or more records."""
    at, view = 0, memoryview(content)

    def pieces(member) -> Iterator[bytes]:
        nonlocal at
        while at < len(content) and not member.eof:
            piece = view[at : at + MEMBER_PIECE]
            found = member.decompress(piece)
            at += len(piece) - len(member.unused_data)
            yield found

    while content[at : at + 2] == b"\x1f\x8b":
        yield from _member_records(pieces(zlib.decompressobj(31)))
    at = content.find(b"WARC/", at)
    while at >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        size = _fields(content[at:end]).get("content-length", "0")
        stop = end + 4 + (int(size) if size.isdigit() else 0)
        yield content[at:stop]
        at = content.find(b"WARC/", stop)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below a path: one binary column ``record``.

    A file is one row of Spark's binary reader, which refuses files over 2 GB.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                for record in split_records(content):
                    yield pd.DataFrame({"record": [record]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "record binary")


# ------------------------------------------------------------------- canonical


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, last slash and tracking fields go; fields are sorted."""
    clean = F.trim(url)
    pattern = r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    host = F.regexp_replace(F.lower(F.regexp_extract(clean, pattern, 1)), r"^www\.|:(80|443)?$", "")
    path = F.regexp_replace(F.regexp_extract(clean, pattern, 2), r"/+$", "")
    fields = F.array_sort(
        F.filter(F.split(F.regexp_extract(clean, pattern, 3), "&"), lambda f: ~f.rlike("^(utm_[^=]*(=.*)?)?$"))
    )
    query = F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise("")
    return F.when(clean.rlike(pattern), F.concat(host, F.coalesce(path, F.lit("")), query)).otherwise(
        F.regexp_replace(clean, "#.*$", "")
    )


# ------------------------------------------------------------------ resolution


def responses_as_of(records: DataFrame) -> DataFrame:
    """For every (canonical_url, captured_at) of a revisit the latest earlier complete response.

    ``records`` has canonical_url, captured_at, kind, record_id, http_status, headers, payload_sha256.
    """
    known = records.where("canonical_url is not null and captured_at is not null")
    full = (F.col("kind") == "response") & (F.col("http_status") == COMPLETE)
    order = F.struct(F.col("record_id").isNull().alias("absent"), "record_id", "payload_sha256")
    answer = F.struct("record_id", "captured_at", "headers", "payload_sha256")
    points = materialize(
        known.groupBy("canonical_url", "captured_at").agg(
            F.min_by(F.when(full, answer), F.when(full, order)).alias("answer"),
            F.max(F.col("kind") == "revisit").alias("asked"),
        ),
        "capture-points",
    )
    seconds = F.unix_micros("captured_at")
    buckets = bucket_count(points)
    shares = [i / buckets for i in range(1, buckets)]
    bounds = points.agg(F.percentile_approx(seconds, shares, max(10_000, 16 * buckets))).first()[0] or []
    edges = F.expr(f"array({', '.join(f'{b}L' for b in bounds or [0])})")
    placed = points.withColumn("bucket", count_below(seconds, edges, len(bounds)))
    lasts = placed.groupBy("canonical_url", "bucket").agg(
        F.max_by("answer", F.when(F.col("answer").isNotNull(), seconds)).alias("last")
    )
    before = W.partitionBy("canonical_url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select(
        "canonical_url", "bucket", F.last("last", ignorenulls=True).over(before).alias("carried")
    )
    inside = (
        W.partitionBy("canonical_url", "bucket").orderBy("captured_at").rowsBetween(W.unboundedPreceding, -1)
    )
    found = placed.join(carried, ["canonical_url", "bucket"]).select(
        "canonical_url",
        "captured_at",
        "asked",
        F.coalesce(F.last("answer", ignorenulls=True).over(inside), "carried").alias("response"),
    )
    return found.where("asked").select("canonical_url", "captured_at", "response")


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.element_at(headers, "etag"), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Every record with its resolution.

    ``records`` has kind, record_id, target_uri, captured_at, http_status, headers and
    payload_sha256. Adds canonical_url, status, response_id, merged headers
    (``stored``) and the payload's digest (``resolved_sha256``); other columns are kept.
    """
    canonical = records.withColumn("canonical_url", canonical_url(F.col("target_uri")))
    is_revisit = (F.col("kind") == "revisit") & (F.col("http_status") == 304)
    asked = canonical.withColumn(
        "kind", F.when(is_revisit, "revisit").when(F.col("kind") == "revisit", "other").otherwise(F.col("kind"))
    )
    found = responses_as_of(asked).withColumnsRenamed(
        {"canonical_url": "point_url", "captured_at": "point_time"}
    )
    joined = asked.join(
        found,
        (F.col("kind") == "revisit")
        & (F.col("canonical_url") == F.col("point_url"))
        & (F.col("captured_at") == F.col("point_time")),
        "left",
    )
    own, old = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.col("response.headers")
    old = F.coalesce(old, F.create_map().cast("map<string,string>"))
    tag, date = _tag(own), F.element_at(own, "last-modified")
    same = F.when(tag.isNotNull(), F.coalesce(tag == _tag(old), F.lit(False))).when(
        date.isNotNull(), F.coalesce(date == F.element_at(old, "last-modified"), F.lit(False))
    )
    status = (
        F.when(F.col("kind") == "response", "full")
        .when(F.col("kind").isNull() | (F.col("kind") != "revisit"), "other")
        .when(F.col("response").isNull(), "no_response")
        .when(same.isNull(), "unverified")
        .when(same, "resolved")
        .otherwise("mismatch")
    )
    changes = F.map_filter(own, lambda k, v: ~k.isin(UNCHANGED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(changes, k)), changes)
    resolved = F.col("status") == "resolved"
    return (
        joined.withColumn("status", status)
        .withColumn("response_id", F.when(resolved, F.col("response.record_id")))
        .withColumn("stored", F.when(resolved, merged).otherwise(F.col("headers")))
        .withColumn(
            "resolved_sha256",
            F.when(resolved, F.col("response.payload_sha256")).when(F.col("status") == "full", F.col("payload_sha256")),
        )
        .drop("point_url", "point_time", "response")
    )
