"""Token counts from an exact histogram of encoded lengths.

Every text is encoded once, whole; documents are then only rows (length, how
many). Sums up to and beyond each length answer every question about totals,
quantiles and texts cut to a context: for any limit the tokens that remain
are those of the texts up to it, plus the limit for each longer text.

The sums go over blocks of LENGTHS lengths first and then inside each block,
so no task holds the whole histogram.

Defined results: a null or empty text has length 0; an empty table has no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.session import materialize

LENGTHS = 256


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The encoded length of every row of ``docs``."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        own = tokenizer(path, pattern)
        return pd.Series([len(own.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return docs.select(count(F.col(text).cast("string")).alias("length"))


def histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs), one row per length that occurs."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """One row per length that occurs, taken as a context limit.

    docs_upto, tokens_upto: texts that fit; docs_over, tokens_over: longer
    ones; truncated_tokens: what is left if each text is cut to the limit; share_fit:
    the part of texts that fit, so the limit is the quantile of each share up to it.
    """
    # used twice: write the few rows instead of encoding all texts again
    rows = materialize(counts, "length-counts").select(
        "length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens")
    ).withColumn("block", F.floor(F.col("length") / LENGTHS))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    # one row per block of lengths
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    after = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("d").over(everything).alias("total_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    longer = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, -1)
    summed = rows.join(after, "block").select(
        F.col("length").alias("context"),
        "n_docs",
        "n_tokens",
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("docs_later")).alias("docs_over"),
        (F.coalesce(F.sum("n_tokens").over(longer), F.lit(0)) + F.col("tokens_later")).alias("tokens_over"),
        "total_docs",
        "total_tokens",
    )
    return summed.select(
        "context",
        "n_docs",
        "n_tokens",
        (F.col("total_docs") - F.col("docs_over")).alias("docs_upto"),
        "docs_over",
        (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_upto"),
        "tokens_over",
        (F.col("total_tokens") - F.col("tokens_over") + F.col("context") * F.col("docs_over")).alias(
            "truncated_tokens"
        ),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("share_fit"),
        "total_docs",
        "total_tokens",
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Texts that fit and tokens that remain for any context limits, also between lengths."""
    lit = [F.struct(F.lit(int(x)).cast("long").alias("context")) for x in limits]
    pairs = sums.select(F.explode(F.array(*lit)).alias("x"), F.struct("*").alias("s"))
    fits = F.col("s.context") <= F.col("x.context")
    cut = F.when(fits, F.col("s.n_tokens")).otherwise(F.col("x.context") * F.col("s.n_docs"))
    return pairs.groupBy(F.col("x.context").alias("context")).agg(
        F.sum(F.when(fits, F.col("s.n_docs")).otherwise(0)).alias("docs_upto"),
        F.sum(cut).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the texts does not exceed."""
    lit = [F.lit(float(x)) for x in shares]
    pairs = sums.select(F.explode(F.array(*lit)).alias("share"), "context", "docs_upto", "total_docs")
    reached = pairs.where(F.col("docs_upto") >= F.col("share") * F.col("total_docs"))
    return reached.groupBy("share").agg(F.min("context").alias("length"))
