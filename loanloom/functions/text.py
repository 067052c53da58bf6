"""Text helpers: slugs, multi-tag values, row signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S


def slug(text: Column) -> Column:
    """Lower-case key with runs of other characters as one underscore."""
    joined = F.regexp_replace(text, r"[^a-zA-Z0-9]+", "_")
    return F.lower(F.regexp_replace(joined, r"^_+|_+$", ""))


def bracketed(value: Column) -> Column:
    """Is the value wrapped in square or round brackets?"""
    return (value.startswith("[") & value.endswith("]")) | (
        value.startswith("(") & value.endswith(")")
    )


def tags_of(value: Column, delimiter: str) -> Column:
    """Tags of one value: brackets stripped, split, trimmed, empty ones dropped."""
    clean = F.trim(value)
    inner = F.when(
        bracketed(clean) & (F.length(clean) >= 2),
        F.substring(clean, F.lit(2), F.length(clean) - 2),
    ).otherwise(clean)
    parts = F.split(inner, r"\Q" + delimiter + r"\E", -1)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def delimiter_profile(df: DataFrame, column: str) -> DataFrame:
    """Per delimiter: values that contain it and the tags they hold, in one pass."""
    v = S.quoted(column).cast("string")
    wide = df.agg(
        *[
            F.struct(
                F.count_if(v.contains(d)).alias("with_delimiter"),
                F.sum(F.when(v.contains(d), F.size(tags_of(v, d)))).alias("tags"),
            ).alias(f"_d{i}")
            for i, d in enumerate(K.TAG_DELIMITERS)
        ],
        F.count_if(bracketed(v)).alias("bracketed"),
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"),
                F.lit(d).alias("delimiter"),
                F.col(f"_d{i}.with_delimiter").alias("with_delimiter"),
                F.col(f"_d{i}.tags").alias("tags"),
            )
            for i, d in enumerate(K.TAG_DELIMITERS)
        ]
    )
    return wide.select("bracketed", F.explode(cells).alias("c")).select(
        "bracketed",
        "c.*",
        G.safe_div(F.col("c.tags"), F.col("c.with_delimiter")).alias("tags_per_value"),
    )


def detect_delimiter(df: DataFrame, column: str) -> str | None:
    """The first delimiter that really splits the column, or ``,`` for bracketed lists.

    Needs at least 3 values with the delimiter, 1.5 tags per such value and 3
    different tags.
    """
    rows = delimiter_profile(df, column).orderBy("rank").collect()  # one row per delimiter
    for row in rows:
        if row["with_delimiter"] < 3 or (row["tags_per_value"] or 0) < 1.5:
            continue
        v = S.quoted(column).cast("string")
        with_it = df.where(v.contains(row["delimiter"]))
        different = tag_frequency(with_it, column, row["delimiter"]).limit(3).count()
        if different >= 3:
            return row["delimiter"]
    return "," if rows and rows[0]["bracketed"] > 0 else None


def tag_frequency(df: DataFrame, column: str, delimiter: str | None) -> DataFrame:
    """Rows per tag; without a delimiter the whole value is one tag."""
    v = S.quoted(column).cast("string")
    tags = tags_of(v, delimiter) if delimiter else F.array(F.trim(v))
    # the outer form keeps Spark from splitting every value twice (once to filter)
    return (
        df.where(v.isNotNull())
        .select(F.explode_outer(tags).alias("tag"))
        .where(F.col("tag").isNotNull())
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def row_signature(columns: list[str]) -> Column:
    """Digest of a record that does not depend on column order."""
    return F.sha2(row_json(columns), 256)


def row_json(columns: list[str]) -> Column:
    """JSON of a record with sorted keys; NULL fields are kept."""
    return F.to_json(
        F.struct(*[S.quoted(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}
    )
