"""Derived columns of an application row; one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G


# Fixed values: (output, numerator, denominator)
RATIOS = [
    ("CREDIT_INCOME_RATIO", "AMT_CREDIT", "AMT_INCOME_TOTAL"),
    ("ANNUITY_INCOME_RATIO", "AMT_ANNUITY", "AMT_INCOME_TOTAL"),
    ("CREDIT_GOODS_RATIO", "AMT_CREDIT", "AMT_GOODS_PRICE"),
    ("INCOME_PER_PERSON", "AMT_INCOME_TOTAL", "CNT_FAM_MEMBERS"),
    ("ANNUITY_LENGTH", "AMT_CREDIT", "AMT_ANNUITY"),
]


def financial_ratios(columns: list[str]) -> dict[str, Column]:
    """a / (b + 1) for every pair whose inputs exist."""
    have = set(columns)
    return {
        name: G.ratio(F.col(a), F.col(b))
        for name, a, b in RATIOS
        if a in have and b in have
    }


def days_to_years(column: str) -> Column:
    """Negative day offset to elapsed years."""
    return -G.dbl(F.col(column)) / F.lit(float(K.DAYS_PER_YEAR))


def employed_days(sentinel: str = "null") -> Column:
    """Employment offset with the "no employment" marker nulled, or kept as it is.

    ``as_is`` reproduces the published numbers, in which the marker reaches
    the year column as about -1000.67.
    """
    if sentinel == "as_is":
        return F.col("DAYS_EMPLOYED")
    if sentinel == "null":
        return F.nullif(F.col("DAYS_EMPLOYED"), F.lit(K.EMPLOYED_SENTINEL))
    raise ValueError(f"unknown sentinel mode: {sentinel!r}")


def year_columns(columns: list[str], sentinel: str = "null") -> dict[str, Column]:
    """Age and employment in years, and their ratio."""
    out: dict[str, Column] = {}
    if "DAYS_BIRTH" in columns:
        out["AGE_YEARS"] = days_to_years("DAYS_BIRTH")
    if "DAYS_EMPLOYED" in columns:
        out["EMPLOYED_YEARS"] = -G.dbl(employed_days(sentinel)) / F.lit(float(K.DAYS_PER_YEAR))
    if len(out) == 2:
        out["EMPLOYED_TO_AGE_RATIO"] = G.ratio(out["EMPLOYED_YEARS"], out["AGE_YEARS"])
    return out


def external_score_stats(columns: list[str]) -> dict[str, Column]:
    """Row-wise mean, sample deviation, min and max of the available scores."""
    cols = [F.col(c) for c in K.EXTERNAL_SCORES if c in columns]
    if not cols:
        return {}
    return {
        "EXT_SOURCE_MEAN": G.row_mean(cols),
        "EXT_SOURCE_STD": G.row_std(cols),
        "EXT_SOURCE_MIN": G.row_min(cols),
        "EXT_SOURCE_MAX": G.row_max(cols),
    }


def flag_counts(columns: list[str]) -> dict[str, Column]:
    """How many documents were handed in and how many contacts are known."""
    documents = [F.col(c) for c in columns if c.startswith(K.DOCUMENT_PREFIX)]
    contacts = [F.col(c) for c in K.CONTACT_FLAGS if c in columns]
    out: dict[str, Column] = {}
    if documents:
        out["DOCUMENTS_COUNT"] = G.row_sum(documents).cast("bigint")
    if contacts:
        out["CONTACTS_COUNT"] = G.row_sum(contacts).cast("bigint")
    return out


def application_features(df: DataFrame, sentinel: str = "null") -> DataFrame:
    """All derived application columns; a derivation whose inputs are absent is left out."""
    cols = df.columns
    derived = {
        **financial_ratios(cols),
        **year_columns(cols, sentinel),
        **external_score_stats(cols),
        **flag_counts(cols),
    }
    return df.withColumns(derived)


def fill_request_ratios(df: DataFrame) -> DataFrame:
    """Complete request records: ratios and score mean only where they are absent.

    Differs from :func:`application_features`: plain denominators, 0 for a
    non-positive income and 0.5 when no external score is known.
    """
    have = set(df.columns)

    def given(name: str) -> Column:
        return F.col(name).cast("double") if name in have else F.lit(None).cast("double")

    def or_default(name: str, default: float) -> Column:
        # an absent column takes the default, a NULL in a present one stays NULL
        return F.col(name) if name in have else F.lit(default)

    income = or_default("AMT_INCOME_TOTAL", 1.0)

    def share(amount: str) -> Column:
        return F.when(income > 0, G.safe_div(or_default(amount, 0.0), income)).otherwise(F.lit(0.0))

    scores = [or_default(c, 0.5) for c in K.EXTERNAL_SCORES]
    return df.withColumns(
        {
            "CREDIT_INCOME_RATIO": F.coalesce(given("CREDIT_INCOME_RATIO"), share("AMT_CREDIT")),
            "ANNUITY_INCOME_RATIO": F.coalesce(given("ANNUITY_INCOME_RATIO"), share("AMT_ANNUITY")),
            "EXT_SOURCE_MEAN": F.coalesce(
                given("EXT_SOURCE_MEAN"), G.row_mean(scores), F.lit(0.5)
            ),
        }
    )


def fill_defaults(df: DataFrame, defaults: dict | None = None, add_absent: bool = False) -> DataFrame:
    """NULLs take the default record's value; optionally add absent columns."""
    defaults = K.DEFAULT_RECORD if defaults is None else defaults
    types = dict(df.dtypes)
    filled = {
        name: F.coalesce(F.col(name), F.lit(value).cast(types[name]))
        for name, value in defaults.items()
        if name in types
    }
    if add_absent:
        filled |= {n: F.lit(v) for n, v in defaults.items() if n not in types}
    return df.withColumns(filled)


def whole_years(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Completed years from day offsets: ``{output: input}``."""
    return df.withColumns(
        {out: F.expr(f"abs(cast(`{c}` as bigint)) div {K.DAYS_PER_YEAR}") for out, c in columns.items()}
    )
