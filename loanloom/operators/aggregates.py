"""Fact tables reduced to one row per client.

All statistics are algebraic, so Spark combines them before the shuffle: a
client that owns a large part of a table sends one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S

Spec = list[tuple[str, list[str]]]


# a group without any value sums to 0
STATS = {
    "mean": "avg(`{0}`)",
    "max": "max(`{0}`)",
    "min": "min(`{0}`)",
    "sum": "coalesce(sum(`{0}`), 0)",
    "count": "count(`{0}`)",
}


def aggregate_to_client(df: DataFrame, key: str, spec: Spec, prefix: str) -> DataFrame:
    """One row per key with columns ``<PREFIX>_<COLUMN>_<STAT>``."""
    exprs = []
    for column, stats in spec:
        for stat in stats:
            name = f"{prefix}_{column}_{stat}".upper()
            exprs.append(F.expr(f"{STATS[stat].format(column)} AS `{name}`"))
    return df.groupBy(key).agg(*exprs)


def balance_per_credit(balance: DataFrame) -> DataFrame:
    """Month range, row count and closed months of each external credit."""
    return balance.groupBy(K.BUREAU_KEY).agg(
        F.min("MONTHS_BALANCE").alias("BB_MONTHS_MIN"),
        F.max("MONTHS_BALANCE").alias("BB_MONTHS_MAX"),
        F.count(F.lit(1)).alias("BB_COUNT"),
        F.count_if(F.col("STATUS") == "C").alias("BB_STATUS_CLOSED"),
    )


def bureau_with_balance(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """External credits with their balance summary; credits without one keep NULLs."""
    return bureau.join(balance_per_credit(balance), K.BUREAU_KEY, "left")


_BALANCE_COLUMNS = ["BB_MONTHS_MIN", "BB_MONTHS_MAX", "BB_COUNT", "BB_STATUS_CLOSED"]


def aggregate_bureau(
    bureau: DataFrame,
    balance: DataFrame | None,
    columns: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """External credits per client: mean/max/min/sum of the numeric columns, and a count.

    The balance summary counts as further numeric columns at the end; the
    balance table is only read when one of them is selected. ``limit`` keeps the first
    columns only; the published model was fitted with 10.
    """
    if columns is None:
        own = S.numeric_columns(bureau, (K.CLIENT_KEY, K.BUREAU_KEY))
        columns = (own + (_BALANCE_COLUMNS if balance is not None else []))[:limit]
    if balance is not None and set(columns) & set(_BALANCE_COLUMNS):
        bureau = bureau_with_balance(bureau, balance)
    spec: Spec = [(c, ["mean", "max", "min", "sum"]) for c in columns]
    return aggregate_to_client(bureau, K.CLIENT_KEY, [*spec, (K.BUREAU_KEY, ["count"])], "BUREAU")


def status_flags(previous: DataFrame) -> DataFrame:
    status = F.col("NAME_CONTRACT_STATUS")
    return previous.withColumns(
        {
            "PREV_APPROVED": G.flag(status == "Approved"),
            "PREV_REFUSED": G.flag(status == "Refused"),
        }
    )


def aggregate_previous(
    previous: DataFrame, columns: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Earlier applications per client, with approved and refused counts.

    ``limit`` keeps the first numeric columns only; the published model was fitted with 8.
    """
    if columns is None:
        columns = S.numeric_columns(previous, (K.CLIENT_KEY, K.PREVIOUS_KEY))[:limit]
    spec: Spec = [(c, ["mean", "max", "min"]) for c in columns]
    spec += [(K.PREVIOUS_KEY, ["count"]), ("PREV_APPROVED", ["sum"]), ("PREV_REFUSED", ["sum"])]
    return aggregate_to_client(status_flags(previous), K.CLIENT_KEY, spec, "PREV")


def payment_lateness(installments: DataFrame) -> DataFrame:
    """Paid minus due amount, days late and a late flag (unknown counts as on time)."""
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return installments.withColumns(
        {
            "PAYMENT_DIFF": F.col("AMT_PAYMENT") - F.col("AMT_INSTALMENT"),
            "DAYS_LATE": late,
            "LATE_PAYMENT": G.flag(late > 0),
        }
    )


INSTALLMENT_SPEC: Spec = [
    ("NUM_INSTALMENT_VERSION", ["mean", "max"]),
    ("NUM_INSTALMENT_NUMBER", ["max"]),
    ("DAYS_LATE", ["mean", "max", "sum"]),
    ("PAYMENT_DIFF", ["mean", "sum"]),
    ("LATE_PAYMENT", ["sum", "mean"]),
    ("AMT_PAYMENT", ["mean", "sum"]),
]


def aggregate_installments(installments: DataFrame) -> DataFrame:
    return aggregate_to_client(
        payment_lateness(installments), K.CLIENT_KEY, INSTALLMENT_SPEC, "INST"
    )


POS_SPEC: Spec = [
    ("MONTHS_BALANCE", ["mean", "max"]),
    ("SK_DPD", ["mean", "max", "sum"]),
    ("SK_DPD_DEF", ["mean", "max", "sum"]),
    ("POS_LATE", ["sum", "mean"]),
    ("CNT_INSTALMENT", ["mean", "max"]),
    ("CNT_INSTALMENT_FUTURE", ["mean", "min"]),
]


def pos_flags(pos: DataFrame) -> DataFrame:
    return pos.withColumn("POS_LATE", G.flag(F.col("SK_DPD") > 0))


def aggregate_pos(pos: DataFrame) -> DataFrame:
    return aggregate_to_client(pos_flags(pos), K.CLIENT_KEY, POS_SPEC, "POS")


CARD_SPEC: Spec = [
    ("MONTHS_BALANCE", ["mean", "max"]),
    ("AMT_BALANCE", ["mean", "max"]),
    ("AMT_CREDIT_LIMIT_ACTUAL", ["mean", "max"]),
    ("AMT_DRAWINGS_CURRENT", ["mean", "sum"]),
    ("AMT_PAYMENT_CURRENT", ["mean", "sum"]),
    ("CC_UTILIZATION", ["mean", "max"]),
    ("CC_LATE", ["sum", "mean"]),
    ("SK_DPD", ["mean", "max"]),
]


def card_usage(card: DataFrame) -> DataFrame:
    """Balance over limit and a late flag."""
    return card.withColumns(
        {
            "CC_UTILIZATION": G.ratio(F.col("AMT_BALANCE"), F.col("AMT_CREDIT_LIMIT_ACTUAL")),
            "CC_LATE": G.flag(F.col("SK_DPD") > 0),
        }
    )


def aggregate_card(card: DataFrame) -> DataFrame:
    return aggregate_to_client(card_usage(card), K.CLIENT_KEY, CARD_SPEC, "CC")
