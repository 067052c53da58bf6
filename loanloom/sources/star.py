"""Loan tables derived from a generic star schema of parquet files.

The text of every view runs unchanged on Spark and on the SQL engine the
results are checked against.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[list[str], str]] = {
    "app": (
        ["customer"],
        """
SELECT c_custkey AS SK_ID_CURR,
  CASE WHEN c_custkey % 5 = 4 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN c_custkey % 5 = 4 THEN NULL WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS TARGET,
  CASE WHEN c_custkey % 3 = 0 THEN 'Revolving loans' ELSE 'Cash loans' END AS NAME_CONTRACT_TYPE,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS OCCUPATION_TYPE,
  CAST(25000 + (c_custkey * 131) % 300000 AS DOUBLE) AS AMT_INCOME_TOTAL,
  CAST(50000 + (c_custkey * 977) % 900000 AS DOUBLE) AS AMT_CREDIT,
  CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(5000 + (c_custkey * 61) % 45000 AS DOUBLE) END AS AMT_ANNUITY,
  CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE CAST(45000 + (c_custkey * 953) % 850000 AS DOUBLE) END AS AMT_GOODS_PRICE,
  CAST(-(7300 + (c_custkey * 17) % 17700) AS BIGINT) AS DAYS_BIRTH,
  CAST(CASE WHEN c_custkey % 6 = 0 THEN 365243 ELSE -((c_custkey * 29) % 10000) END AS BIGINT) AS DAYS_EMPLOYED,
  CAST(1 + c_custkey % 5 AS DOUBLE) AS CNT_FAM_MEMBERS,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 1000 AS DOUBLE) / 1000 END AS EXT_SOURCE_1,
  CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE CAST((c_custkey * 53) % 1000 AS DOUBLE) / 1000 END AS EXT_SOURCE_2,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST((c_custkey * 71) % 1000 AS DOUBLE) / 1000 END AS EXT_SOURCE_3,
  CAST(c_custkey % 2 AS INTEGER) AS FLAG_DOCUMENT_2, CAST(c_custkey % 3 % 2 AS INTEGER) AS FLAG_DOCUMENT_3,
  1 AS FLAG_MOBIL, CAST(c_custkey % 4 % 2 AS INTEGER) AS FLAG_PHONE, CAST(c_custkey % 11 % 2 AS INTEGER) AS FLAG_EMAIL,
  CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 20 AS DOUBLE) END AS OWN_CAR_AGE
FROM customer""",
    ),
    "bureau": (
        ["orders"],
        """
SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR, o_orderstatus AS CREDIT_ACTIVE,
  CAST(-(o_orderkey % 2900) AS BIGINT) AS DAYS_CREDIT,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 31 AS DOUBLE) END AS AMT_CREDIT_MAX_OVERDUE,
  o_totalprice AS AMT_CREDIT_SUM,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice / 4 END AS AMT_CREDIT_SUM_DEBT
FROM orders WHERE o_custkey % 10 <> 3""",
    ),
    "bureau_balance": (
        ["lineitem"],
        """
SELECT l_orderkey AS SK_ID_BUREAU, CAST(-l_linenumber AS INTEGER) AS MONTHS_BALANCE,
  CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'N' THEN '0' ELSE 'X' END AS STATUS FROM lineitem""",
    ),
    "previous_application": (
        ["orders"],
        """
SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
  CASE o_orderstatus WHEN 'F' THEN 'Approved' WHEN 'O' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS,
  o_totalprice AS AMT_APPLICATION, o_totalprice * CAST(0.5 AS DOUBLE) AS AMT_CREDIT,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice / 8 END AS AMT_DOWN_PAYMENT
FROM orders""",
    ),
    "installments_payments": (
        ["lineitem", "orders"],
        """
SELECT o_custkey AS SK_ID_CURR, l_orderkey AS SK_ID_PREV, CAST(l_linenumber % 3 AS DOUBLE) AS NUM_INSTALMENT_VERSION,
  l_linenumber AS NUM_INSTALMENT_NUMBER, CAST(-(l_orderkey % 2900) AS DOUBLE) AS DAYS_INSTALMENT,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(-(l_orderkey % 2900) + (l_linenumber - 4) AS DOUBLE) END AS DAYS_ENTRY_PAYMENT,
  l_extendedprice AS AMT_INSTALMENT,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS AMT_PAYMENT
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "pos_cash": (
        ["events"],
        """
SELECT user_id AS SK_ID_CURR, event_id AS SK_ID_PREV, CAST(-(event_id % 96) AS INTEGER) AS MONTHS_BALANCE,
  CASE WHEN event_id % 33 = 0 THEN NULL ELSE CAST(12 + event_id % 48 AS DOUBLE) END AS CNT_INSTALMENT,
  CASE WHEN event_id % 33 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) END AS CNT_INSTALMENT_FUTURE,
  CAST(CASE WHEN event_type = 'error' THEN event_id % 30 ELSE 0 END AS BIGINT) AS SK_DPD,
  CAST(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN event_id % 30 ELSE 0 END AS BIGINT) AS SK_DPD_DEF
FROM events""",
    ),
    "credit_card": (
        ["events"],
        """
SELECT user_id AS SK_ID_CURR, CAST(-(event_id % 96) AS INTEGER) AS MONTHS_BALANCE, value AS AMT_BALANCE,
  CAST((event_id % 10) * 100 AS BIGINT) AS AMT_CREDIT_LIMIT_ACTUAL,
  CASE WHEN user_id % 2 = 0 THEN NULL ELSE value / 2 END AS AMT_DRAWINGS_CURRENT,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 3 END AS AMT_PAYMENT_CURRENT,
  CAST(event_id % 7 % 3 AS BIGINT) AS SK_DPD
FROM events WHERE event_type = 'purchase'""",
    ),
    "scored": (
        ["events"],
        """
SELECT event_id AS SK_ID_CURR, ts, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS TARGET,
  CAST((event_id * 7919) % 81 + CASE WHEN event_type = 'error' THEN 20 ELSE 0 END AS DOUBLE) / 100 AS proba
FROM events""",
    ),
}


class StarTables:
    """Loan tables over one folder of star-schema parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    def view(self, name: str) -> DataFrame:
        inputs, text = VIEWS[name]
        for table in inputs:
            self.raw(table).createOrReplaceTempView(table)
        return self.spark.sql(text)

    @cached_property
    def app(self) -> DataFrame:
        return self.view("app")

    @cached_property
    def train(self) -> DataFrame:
        return self.app.where("split = 'train'").drop("split")

    @cached_property
    def scored(self) -> DataFrame:
        return self.view("scored")

    def loan_tables(self) -> dict[str, DataFrame]:
        """Every table the wide client table is built from, by name."""
        names = [
            "app",
            "bureau",
            "bureau_balance",
            "previous_application",
            "installments_payments",
            "pos_cash",
            "credit_card",
        ]
        return {n: self.view(n) for n in names}
