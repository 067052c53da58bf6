"""Feature-table queries: derivations, client aggregates, joins, the wide table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.catalog import sqltext as Q
from loanloom.catalog.base import r6, register, with_tables
from loanloom.operators import aggregates as A
from loanloom.operators import applicant as P
from loanloom.plans.spine import build_spine

ID = K.CLIENT_KEY

# ------------------------------------------------------------------ derivations


@register(
    "p3_financial_ratios",
    with_tables(f"SELECT SK_ID_CURR, {Q.select_list(Q.RATIOS)} FROM app", "app"),
)
def p3(t):
    ratios = P.financial_ratios(t.app.columns)
    return t.app.select(ID, *[c.alias(n) for n, c in ratios.items()])


@register(
    "p4_days_to_years",
    with_tables(
        f"SELECT SK_ID_CURR, {r6('-CAST(DAYS_BIRTH AS DOUBLE) / 365', 'AGE_YEARS')},"
        f" {r6('-CAST(DAYS_EMPLOYED AS DOUBLE) / 365', 'RAW_EMPLOYED_YEARS')},"
        " abs(DAYS_BIRTH) // 365 AS AGE_WHOLE FROM app",
        "app",
    ),
)
def p4(t):
    df = t.app.select(ID, "DAYS_BIRTH", "DAYS_EMPLOYED")
    df = df.withColumns(
        {
            "AGE_YEARS": P.days_to_years("DAYS_BIRTH"),
            "RAW_EMPLOYED_YEARS": P.days_to_years("DAYS_EMPLOYED"),
        }
    )
    return P.whole_years(df, {"AGE_WHOLE": "DAYS_BIRTH"}).drop("DAYS_BIRTH", "DAYS_EMPLOYED")


def _employed(mode: str):
    def build(t):
        years = P.year_columns(t.app.columns, mode)
        return t.app.select(ID, years["EMPLOYED_YEARS"].alias("EMPLOYED_YEARS"))

    return build


register(
    "p5_sentinel_null",
    with_tables(f"SELECT SK_ID_CURR, {r6(Q.YEARS['EMPLOYED_YEARS'], 'EMPLOYED_YEARS')} FROM app", "app"),
)(_employed("null"))
register(
    "p5_sentinel_as_is",
    with_tables(
        f"SELECT SK_ID_CURR, {r6('-CAST(DAYS_EMPLOYED AS DOUBLE) / 365', 'EMPLOYED_YEARS')} FROM app",
        "app",
    ),
)(_employed("as_is"))


@register(
    "p6_employed_to_age",
    with_tables(
        f"SELECT SK_ID_CURR, {r6(Q.YEARS['EMPLOYED_TO_AGE_RATIO'], 'EMPLOYED_TO_AGE_RATIO')} FROM app",
        "app",
    ),
)
def p6(t):
    years = P.year_columns(t.app.columns)
    return t.app.select(ID, years["EMPLOYED_TO_AGE_RATIO"].alias("EMPLOYED_TO_AGE_RATIO"))


@register(
    "p7_external_score_stats",
    with_tables(f"SELECT SK_ID_CURR, {Q.select_list(Q.EXT_STATS)} FROM app", "app"),
)
def p7(t):
    stats = P.external_score_stats(t.app.columns)
    return t.app.select(ID, *[c.alias(n) for n, c in stats.items()])


@register(
    "p8_flag_counts",
    with_tables(f"SELECT SK_ID_CURR, {Q.select_list(Q.COUNTS)} FROM app", "app"),
)
def p8(t):
    counts = P.flag_counts(t.app.columns)
    return t.app.select(ID, *[c.alias(n) for n, c in counts.items()])


@register(
    "p9_guarded_derivation",
    with_tables(
        "SELECT SK_ID_CURR, AMT_INCOME_TOTAL, AMT_CREDIT, DAYS_BIRTH, "
        f"{r6(Q.RATIOS['CREDIT_INCOME_RATIO'], 'CREDIT_INCOME_RATIO')},"
        f" {r6(Q.YEARS['AGE_YEARS'], 'AGE_YEARS')} FROM app",
        "app",
    ),
)
def p9(t):
    return P.application_features(t.app.select(ID, "AMT_INCOME_TOTAL", "AMT_CREDIT", "DAYS_BIRTH"))


@register(
    "p10_payment_lateness",
    with_tables(
        "SELECT SK_ID_CURR, SK_ID_PREV, NUM_INSTALMENT_NUMBER,"
        f" {r6('AMT_PAYMENT - AMT_INSTALMENT', 'PAYMENT_DIFF')},"
        f" {r6('DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT', 'DAYS_LATE')},"
        " CASE WHEN DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT THEN 1 ELSE 0 END AS LATE_PAYMENT"
        " FROM installments_payments",
        "installments_payments",
    ),
)
def p10(t):
    return A.payment_lateness(t.view("installments_payments")).select(
        ID, "SK_ID_PREV", "NUM_INSTALMENT_NUMBER", "PAYMENT_DIFF", "DAYS_LATE", "LATE_PAYMENT"
    )


@register(
    "p11_usage_flags",
    with_tables(
        f"""
SELECT 'pos' AS kind, SK_ID_PREV AS row_id, CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS late,
  CAST(NULL AS DOUBLE) AS utilization FROM pos_cash
UNION ALL
SELECT 'card', SK_ID_CURR, CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END,
  {r6('AMT_BALANCE / (AMT_CREDIT_LIMIT_ACTUAL + 1)', 'utilization')} FROM credit_card""",
        "pos_cash",
        "credit_card",
    ),
)
def p11(t):
    pos = A.pos_flags(t.view("pos_cash")).select(
        F.lit("pos").alias("kind"),
        F.col("SK_ID_PREV").alias("row_id"),
        F.col("POS_LATE").alias("late"),
        F.lit(None).cast("double").alias("utilization"),
    )
    card = A.card_usage(t.view("credit_card")).select(
        F.lit("card").alias("kind"),
        F.col(ID).alias("row_id"),
        F.col("CC_LATE").alias("late"),
        F.col("CC_UTILIZATION").alias("utilization"),
    )
    return pos.unionByName(card)


@register(
    "p12_status_flags",
    with_tables(
        """
SELECT SK_ID_PREV, CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1 ELSE 0 END AS PREV_APPROVED,
  CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END AS PREV_REFUSED
FROM previous_application""",
        "previous_application",
    ),
)
def p12(t):
    return A.status_flags(t.view("previous_application")).select(
        "SK_ID_PREV", "PREV_APPROVED", "PREV_REFUSED"
    )


@register(
    "p24_request_ratios",
    with_tables(
        f"""
SELECT SK_ID_CURR,
  {r6('CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_CREDIT / AMT_INCOME_TOTAL ELSE 0 END', 'CREDIT_INCOME_RATIO')},
  {r6('CASE WHEN AMT_INCOME_TOTAL > 0 THEN AMT_ANNUITY / AMT_INCOME_TOTAL ELSE 0 END', 'ANNUITY_INCOME_RATIO')},
  {r6('coalesce(' + Q.EXT_STATS['EXT_SOURCE_MEAN'] + ', 0.5)', 'EXT_SOURCE_MEAN')} FROM app""",
        "app",
    ),
)
def p24(t):
    return P.fill_request_ratios(t.app).select(
        ID, "CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "EXT_SOURCE_MEAN"
    )


_FILLABLE = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", *Q.EXT]


@register(
    "p25_default_fill",
    with_tables(
        "SELECT SK_ID_CURR, "
        + ", ".join(r6(f"coalesce({c}, {K.DEFAULT_RECORD[c]})", c) for c in _FILLABLE)
        + ", CAST(1 AS INTEGER) AS CNT_CHILDREN FROM app",
        "app",
    ),
)
def p25(t):
    filled = P.fill_defaults(t.app, add_absent=True)
    return filled.select(ID, *_FILLABLE, "CNT_CHILDREN")


# ---------------------------------------------------------------- client tables

BALANCE_SQL = """
SELECT SK_ID_BUREAU, min(MONTHS_BALANCE) AS BB_MONTHS_MIN, max(MONTHS_BALANCE) AS BB_MONTHS_MAX,
  count(*) AS BB_COUNT, count(*) FILTER (WHERE STATUS = 'C') AS BB_STATUS_CLOSED
FROM bureau_balance GROUP BY SK_ID_BUREAU"""


@register(
    "a1_balance_per_credit",
    with_tables(
        "SELECT SK_ID_BUREAU, BB_MONTHS_MIN, BB_MONTHS_MAX, BB_COUNT FROM bb",
        "bureau_balance",
        bb=BALANCE_SQL,
    ),
)
def a1(t):
    return A.balance_per_credit(t.view("bureau_balance")).drop("BB_STATUS_CLOSED")


@register(
    "a2_closed_months",
    with_tables("SELECT SK_ID_BUREAU, BB_STATUS_CLOSED FROM bb", "bureau_balance", bb=BALANCE_SQL),
)
def a2(t):
    return A.balance_per_credit(t.view("bureau_balance")).select("SK_ID_BUREAU", "BB_STATUS_CLOSED")


BUREAU_SPEC = [
    (c, ["mean", "max", "min", "sum"])
    for c in [
        "DAYS_CREDIT",
        "AMT_CREDIT_MAX_OVERDUE",
        "AMT_CREDIT_SUM",
        "AMT_CREDIT_SUM_DEBT",
        "BB_MONTHS_MIN",
        "BB_MONTHS_MAX",
        "BB_COUNT",
        "BB_STATUS_CLOSED",
    ]
] + [("SK_ID_BUREAU", ["count"])]
BUREAU_INT = {"DAYS_CREDIT", "BB_MONTHS_MIN", "BB_MONTHS_MAX", "BB_COUNT", "BB_STATUS_CLOSED"}
JOINED_BUREAU = "SELECT bureau.*, bb.* EXCLUDE (SK_ID_BUREAU) FROM bureau LEFT JOIN bb USING (SK_ID_BUREAU)"


def bureau_sql(round_: bool) -> str:
    return Q.client_aggregate("BUREAU", BUREAU_SPEC, "bureau_bb", BUREAU_INT, round_)


def _widened(df):
    """Whole-number columns as 64 bit, so both engines report one type."""
    whole = ("integer", "short", "byte")
    return df.selectExpr(
        *[
            f"CAST(`{f.name}` AS BIGINT) AS `{f.name}`" if f.dataType.typeName() in whole else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


@register(
    "a3_bureau",
    with_tables(
        bureau_sql(True), "bureau", "bureau_balance", bb=BALANCE_SQL, bureau_bb=JOINED_BUREAU
    ),
)
def a3(t):
    return _widened(A.aggregate_bureau(t.view("bureau"), t.view("bureau_balance")))


PREVIOUS_SPEC = [
    (c, ["mean", "max", "min"]) for c in ["AMT_APPLICATION", "AMT_CREDIT", "AMT_DOWN_PAYMENT"]
] + [("SK_ID_PREV", ["count"]), ("PREV_APPROVED", ["sum"]), ("PREV_REFUSED", ["sum"])]
PREVIOUS_FLAGGED = """
SELECT *, CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1 ELSE 0 END AS PREV_APPROVED,
  CASE WHEN NAME_CONTRACT_STATUS = 'Refused' THEN 1 ELSE 0 END AS PREV_REFUSED FROM previous_application"""


def previous_sql(round_: bool) -> str:
    return Q.client_aggregate(
        "PREV", PREVIOUS_SPEC, "prev_flag", {"PREV_APPROVED", "PREV_REFUSED"}, round_
    )


@register(
    "a4_previous",
    with_tables(previous_sql(True), "previous_application", prev_flag=PREVIOUS_FLAGGED),
)
def a4(t):
    return _widened(A.aggregate_previous(t.view("previous_application")))


INST_DERIVED = """
SELECT *, AMT_PAYMENT - AMT_INSTALMENT AS PAYMENT_DIFF, DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT AS DAYS_LATE,
  CASE WHEN DAYS_ENTRY_PAYMENT > DAYS_INSTALMENT THEN 1 ELSE 0 END AS LATE_PAYMENT FROM installments_payments"""


def installments_sql(round_: bool) -> str:
    return Q.client_aggregate(
        "INST", A.INSTALLMENT_SPEC, "inst_late", {"NUM_INSTALMENT_NUMBER", "LATE_PAYMENT"}, round_
    )


@register(
    "a5_installments",
    with_tables(installments_sql(True), "installments_payments", inst_late=INST_DERIVED),
)
def a5(t):
    return _widened(A.aggregate_installments(t.view("installments_payments")))


POS_DERIVED = "SELECT *, CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS POS_LATE FROM pos_cash"


def pos_sql(round_: bool) -> str:
    return Q.client_aggregate(
        "POS", A.POS_SPEC, "pos_late", {"MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF", "POS_LATE"}, round_
    )


@register("a6_pos_cash", with_tables(pos_sql(True), "pos_cash", pos_late=POS_DERIVED))
def a6(t):
    return _widened(A.aggregate_pos(t.view("pos_cash")))


CARD_DERIVED = """
SELECT *, AMT_BALANCE / (AMT_CREDIT_LIMIT_ACTUAL + 1) AS CC_UTILIZATION,
  CASE WHEN SK_DPD > 0 THEN 1 ELSE 0 END AS CC_LATE FROM credit_card"""


def card_sql(round_: bool) -> str:
    return Q.client_aggregate(
        "CC", A.CARD_SPEC, "cc_use", {"MONTHS_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "CC_LATE", "SK_DPD"}, round_
    )


@register("a7_credit_card", with_tables(card_sql(True), "credit_card", cc_use=CARD_DERIVED))
def a7(t):
    return _widened(A.aggregate_card(t.view("credit_card")))


# --------------------------------------------------------------- the wide table

SPINE_VIEWS = [
    "app",
    "bureau",
    "bureau_balance",
    "previous_application",
    "installments_payments",
    "pos_cash",
    "credit_card",
]
FEATURE_SELECT = "SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in Q.DERIVED.items()) + " FROM app"


def spine_ctes(without: tuple[str, ...] = ()) -> dict[str, str]:
    """Common tables ending in ``spine``; full precision."""
    ctes = {"feat": FEATURE_SELECT}
    joins = ""
    if "bureau" not in without:
        ctes |= {"bb": BALANCE_SQL, "bureau_bb": JOINED_BUREAU, "b_agg": bureau_sql(False)}
        joins += " LEFT JOIN b_agg USING (SK_ID_CURR)"
    if "previous_application" not in without:
        ctes |= {"prev_flag": PREVIOUS_FLAGGED, "p_agg": previous_sql(False)}
        joins += " LEFT JOIN p_agg USING (SK_ID_CURR)"
    if "installments_payments" not in without:
        ctes |= {"inst_late": INST_DERIVED, "i_agg": installments_sql(False)}
        joins += " LEFT JOIN i_agg USING (SK_ID_CURR)"
    if "pos_cash" not in without:
        ctes |= {"pos_late": POS_DERIVED, "s_agg": pos_sql(False)}
        joins += " LEFT JOIN s_agg USING (SK_ID_CURR)"
    if "credit_card" not in without:
        ctes |= {"cc_use": CARD_DERIVED, "c_agg": card_sql(False)}
        joins += " LEFT JOIN c_agg USING (SK_ID_CURR)"
    return ctes | {"spine": f"SELECT * FROM feat{joins}"}


def _agg_columns(prefix: str, spec: list, integers: set[str]) -> list[tuple[str, bool]]:
    return [
        (f"{prefix}_{c}_{s}".upper(), s == "count" or (c in integers and s != "mean"))
        for c, stats in spec
        for s in stats
    ]


SPINE_PARTS = {
    "bureau": _agg_columns("BUREAU", BUREAU_SPEC, BUREAU_INT),
    "previous_application": _agg_columns("PREV", PREVIOUS_SPEC, {"PREV_APPROVED", "PREV_REFUSED"}),
    "installments_payments": _agg_columns(
        "INST", A.INSTALLMENT_SPEC, {"NUM_INSTALMENT_NUMBER", "LATE_PAYMENT"}
    ),
    "pos_cash": _agg_columns(
        "POS", A.POS_SPEC, {"MONTHS_BALANCE", "SK_DPD", "SK_DPD_DEF", "POS_LATE"}
    ),
    "credit_card": _agg_columns(
        "CC", A.CARD_SPEC, {"MONTHS_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "CC_LATE", "SK_DPD"}
    ),
}
WHOLE_APP = {"DAYS_BIRTH", "DAYS_EMPLOYED", "TARGET"} | {c for c in Q.APP_NUMERIC if c.startswith("FLAG_")}


def spine_columns(without: tuple[str, ...] = ()) -> list[tuple[str, bool]]:
    """(name, is whole number) of every numeric column of the wide table but the key."""
    out = [("TARGET", True)] + [(c, c in WHOLE_APP) for c in Q.APP_NUMERIC]
    out += [(c, c in Q.COUNTS) for c in Q.DERIVED]
    for part, cols in SPINE_PARTS.items():
        if part not in without:
            out += cols
    return out


def spine_select(without: tuple[str, ...] = ()) -> str:
    cols = [
        f"CAST({n} AS BIGINT) AS {n}" if whole else r6(n, n) for n, whole in spine_columns(without)
    ]
    return f"SELECT SK_ID_CURR, split, {', '.join(Q.APP_STRING)}, {', '.join(cols)} FROM spine"


@register("a8_spine", with_tables(spine_select(), *SPINE_VIEWS, **spine_ctes()))
def a8(t):
    return _widened(build_spine(t.loan_tables()).table)


@register(
    "j1_bureau_with_balance",
    with_tables(
        f"""
SELECT SK_ID_BUREAU, SK_ID_CURR, CREDIT_ACTIVE, DAYS_CREDIT,
  {r6('AMT_CREDIT_MAX_OVERDUE', 'AMT_CREDIT_MAX_OVERDUE')}, {r6('AMT_CREDIT_SUM', 'AMT_CREDIT_SUM')},
  {r6('AMT_CREDIT_SUM_DEBT', 'AMT_CREDIT_SUM_DEBT')}, BB_MONTHS_MIN, BB_MONTHS_MAX, BB_COUNT, BB_STATUS_CLOSED
FROM bureau_bb""",
        "bureau",
        "bureau_balance",
        bb=BALANCE_SQL,
        bureau_bb=JOINED_BUREAU,
    ),
)
def j1(t):
    return A.bureau_with_balance(t.view("bureau"), t.view("bureau_balance"))


@register(
    "j2_client_joins",
    with_tables(
        f"""
SELECT SK_ID_CURR, split, BUREAU_SK_ID_BUREAU_COUNT, PREV_SK_ID_PREV_COUNT, INST_LATE_PAYMENT_SUM,
  POS_SK_DPD_SUM, {r6('CC_AMT_PAYMENT_CURRENT_SUM', 'CC_AMT_PAYMENT_CURRENT_SUM')} FROM spine""",
        *SPINE_VIEWS,
        **spine_ctes(),
    ),
)
def j2(t):
    wide = build_spine(t.loan_tables()).table
    return wide.select(
        ID,
        "split",
        "BUREAU_SK_ID_BUREAU_COUNT",
        "PREV_SK_ID_PREV_COUNT",
        "INST_LATE_PAYMENT_SUM",
        "POS_SK_DPD_SUM",
        "CC_AMT_PAYMENT_CURRENT_SUM",
    )


_ABSENT = ("bureau", "credit_card")


@register(
    "j3_optional_enrichment",
    with_tables(spine_select(_ABSENT), *SPINE_VIEWS, **spine_ctes(_ABSENT)),
)
def j3(t):
    tables = {n: d for n, d in t.loan_tables().items() if n not in _ABSENT}
    return _widened(build_spine(tables).table)


def md5_rank(seed: int, strata: str = "") -> str:
    """Rank of a client in hash order, within the strata."""
    part = f"PARTITION BY {strata} " if strata else ""
    return (
        f"row_number() OVER ({part}ORDER BY md5(CAST(SK_ID_CURR AS VARCHAR) || ':{seed}'), SK_ID_CURR)"
    )


@register(
    "a8_spine_sampled",
    with_tables(
        spine_select()
        + " WHERE SK_ID_CURR IN (SELECT SK_ID_CURR FROM ranked WHERE rk <= round_even(n * 0.3, 0))",
        *SPINE_VIEWS,
        **spine_ctes(),
        ranked=f"SELECT SK_ID_CURR, {md5_rank(42, 'split')} AS rk, count(*) OVER (PARTITION BY split) AS n FROM app",
    ),
)
def a8_sampled(t):
    return _widened(build_spine(t.loan_tables(), sample_frac=0.3).table)

