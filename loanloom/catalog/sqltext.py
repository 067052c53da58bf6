"""SQL fragments shared by the result checks (independent of the Spark code)."""

from __future__ import annotations

from loanloom.catalog.base import r6

EXT = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]

RATIOS = {
    "CREDIT_INCOME_RATIO": "AMT_CREDIT / (AMT_INCOME_TOTAL + 1)",
    "ANNUITY_INCOME_RATIO": "AMT_ANNUITY / (AMT_INCOME_TOTAL + 1)",
    "CREDIT_GOODS_RATIO": "AMT_CREDIT / (AMT_GOODS_PRICE + 1)",
    "INCOME_PER_PERSON": "AMT_INCOME_TOTAL / (CNT_FAM_MEMBERS + 1)",
    "ANNUITY_LENGTH": "AMT_CREDIT / (AMT_ANNUITY + 1)",
}
YEARS = {
    "AGE_YEARS": "-CAST(DAYS_BIRTH AS DOUBLE) / 365",
    "EMPLOYED_YEARS": "-CAST(nullif(DAYS_EMPLOYED, 365243) AS DOUBLE) / 365",
    "EMPLOYED_TO_AGE_RATIO": "(-CAST(nullif(DAYS_EMPLOYED, 365243) AS DOUBLE) / 365)"
    " / (-CAST(DAYS_BIRTH AS DOUBLE) / 365 + 1)",
}
EXT_LIST = "[" + ", ".join(EXT) + "]"
EXT_STATS = {
    "EXT_SOURCE_MEAN": f"list_avg({EXT_LIST})",
    "EXT_SOURCE_STD": f"list_stddev_samp({EXT_LIST})",
    "EXT_SOURCE_MIN": f"list_min({EXT_LIST})",
    "EXT_SOURCE_MAX": f"list_max({EXT_LIST})",
}
COUNTS = {
    "DOCUMENTS_COUNT": "CAST(FLAG_DOCUMENT_2 + FLAG_DOCUMENT_3 AS BIGINT)",
    "CONTACTS_COUNT": "CAST(FLAG_MOBIL + FLAG_PHONE + FLAG_EMAIL AS BIGINT)",
}
DERIVED = {**RATIOS, **YEARS, **EXT_STATS, **COUNTS}

APP_NUMERIC = [
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "AMT_GOODS_PRICE",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "CNT_FAM_MEMBERS",
    "EXT_SOURCE_1",
    "EXT_SOURCE_2",
    "EXT_SOURCE_3",
    "FLAG_DOCUMENT_2",
    "FLAG_DOCUMENT_3",
    "FLAG_MOBIL",
    "FLAG_PHONE",
    "FLAG_EMAIL",
    "OWN_CAR_AGE",
]
APP_STRING = ["NAME_CONTRACT_TYPE", "OCCUPATION_TYPE"]


def select_list(exprs: dict[str, str], integers: tuple[str, ...] = ()) -> str:
    return ", ".join(
        f"{e} AS {n}" if n in integers or n in COUNTS else r6(e, n) for n, e in exprs.items()
    )


def stat_sql(stat: str, expr: str) -> str:
    """One aggregate of an ``aggregate_to_client`` spec."""
    if stat == "sum":
        return f"coalesce(sum({expr}), 0)"
    return {"mean": f"avg({expr})", "max": f"max({expr})", "min": f"min({expr})", "count": f"count({expr})"}[stat]


def client_aggregate(prefix: str, spec: list, source: str, integers: set[str], round_: bool) -> str:
    """SELECT of one per-client table; ``integers`` are the whole-number inputs."""
    cols = []
    for column, stats in spec:
        for stat in stats:
            name = f"{prefix}_{column}_{stat}".upper()
            expr = stat_sql(stat, column)
            whole = stat == "count" or (column in integers and stat != "mean")
            if whole:
                # min and max keep the input's width; sums and counts are 64 bit
                cols.append(f"CAST({expr} AS BIGINT) AS {name}")
            elif round_:
                cols.append(r6(expr, name))
            else:
                cols.append(f"CAST({expr} AS DOUBLE) AS {name}")
    return f"SELECT SK_ID_CURR, {', '.join(cols)} FROM {source} GROUP BY SK_ID_CURR"


def union_long(source: str, columns: list[str], keep: str = "", where: str = "") -> str:
    """Long form (feature, value) of the listed numeric columns."""
    lead = f"{keep}, " if keep else ""
    parts = [
        f"SELECT {lead}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}"
        f" WHERE {c} IS NOT NULL{' AND ' + where if where else ''}"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


def union_text(source: str, columns: list[str], keep: str = "", where: str = "") -> str:
    """Long form of the listed text columns."""
    lead = f"{keep}, " if keep else ""
    parts = [
        f"SELECT {lead}'{c}' AS feature, {c} AS value FROM {source}"
        f" WHERE {c} IS NOT NULL{' AND ' + where if where else ''}"
        for c in columns
    ]
    return " UNION ALL ".join(parts)
