"""Declared column types of the loan tables."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# --- Fixed values: column types of the source files -------------------------------
KNOWN_TYPES = {
    "SK_ID_CURR": "long",
    "SK_ID_BUREAU": "long",
    "SK_ID_PREV": "long",
    "TARGET": "int",
    "DAYS_BIRTH": "long",
    "DAYS_EMPLOYED": "long",
    "DAYS_ID_PUBLISH": "long",
    "CNT_CHILDREN": "long",
    "REGION_RATING_CLIENT": "long",
    "REGION_RATING_CLIENT_W_CITY": "long",
    "HOUR_APPR_PROCESS_START": "long",
    "NFLAG_LAST_APPL_IN_DAY": "long",
    "DAYS_CREDIT": "long",
    "CREDIT_DAY_OVERDUE": "long",
    "CNT_CREDIT_PROLONG": "long",
    "MONTHS_BALANCE": "int",
    "NUM_INSTALMENT_VERSION": "double",
    "NUM_INSTALMENT_NUMBER": "long",
    "SK_DPD": "long",
    "SK_DPD_DEF": "long",
    "AMT_CREDIT_LIMIT_ACTUAL": "long",
    "FLAG_OWN_CAR": "string",
    "FLAG_OWN_REALTY": "string",
    "FLAG_LAST_APPL_PER_CONTRACT": "string",
}
# name patterns for the columns not listed above, first match wins
NAME_RULES = [
    (r"^FLAG_", "int"),
    (r"^(NAME_|CODE_)|_TYPE$|_STATUS$|^STATUS$|^CREDIT_ACTIVE$|^CREDIT_CURRENCY$", "string"),
    (r"^WEEKDAY_|_MODE_TEXT$|^FONDKAPREMONT_MODE$|^HOUSETYPE_MODE$|^WALLSMATERIAL_MODE$|^EMERGENCYSTATE_MODE$", "string"),
    (r"^(REG|LIVE)_", "int"),
    (r"^(AMT|CNT|DAYS|EXT_SOURCE|RATE|REGION_POPULATION|OBS|DEF|OWN_CAR)_", "double"),
    (r"_(AVG|MODE|MEDI)$", "double"),
]


def column_type(name: str) -> str | None:
    """Declared type of a column; None when no rule names it."""
    if name in KNOWN_TYPES:
        return KNOWN_TYPES[name]
    for pattern, kind in NAME_RULES:
        if re.search(pattern, name):
            return kind
    return None


_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
}


def schema_for(columns: list[str], overrides: dict[str, str] | None = None) -> T.StructType:
    """Types of the columns that a rule or an override names."""
    kinds = {c: (overrides or {}).get(c) or column_type(c) for c in columns}
    return T.StructType([T.StructField(c, _TYPES[k]) for c, k in kinds.items() if k])
