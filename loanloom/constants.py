"""Fixed values of the credit-scoring domain, stated as plain text."""

# --- Fixed values: keys, label and sentinel -------------------------------
CLIENT_KEY = "SK_ID_CURR"
BUREAU_KEY = "SK_ID_BUREAU"
PREVIOUS_KEY = "SK_ID_PREV"
TARGET = "TARGET"
EMPLOYED_SENTINEL = 365243
DAYS_PER_YEAR = 365
MISSING_CLASS = "MISSING"

# --- Fixed values: business cost and thresholds ---------------------------
COST_FN = 10
COST_FP = 1
SINGLE_FALLBACK_THRESHOLD = 0.44
BATCH_FALLBACK_THRESHOLD = 0.5
MAX_REQUEST_CLIENTS = 1000

# --- Fixed values: decision and risk wording ------------------------------
ACCEPTED = "ACCEPTÉ"
REFUSED = "REFUSÉ"
GRANTED_WORD = "ACCORDÉ"
RISK_LABELS = ["Très faible", "Faible", "Modéré", "Élevé", "Très élevé"]
RISK_EDGES = [0.2, 0.4, 0.6, 0.8]
RAISES_RISK = "augmente le risque"
LOWERS_RISK = "diminue le risque"
NEUTRAL_RISK = "neutre"
LOWERING_WORDS = ["diminue", "baisse", "réduit", "reduit", "decrease", "lower", "negative"]
RAISING_WORDS = ["augmente", "hausse", "increase", "raise", "positive"]

# --- Fixed values: column families ----------------------------------------
EXTERNAL_SCORES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]
CONTACT_FLAGS = [
    "FLAG_MOBIL",
    "FLAG_EMP_PHONE",
    "FLAG_WORK_PHONE",
    "FLAG_CONT_MOBILE",
    "FLAG_PHONE",
    "FLAG_EMAIL",
]
DOCUMENT_PREFIX = "FLAG_DOCUMENT"
AGGREGATE_PREFIXES = ["BUREAU_", "PREV_", "INST_", "POS_", "CC_"]

# --- Fixed values: default client record ----------------------------------
DEFAULT_RECORD = {
    "AMT_INCOME_TOTAL": 150000.0,
    "AMT_CREDIT": 500000.0,
    "AMT_ANNUITY": 25000.0,
    "AMT_GOODS_PRICE": 450000.0,
    "DAYS_BIRTH": -12775,
    "DAYS_EMPLOYED": -1825,
    "CNT_CHILDREN": 1,
    "CODE_GENDER_M": 1,
    "FLAG_OWN_CAR": 1,
    "FLAG_OWN_REALTY": 1,
    "EXT_SOURCE_1": 0.5,
    "EXT_SOURCE_2": 0.6,
    "EXT_SOURCE_3": 0.55,
    "REGION_RATING_CLIENT": 2,
    "CREDIT_INCOME_RATIO": 3.33,
    "ANNUITY_INCOME_RATIO": 0.17,
    "EXT_SOURCE_MEAN": 0.55,
}

# --- Fixed values: record validation ranges (column, min, max) -------------
FIELD_RULES = [
    ("CNT_CHILDREN", 0, None),
    ("AMT_INCOME_TOTAL", 0, None),
    ("AMT_CREDIT", 0, None),
    ("AMT_ANNUITY", 0, None),
    ("AMT_GOODS_PRICE", 0, None),
    ("DAYS_BIRTH", None, 0),
    ("EXT_SOURCE_1", 0, 1),
    ("EXT_SOURCE_2", 0, 1),
    ("EXT_SOURCE_3", 0, 1),
    ("REGION_RATING_CLIENT", 1, 3),
    ("CNT_FAM_MEMBERS", 1, None),
]
RATIO_OUTLIER_LIMIT = 100

# --- Fixed values: display order of feature categories ---------------------
CATEGORY_ORDER = [
    "Finances",
    "Scores externes",
    "Ratios",
    "Temporal",
    "Identité",
    "Famille",
    "Emploi",
    "Région",
    "Habitat",
    "Crédits bureau",
    "Crédits précédents",
    "Cartes de crédit",
    "Remboursements",
    "Autres",
]

# --- Fixed values: category patterns, first match wins ----------------------
CATEGORY_PATTERNS = [
    ("Finances", r"^AMT_|INCOME|CREDIT|ANNUITY|GOODS_PRICE"),
    ("Scores externes", r"EXT_SOURCE"),
    ("Ratios", r"RATIO|RATE|PERCENT|SHARE"),
    ("Temporal", r"^DAYS_|^WEEKDAY|^HOUR"),
    ("Identité", r"^NAME_|GENDER|^FLAG_"),
    ("Famille", r"CHILD|^CNT_|FAM"),
    ("Emploi", r"OCCUPATION|ORGANIZATION|EMPLOY"),
    ("Région", r"REGION"),
    (
        "Habitat",
        r"HOUSETYPE|WALLSMATERIAL|FONDKAPREMONT|EMERGENCYSTATE|LIVING|APARTMENT"
        r"|ENTRANCES|FLOOR|YEARS_BUILD|BUILDING|ELEVATORS",
    ),
    ("Crédits bureau", r"^BUREAU_"),
    ("Crédits précédents", r"^PREV_"),
    ("Cartes de crédit", r"^CC_"),
    ("Remboursements", r"^POS_|^INSTAL_"),
]
OTHER_CATEGORY = "Autres"
RATIO_NAME_PATTERN = r"RATIO|RATE|PERCENT|SHARE"

# --- Fixed values: multi-tag delimiters in order of preference ---------------
TAG_DELIMITERS = ["|", ";", ",", " / "]

# --- Fixed values: tokens a delimited-text reader treats as missing ----------
MISSING_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# --- Fixed values: boosted-tree settings --------------------------------------
BOOSTING = {
    "trees": 500,
    "learning_rate": 0.05,
    "row_fraction": 0.8,
    "feature_fraction": "0.8",
    "min_rows_per_leaf": 20,
    "max_depth": 5,
    "patience": 50,
    "seed": 42,
}
# trees grown leaf by leaf: no depth limit, bags redrawn every so many rounds
LEAFWISE = {"leaves": 31, "max_depth": None, "l1": 0.1, "l2": 0.1, "bag_rounds": 5, "bins": 254}

# --- Fixed values: expected table files ------------------------------------------
TABLE_FILES = {
    "application_train": "application_train.csv",
    "application_test": "application_test.csv",
    "bureau": "bureau.csv",
    "bureau_balance": "bureau_balance.csv",
    "previous_application": "previous_application.csv",
    "installments_payments": "installments_payments.csv",
    "pos_cash": "POS_CASH_balance.csv",
    "credit_card": "credit_card_balance.csv",
}

# --- Fixed values: comparison wording ----------------------------------------------
LOW_QUARTER_TEXT = "Client dans les 25% les plus bas."
HIGH_QUARTER_TEXT = "Client dans les 25% les plus hauts."
MIDDLE_TEXT = "Client dans la moyenne."
GOOD_MARK = "🟢 Bon"
AVERAGE_MARK = "🟡 Moyen"
ALERT_MARK = "🔴 Attention"
COMPARISON_GROUPS = {
    "Tous les clients": None,
    "Clients sans défaut (TARGET=0)": 0,
    "Clients en défaut (TARGET=1)": 1,
}
MAX_CHART_CATEGORIES = 15

# --- Fixed values: score wording (two published variants) -----------------------------
CONFIDENCE_HIGH = "très élevée"
CONFIDENCE_GOOD = "élevée"
CONFIDENCE_MID = "modérée"
SHORT_TEXTS = {
    "granted_high": "Profil très favorable. Risque de défaut minimal.",
    "granted_mid": "Profil acceptable avec quelques points de vigilance.",
    "refused_high": "Profil à risque significatif. Défaut de paiement probable.",
    "refused_mid": "Profil légèrement au-dessus du seuil de risque.",
}
LONG_TEXTS = {
    "granted_high": "Le profil du client présente des caractéristiques très favorables. Le risque de défaut est minimal.",
    "granted_good": "Le profil du client est globalement positif. Le risque de défaut est faible.",
    "granted_mid": "Le profil du client est acceptable mais présente quelques points de vigilance.",
    "refused_high": "Le profil du client présente des risques significatifs. Le défaut de paiement est probable.",
    "refused_good": "Le profil du client présente plusieurs facteurs de risque importants.",
    "refused_mid": "Le profil du client est légèrement au-dessus du seuil de risque acceptable.",
}
