"""Profiling, comparison and reshaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom import constants as K
from loanloom.catalog import sqltext as Q
from loanloom.catalog.base import r6, register, with_tables
from loanloom.catalog.features import (
    FEATURE_SELECT,
    SPINE_VIEWS,
    spine_columns,
    spine_ctes,
)
from loanloom.functions import schema as S
from loanloom.functions import text as X
from loanloom.operators import compare as C
from loanloom.operators import profile as P
from loanloom.operators import reshape as R
from loanloom.operators.applicant import application_features
from loanloom.operators.histogram import histogram
from loanloom.operators.ordered import quantiles
from loanloom.operators.rank_index import build_index, open_index
from loanloom.plans.spine import build_spine
from loanloom.session import scratch_path

ID = K.CLIENT_KEY
TRAIN = "SELECT * EXCLUDE (split) FROM app WHERE split = 'train'"
TRAIN_FEAT = "SELECT * EXCLUDE (split) FROM feat WHERE split = 'train'"
NUM = Q.APP_NUMERIC
LONG_TRAIN = Q.union_long("train", NUM)
TEXT_TRAIN = Q.union_text("train", Q.APP_STRING)


# ----------------------------------------------------------------- reshaping


@register(
    "p1_clean_names",
    "SELECT c_custkey AS Feature_One, c_acctbal AS Feature__Two_, c_nationkey AS Feature_Three_,"
    " c_mktsegment AS a_b, c_name AS c_d FROM customer",
    digits=None,
)
def p1(t):
    odd = t.raw("customer").select(
        F.col("c_custkey").alias("Feature One"),
        F.col("c_acctbal").alias("Feature (Two)"),
        F.col("c_nationkey").alias("Feature[Three]"),
        F.col("c_mktsegment").alias("a,b"),
        F.col("c_name").alias("c:d"),
    )
    return S.clean_names(odd)


@register(
    "p2_narrow_types",
    f"""SELECT l_orderkey, l_linenumber, {r6('CAST(l_quantity AS FLOAT)', 'l_quantity')},
{r6('CAST(l_extendedprice AS FLOAT)', 'l_extendedprice')}, {r6('CAST(l_discount AS FLOAT)', 'l_discount')},
l_returnflag FROM lineitem""",
)
def p2(t):
    df = t.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"
    )
    return R.narrow_types(df)


_SELECTED = "SELECT SK_ID_CURR, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY, AMT_GOODS_PRICE FROM app"


@register("p13_columns_by_type", with_tables("SELECT SK_ID_CURR, NAME_CONTRACT_TYPE, OCCUPATION_TYPE FROM app", "app"))
def p13(t):
    df = t.app.drop("split")
    return df.select(ID, *S.other_columns(df, S.numeric_columns(df)))


@register("p14_first_numeric", with_tables(_SELECTED, "app"), digits=None)
def p14(t):
    return t.app.select(ID, *S.first_numeric(t.app, 4, (ID, K.TARGET)))


@register(
    "p15_columns_by_prefix",
    with_tables(
        f"SELECT SK_ID_CURR, FLAG_DOCUMENT_2, FLAG_DOCUMENT_3, {Q.select_list(Q.EXT_STATS)} FROM app",
        "app",
    ),
)
def p15(t):
    derived = application_features(t.app)
    added = S.with_prefix(S.new_columns(t.app, derived), ["EXT_SOURCE"])
    return derived.select(ID, *S.with_prefix(t.app.columns, [K.DOCUMENT_PREFIX]), *added)


_ALL_SPINE = [n for n, _ in spine_columns()] + Q.APP_STRING
_NULLS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM trained"
    for c in _ALL_SPINE
)
TRAINED = "SELECT * FROM spine WHERE split = 'train'"


@register(
    "p16_sparse_columns",
    with_tables(
        "SELECT feature FROM nulls WHERE missing / CAST(rows AS DOUBLE) <= 0.8 AND feature <> 'TARGET'",
        *SPINE_VIEWS,
        **spine_ctes(),
        trained=TRAINED,
        nulls=_NULLS,
    ),
)
def p16(t):
    wide = build_spine(t.loan_tables()).table.where("split = 'train'").drop("split")
    kept = R.drop_sparse(wide).columns
    cells = P.null_report(wide)
    return cells.where(F.col("feature").isin(kept)).select("feature")


FITTED = T.StructType(
    [
        T.StructField("EXT_SOURCE_2", T.DoubleType()),
        T.StructField("AMT_CREDIT", T.DoubleType()),
        T.StructField("REGION_RATING_CLIENT", T.DoubleType()),
        T.StructField("OCCUPATION_TYPE", T.StringType()),
    ]
)


@register(
    "p17_align",
    with_tables(
        """SELECT SK_ID_CURR, EXT_SOURCE_2, AMT_CREDIT, CAST(NULL AS DOUBLE) AS REGION_RATING_CLIENT,
OCCUPATION_TYPE FROM app""",
        "app",
    ),
    digits=None,
)
def p17(t):
    return R.align(t.app, FITTED, keep=(ID,))


@register(
    "p18_outlier_filter",
    with_tables(
        """
SELECT t.SK_ID_CURR, t.TARGET, t.AMT_INCOME_TOTAL FROM train t
JOIN (SELECT TARGET, quantile_cont(AMT_INCOME_TOTAL, 0.99) AS q FROM train GROUP BY TARGET) c USING (TARGET)
WHERE t.AMT_INCOME_TOTAL < c.q""",
        "app",
        train=TRAIN,
    ),
    digits=None,
)
def p18(t):
    return C.without_outliers(t.train, "AMT_INCOME_TOTAL", 0.99, [K.TARGET]).select(
        ID, K.TARGET, "AMT_INCOME_TOTAL"
    )


@register(
    "p18_positive_years",
    with_tables(
        f"""
SELECT SK_ID_CURR, {r6('EMPLOYED_YEARS', 'EMPLOYED_YEARS')} FROM train WHERE EMPLOYED_YEARS > 0 AND EMPLOYED_YEARS <
(SELECT quantile_cont(EMPLOYED_YEARS, 0.99) FROM train WHERE EMPLOYED_YEARS > 0)""",
        "app",
        feat=FEATURE_SELECT,
        train=TRAIN_FEAT,
    ),
)
def p18_years(t):
    df = application_features(t.train).select(ID, "EMPLOYED_YEARS")
    return C.without_outliers(df, "EMPLOYED_YEARS", 0.99, positive=True)


@register(
    "p19_comparison_group",
    with_tables("SELECT SK_ID_CURR, AMT_CREDIT FROM app WHERE TARGET = 1", "app"),
    digits=None,
)
def p19(t):
    return C.comparison_group(t.app, "Clients en défaut (TARGET=1)").select(ID, "AMT_CREDIT")


_TEXT_COLS = ["AMT_INCOME_TOTAL", "DAYS_BIRTH", "EXT_SOURCE_1", "CNT_FAM_MEMBERS", "NAME_CONTRACT_TYPE"]


@register(
    "p26_coerce_types",
    with_tables(
        f"""
SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR % 9 = 0 THEN NULL WHEN SK_ID_CURR % 8 = 0 THEN NULL
    ELSE {r6('AMT_INCOME_TOTAL', 'x').split(' AS x')[0]} END AS AMT_INCOME_TOTAL,
  CAST(round_even(DAYS_BIRTH + 0.5, 0) AS BIGINT) AS DAYS_BIRTH, {r6('EXT_SOURCE_1', 'EXT_SOURCE_1')}, NAME_CONTRACT_TYPE
FROM app""",
        "app",
    ),
)
def p26(t):
    text = t.app.select(
        F.col(ID).cast("string").alias(ID),
        F.when(F.col(ID) % 9 == 0, "not a number")
        .when(F.col(ID) % 8 == 0, "Infinity")
        .otherwise(F.col("AMT_INCOME_TOTAL").cast("string"))
        .alias("AMT_INCOME_TOTAL"),
        (F.col("DAYS_BIRTH").cast("double") + 0.5).cast("string").alias("DAYS_BIRTH"),
        F.col("EXT_SOURCE_1").cast("string").alias("EXT_SOURCE_1"),
        "NAME_CONTRACT_TYPE",
    )
    reference = t.app.select(ID, *[c for c in _TEXT_COLS if c != "CNT_FAM_MEMBERS"]).schema
    return R.coerce_types(text, reference)


# each field of a rule is out of range in some records: below its low or above its high end
_CHECKED = {
    "CNT_CHILDREN": "CAST(SK_ID_CURR % 4 AS DOUBLE)",
    "REGION_RATING_CLIENT": "CAST(SK_ID_CURR % 3 + 1 AS DOUBLE)",
}
_CHECKED |= {n: f"CAST({n} AS DOUBLE)" for n, _, _ in K.FIELD_RULES if n not in _CHECKED}


def _broken_field(i: int, name: str, low, high) -> str:
    low_value = f"CAST({low} - 1 AS DOUBLE)" if low is not None else _CHECKED[name]
    high_value = f"CAST({high} + 1 AS DOUBLE)" if high is not None else _CHECKED[name]
    return (
        f"CASE WHEN SK_ID_CURR % 29 = {i} THEN {low_value} WHEN SK_ID_CURR % 31 = {i} THEN {high_value}"
        f" ELSE {_CHECKED[name]} END AS {name}"
    )


_BROKEN = (
    "SELECT SK_ID_CURR, AMT_CREDIT / (SK_ID_CURR + 1) AS CREDIT_INCOME_RATIO, "
    + ", ".join(_broken_field(i, *rule) for i, rule in enumerate(K.FIELD_RULES))
    + " FROM app"
)


def _is_broken(name: str, low, high) -> str:
    ends = [f"{name} < {low}"] * (low is not None) + [f"{name} > {high}"] * (high is not None)
    return f"coalesce({' OR '.join(ends)}, FALSE)"


@register(
    "p27_record_validation",
    with_tables(
        "SELECT SK_ID_CURR, concat_ws(',', "
        + ", ".join(f"CASE WHEN {_is_broken(*rule)} THEN '{rule[0]}' END" for rule in K.FIELD_RULES)
        + ") AS broken, NOT ("
        + " OR ".join(_is_broken(*rule) for rule in K.FIELD_RULES)
        + ") AS is_valid, CREDIT_INCOME_RATIO > 100 AS ratio_outlier FROM records",
        "app",
        records=_BROKEN,
    ),
)
def p27(t):
    t.app.createOrReplaceTempView("app")
    checked = R.violations(t.spark.sql(_BROKEN))
    return checked.select(
        ID, F.array_join("violations", ",").alias("broken"), "is_valid", "ratio_outlier"
    )


@register(
    "p28_finite_only",
    with_tables(
        "SELECT SK_ID_CURR, CASE WHEN SK_ID_CURR % 3 = 0 OR SK_ID_CURR % 5 = 0 THEN NULL ELSE AMT_CREDIT END AS v,"
        " CASE WHEN SK_ID_CURR % 3 = 0 OR SK_ID_CURR % 5 = 0 THEN NULL ELSE AMT_CREDIT END AS nested FROM app",
        "app",
    ),
    digits=None,
)
def p28(t):
    odd = (
        F.when(F.col(ID) % 3 == 0, F.lit(float("nan")))
        .when(F.col(ID) % 5 == 0, F.lit(float("-inf")))
        .otherwise(F.col("AMT_CREDIT"))
    )
    df = t.app.select(ID, odd.alias("v"), F.array(F.struct(odd.alias("x"))).alias("cells"))
    return R.finite_only(df).select(ID, "v", F.col("cells")[0]["x"].alias("nested"))


@register(
    "p29_sanity_report",
    with_tables(
        """
SELECT TRUE AS label_not_a_feature, (SELECT count(*) FROM (SELECT SK_ID_CURR FROM app GROUP BY 1 HAVING count(*) > 1)) AS duplicated_keys,
  bool_and(TARGET IS NULL OR TARGET IN (0, 1)) AS label_is_binary, count(SK_ID_CURR) AS keys FROM app""",
        "app",
    ),
)
def p29(t):
    return R.sanity_report(t.app, NUM)


@register(
    "w11_duplicate_keys",
    with_tables(
        "SELECT SK_ID_CURR, count(*) AS rows FROM credit_card GROUP BY 1 HAVING count(*) > 1", "credit_card"
    ),
)
def w11(t):
    return R.duplicate_keys(t.view("credit_card"))


@register(
    "w10_column_membership",
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count({c}) AS importance, count(*) FILTER (WHERE {c} IS NULL) <= 0.8 * count(*) AS present FROM train"
            for c in NUM
        ),
        "app",
        train=TRAIN,
    ),
)
def w10(t):
    """Which features of an importance table the data still has once sparse columns are dropped."""
    importance = P.column_stats(t.train, NUM, {"importance": F.count})
    return R.column_membership(importance, "feature", R.drop_sparse(t.train, also=()))


# ----------------------------------------------------------------- profiling


@register(
    "a9_null_report",
    with_tables(
        f"SELECT feature, rows, missing, {r6('missing * 100.0 / rows', 'missing_pct')} FROM nulls WHERE missing > 0",
        *SPINE_VIEWS,
        **spine_ctes(),
        trained=TRAINED,
        nulls=_NULLS,
    ),
)
def a9(t):
    wide = build_spine(t.loan_tables()).table.where("split = 'train'").drop("split")
    return P.columns_with_nulls(wide)


@register(
    "a9_missing_share",
    with_tables(
        f"SELECT CAST(sum(rows) AS BIGINT) AS cells, CAST(sum(missing) AS BIGINT) AS missing, {r6('sum(missing) * 100.0 / sum(rows)', 'missing_pct')} FROM ("
        + " UNION ALL ".join(
            f"SELECT count(*) AS rows, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM train"
            for c in [ID, K.TARGET, *NUM, *Q.APP_STRING]
        )
        + ")",
        "app",
        train=TRAIN,
    ),
)
def a9_share(t):
    return P.missing_share(t.train)


@register(
    "a10_class_distribution",
    with_tables(
        f"""
SELECT TARGET, count(*) AS rows, {r6('count(*) * 100.0 / (SELECT count(*) FROM train)', 'pct')},
  {r6('count(*) / CAST((SELECT min(n) FROM (SELECT count(*) AS n FROM train GROUP BY TARGET)) AS DOUBLE)', 'times_rarest')}
FROM train GROUP BY TARGET""",
        "app",
        train=TRAIN,
    ),
)
def a10(t):
    return P.class_distribution(t.app)


_DESCRIBE = f"""
SELECT feature, count(*) AS count, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')}, {r6('min(value)', 'min')},
  {r6('quantile_cont(value, 0.25)', 'q25')}, {r6('quantile_cont(value, 0.5)', 'q50')}, {r6('quantile_cont(value, 0.75)', 'q75')},
  {r6('max(value)', 'max')} FROM long GROUP BY feature"""


@register("a11_describe", with_tables(_DESCRIBE, "app", train=TRAIN, long=LONG_TRAIN))
def a11(t):
    return P.describe_numeric(t.train, NUM)


@register("a11_describe_bucketed", with_tables(_DESCRIBE, "app", train=TRAIN, long=LONG_TRAIN))
def a11_bucketed(t):
    """The same result by the search meant for inputs of any size."""
    return P.describe_numeric(t.train, NUM, method="exact")


_DERIVED_LONG = Q.union_long("train", list(Q.DERIVED))


@register(
    "a11_describe_derived",
    with_tables(_DESCRIBE, "app", feat=FEATURE_SELECT, train=TRAIN_FEAT, long=_DERIVED_LONG),
)
def a11_derived(t):
    df = application_features(t.train)
    return P.describe_numeric(df, S.new_columns(t.train, df))


_TEXT_STATS = """
SELECT feature, CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", min_by(value, (-n, value)) AS top, max(n) AS freq
FROM (SELECT feature, value, count(*) AS n FROM texts GROUP BY 1, 2) GROUP BY feature"""
_MISSING = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL) AS missing FROM train"
    for c in [*NUM, *Q.APP_STRING]
)
_NODBL = ", ".join(f"CAST(NULL AS DOUBLE) AS {c}" for c in ["mean", "std", "min", "q25", "q50", "q75", "max"])


@register(
    "a12_describe_all",
    with_tables(
        f"""
SELECT * FROM (SELECT *, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM described
UNION ALL BY NAME SELECT feature, count, "unique", top, freq, {_NODBL} FROM text_stats) JOIN missing USING (feature)""",
        "app",
        train=TRAIN,
        long=LONG_TRAIN,
        described=_DESCRIBE,
        texts=TEXT_TRAIN,
        text_stats=_TEXT_STATS,
        missing=_MISSING,
    ),
)
def a12(t):
    return P.describe_all(t.train.select(*NUM, *Q.APP_STRING))


@register(
    "a12_table_summary",
    with_tables(
        "SELECT count(*) AS n_rows, count(*) FILTER (WHERE TARGET = 0) AS target_0,"
        " count(*) FILTER (WHERE TARGET = 1) AS target_1, CAST(20 AS BIGINT) AS n_columns FROM train",
        "app",
        train=TRAIN,
    ),
)
def a12_summary(t):
    return P.table_summary(t.train)


@register(
    "a13_type_counts",
    with_tables(
        """SELECT (SELECT count(*) FROM train) AS n_rows, type, CAST(columns AS BIGINT) AS columns FROM (VALUES ('bigint', 3), ('double', 9), ('int', 6), ('string', 2)) v(type, columns)""",
        "app",
        train=TRAIN,
    ),
)
def a13(t):
    return P.type_counts(t.train)


@register(
    "a14_distinct_categories",
    with_tables(
        "SELECT feature, count(DISTINCT value) AS categories FROM texts GROUP BY feature",
        "app",
        train=TRAIN,
        texts=TEXT_TRAIN,
    ),
)
def a14(t):
    return P.distinct_categories(t.train, Q.APP_STRING)


@register(
    "a15_default_rate_by",
    with_tables(
        f"SELECT feature, value, {r6('avg(TARGET)', 'default_rate')}, count(TARGET) AS rows FROM texts GROUP BY 1, 2",
        "app",
        train=TRAIN,
        texts=Q.union_text("train", Q.APP_STRING, "TARGET"),
    ),
)
def a15(t):
    return P.default_rate_by(t.train, Q.APP_STRING)


_SPINE_NUM = [n for n, _ in spine_columns() if n != "TARGET"]


def corr_sql(x: str, y: str) -> str:
    pair = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    sx = f"stddev_pop({x}) FILTER (WHERE {pair})"
    sy = f"stddev_pop({y}) FILTER (WHERE {pair})"
    return f"covar_pop({x}, {y}) / nullif({sx} * {sy}, 0)"


_CORRS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {corr_sql(c, 'TARGET')} AS correlation FROM trained" for c in _SPINE_NUM
)


@register(
    "a16_target_correlations",
    with_tables(
        f"SELECT feature, {r6('correlation', 'correlation')} FROM corrs",
        *SPINE_VIEWS,
        **spine_ctes(),
        trained=TRAINED,
        corrs=_CORRS,
    ),
)
def a16(t):
    wide = build_spine(t.loan_tables()).table.where("split = 'train'")
    return P.target_correlations(wide, S.numeric_columns(wide, (ID, K.TARGET)))


_PAIRS = NUM


@register(
    "a16_correlation_matrix",
    with_tables(
        f'SELECT "left", "right", {r6("correlation", "correlation")} FROM ('
        + " UNION ALL ".join(
            f"""SELECT '{a}' AS "left", '{b}' AS "right", {corr_sql(a, b)} AS correlation FROM train"""
            for i, a in enumerate(_PAIRS)
            for b in _PAIRS[i + 1 :]
        )
        + ")",
        "app",
        train=TRAIN,
    ),
)
def a16_matrix(t):
    return P.correlation_matrix(t.train, _PAIRS)


_APP_CORR = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {corr_sql(c, 'TARGET')} AS correlation FROM train" for c in NUM
)


@register(
    "w4_strongest_correlations",
    with_tables(
        f"""
SELECT feature, {r6('correlation', 'correlation')}, 'head' AS "end" FROM (SELECT * FROM corrs WHERE correlation IS NOT NULL ORDER BY round(correlation, 9), feature LIMIT 15)
UNION ALL SELECT feature, {r6('correlation', 'correlation')}, 'tail' FROM (SELECT * FROM corrs WHERE correlation IS NOT NULL ORDER BY round(correlation, 9) DESC, feature LIMIT 15)""",
        "app",
        train=TRAIN,
        corrs=_APP_CORR,
    ),
)
def w4(t):
    return P.strongest_correlations(P.target_correlations(t.train, NUM))


@register(
    "w4_top_missing",
    with_tables(
        f"""SELECT feature, rows, missing, {r6('missing * 100.0 / rows', 'missing_pct')} FROM nulls WHERE missing > 0
ORDER BY missing / CAST(rows AS DOUBLE) DESC, feature LIMIT 20""",
        *SPINE_VIEWS,
        **spine_ctes(),
        trained=TRAINED,
        nulls=_NULLS,
    ),
)
def w4_missing(t):
    wide = build_spine(t.loan_tables()).table.where("split = 'train'").drop("split")
    return P.columns_with_nulls(wide, 20)


@register(
    "w9_head_and_tail",
    with_tables(
        """
SELECT feature, 'head' AS "end" FROM (SELECT * FROM corrs WHERE correlation IS NOT NULL ORDER BY round(correlation, 9), feature LIMIT 15)
UNION ALL SELECT feature, 'tail' FROM (SELECT * FROM corrs WHERE correlation IS NOT NULL ORDER BY round(correlation, 9) DESC, feature LIMIT 15)""",
        *SPINE_VIEWS,
        **spine_ctes(),
        trained=TRAINED,
        corrs=_CORRS,
    ),
)
def w9(t):
    wide = build_spine(t.loan_tables()).table.where("split = 'train'")
    corrs = P.target_correlations(wide, S.numeric_columns(wide, (ID, K.TARGET)))
    return P.strongest_correlations(corrs, 15).select("feature", "end")


def _quantile_sql(points: list[float]) -> str:
    cols = ", ".join(
        r6(f"quantile_cont(value, {p})", f"q{p * 100:g}".replace(".", "_")) for p in points
    )
    return f"SELECT feature, {cols} FROM long GROUP BY feature"


POINTS = [0.01, 0.05, 0.5, 0.95, 0.99]


@register("a17_quantiles", with_tables(_quantile_sql(POINTS), "app", train=TRAIN, long=LONG_TRAIN))
def a17(t):
    return quantiles(t.train, NUM, POINTS)


@register(
    "a17_quantiles_bucketed",
    with_tables(
        _quantile_sql(POINTS),
        long="SELECT 'l_extendedprice' AS feature, l_extendedprice AS value FROM lineitem"
        " UNION ALL SELECT 'l_discount', l_discount FROM lineitem",
    ),
)
def a17_bucketed(t):
    return quantiles(t.raw("lineitem"), ["l_extendedprice", "l_discount"], POINTS, method="exact")


_RANGES = """
SELECT feature, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.95) AS p95,
  bool_and(value = floor(value)) AS is_int FROM long GROUP BY feature"""


@register(
    "a18_numeric_ranges",
    with_tables(
        f"SELECT feature, {r6('lo', 'min')}, {r6('hi', 'max')}, {r6('p5', 'p5')}, {r6('p95', 'p95')}, is_int FROM ranges",
        "app",
        train=TRAIN,
        long=LONG_TRAIN,
        ranges=_RANGES,
    ),
)
def a18(t):
    return P.numeric_ranges(t.train, NUM)


@register(
    "a19_reference_stats",
    with_tables(
        f"""
SELECT feature, {r6('quantile_cont(value, 0.5)', 'median')}, CAST(NULL AS VARCHAR) AS mode FROM long GROUP BY feature
UNION ALL SELECT feature, CAST(NULL AS DOUBLE), top FROM text_stats""",
        "app",
        train=TRAIN,
        long=LONG_TRAIN,
        texts=TEXT_TRAIN,
        text_stats=_TEXT_STATS,
    ),
)
def a19(t):
    return P.reference_stats(t.train.select(*NUM, *Q.APP_STRING))


@register(
    "a20_top_categories",
    with_tables(
        "SELECT OCCUPATION_TYPE AS value, count(*) AS rows FROM train WHERE OCCUPATION_TYPE IS NOT NULL"
        " GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
        "app",
        train=TRAIN,
    ),
)
def a20(t):
    return P.top_categories(t.train, "OCCUPATION_TYPE", 20)


_HIST = """
SELECT {by}, bin, lo + bin * (hi - lo) / 50 AS bin_start, coalesce(m, 0) AS rows, coalesce(m, 0) / (n * (hi - lo) / 50) AS density
FROM (SELECT * FROM ends, range(0, 50) t(bin)) LEFT JOIN (
  SELECT {by}, least(CAST(floor((x - lo) / ((hi - lo) / 50)) AS BIGINT), 49) AS bin, count(*) AS m FROM vals JOIN ends USING ({by}) GROUP BY 1, 2
) USING ({by}, bin)"""


@register(
    "a21_histogram_by_class",
    with_tables(
        f"SELECT TARGET, CAST(bin AS INTEGER) AS bin, {r6('bin_start', 'bin_start')}, rows, {r6('density', 'density', 9)} FROM hist",
        "app",
        vals="SELECT TARGET, AMT_CREDIT AS x FROM app WHERE TARGET IS NOT NULL",
        ends="SELECT TARGET, min(x) AS lo, max(x) AS hi, count(*) AS n FROM vals GROUP BY TARGET",
        hist=_HIST.format(by="TARGET"),
    ),
    digits=None,
)
def a21(t):
    h = histogram(t.train, "AMT_CREDIT", 50, [K.TARGET])
    return h.select(
        K.TARGET,
        "bin",
        F.round(F.col("bin_start") + 1e-8, 6).alias("bin_start"),
        "rows",
        F.round(F.col("density") + 1e-8, 9).alias("density"),
    )


@register(
    "a21_score_histogram",
    with_tables(
        f"SELECT CAST(bin AS INTEGER) AS bin, {r6('bin_start', 'bin_start')}, rows, {r6('density', 'density')} FROM hist",
        "scored",
        vals="SELECT 1 AS g, proba AS x FROM scored",
        ends="SELECT 1 AS g, min(x) AS lo, max(x) AS hi, count(*) AS n FROM vals",
        hist=_HIST.format(by="g"),
    ),
)
def a21_scores(t):
    return histogram(t.scored, "proba", 50)


@register(
    "a26_dataset_kpis",
    with_tables(
        f"""
SELECT count(*) AS clients, {r6('avg(TARGET)', 'default_rate')}, CAST(20 AS BIGINT) AS columns, CAST(18 AS BIGINT) AS numeric_columns,
  CAST(2 AS BIGINT) AS categorical_columns,
  {r6('(' + ' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in [ID, K.TARGET, *NUM, *Q.APP_STRING]) + ') * 100.0 / (count(*) * 20)', 'missing_pct')},
  {', '.join(r6(f'median({c})', f'median_{c}') for c in ['AMT_INCOME_TOTAL', 'AMT_CREDIT', 'AMT_ANNUITY', *Q.EXT])} FROM train""",
        "app",
        train=TRAIN,
    ),
)
def a26(t):
    return P.dataset_kpis(t.train)


@register(
    "a28_column_kinds",
    with_tables(
        """
SELECT feature, feature LIKE 'FLAG!_%' ESCAPE '!' OR (is_int AND lo >= 0 AND hi <= 1) AS is_boolean,
  (lo >= 0 AND hi <= 1) OR (regexp_matches(feature, 'RATIO|RATE|PERCENT|SHARE') AND lo >= 0 AND hi <= 100)
  OR (is_int AND lo >= 0 AND hi <= 5) AS is_bounded FROM ranges""",
        "app",
        feat=FEATURE_SELECT,
        train=TRAIN_FEAT,
        long=LONG_TRAIN + " UNION ALL " + _DERIVED_LONG,
        ranges=_RANGES,
    ),
)
def a28(t):
    df = application_features(t.train)
    return P.column_kinds(P.numeric_ranges(df, [*NUM, *Q.DERIVED]))


# ----------------------------------------------------------------- comparison

COMPARED = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "DAYS_BIRTH", "EXT_SOURCE_1", "EXT_SOURCE_2", "FLAG_PHONE", "CREDIT_INCOME_RATIO"]
_POSITION = """
SELECT SK_ID_CURR, feature, value, percentile FROM (
  SELECT SK_ID_CURR, feature, value, is_pop,
    CAST(coalesce(sum(is_pop) OVER (PARTITION BY feature ORDER BY value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
      - sum(is_pop) OVER (PARTITION BY feature, value) AS DOUBLE) * 100 / sum(is_pop) OVER (PARTITION BY feature) AS percentile
  FROM (SELECT SK_ID_CURR, feature, value, 1 AS is_pop FROM pop UNION ALL SELECT SK_ID_CURR, feature, value, 0 FROM asked)
) WHERE is_pop = 0"""
_TYPICAL = "SELECT feature, avg(value) AS mean, quantile_cont(value, 0.5) AS median FROM pop GROUP BY feature"
_COMPARE_CTES = dict(
    feat=FEATURE_SELECT,
    pop=Q.union_long("feat", COMPARED, "SK_ID_CURR", "TARGET = 0"),
    asked=Q.union_long("feat", COMPARED, "SK_ID_CURR"),
    positions=_POSITION,
    typical=_TYPICAL,
)


def _compared(t):
    clients = application_features(t.app)
    population = C.comparison_group(clients, "Clients sans défaut (TARGET=0)")
    return C.compare_clients(clients, population, COMPARED)


_COMPARED_SQL = with_tables(
    f"""SELECT SK_ID_CURR, feature, {r6('value', 'value')}, {r6('percentile', 'percentile')}, {r6('mean', 'mean')},
  {r6('median', 'median')} FROM positions JOIN typical USING (feature)""",
    "app",
    **_COMPARE_CTES,
)
_POSITIONS_SQL = with_tables(
    f"SELECT feature, {r6('value', 'value')}, {r6('percentile', 'percentile')} FROM (SELECT DISTINCT feature, value, percentile FROM positions)",
    "app",
    **_COMPARE_CTES,
)


@register("a22_client_percentiles", _COMPARED_SQL)
def a22(t):
    return _compared(t)


@register("j5_values_against_population", _POSITIONS_SQL)
def j5(t):
    clients = application_features(t.app)
    population = C.comparison_group(clients, "Clients sans défaut (TARGET=0)")
    return C.value_positions(population, clients, COMPARED).drop("asks")


def _stored(t):
    """All clients, and the stored order of those without default: written in two parts, opened again."""
    clients = application_features(t.app)
    population = C.comparison_group(clients, "Clients sans défaut (TARGET=0)")
    first = build_index(population.where(F.col(ID) % 2 == 0), COMPARED, scratch_path(t.spark, "rank-index"))
    whole = first.extend(population.where(F.col(ID) % 2 != 0), scratch_path(t.spark, "rank-index"))
    return clients, open_index(t.spark, whole.path)


@register("a22_stored_percentiles", _COMPARED_SQL)
def a22_stored(t):
    clients, index = _stored(t)
    return index.compare(clients, COMPARED)


@register("j5_stored_positions", _POSITIONS_SQL)
def j5_stored(t):
    clients, index = _stored(t)
    return index.positions(clients, COMPARED).drop("asks")


@register(
    "a23_position_messages",
    with_tables(
        f"""
SELECT SK_ID_CURR, feature, CASE WHEN percentile < 25 THEN '{K.LOW_QUARTER_TEXT}' WHEN percentile > 75 THEN '{K.HIGH_QUARTER_TEXT}'
    ELSE '{K.MIDDLE_TEXT}' END AS message,
  CASE WHEN (percentile > 50 AND feature LIKE '%SOURCE%') OR (percentile < 50 AND feature LIKE '%RATIO%') THEN '{K.GOOD_MARK}'
    WHEN percentile > 25 AND percentile < 75 THEN '{K.AVERAGE_MARK}' ELSE '{K.ALERT_MARK}' END AS mark FROM positions""",
        "app",
        **_COMPARE_CTES,
    ),
)
def a23(t):
    rows = _compared(t)
    return rows.select(
        ID,
        "feature",
        C.quartile_text(F.col("percentile")).alias("message"),
        C.position_mark(F.col("feature"), F.col("percentile")).alias("mark"),
    )


_RADAR = ["EXT_SOURCE_2", "EXT_SOURCE_3", "EXT_SOURCE_1", "DAYS_BIRTH", "AMT_CREDIT", "FLAG_MOBIL"]


@register(
    "a24_scaled_profile",
    with_tables(
        f"""
SELECT SK_ID_CURR, feature, {r6('CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0.5 END', 'client_scaled')},
  {r6('CASE WHEN hi > lo THEN (mean - lo) / (hi - lo) ELSE 0.5 END', 'mean_scaled')}
FROM asked JOIN (SELECT feature, min(value) AS lo, max(value) AS hi, avg(value) AS mean FROM pop GROUP BY feature) USING (feature)
QUALIFY count(*) OVER (PARTITION BY SK_ID_CURR) >= 3""",
        "app",
        train=TRAIN,
        pop=Q.union_long("train", _RADAR),
        asked=Q.union_long("app", _RADAR, "SK_ID_CURR"),
    ),
)
def a24(t):
    return C.scaled_profile(t.app, t.train, _RADAR)


_CATS = f"""
SELECT SK_ID_CURR, feature, value, {r6('coalesce(n, 0) * 100.0 / known', 'client_pct')}, mode, {r6('mode_n * 100.0 / known', 'mode_pct')}
FROM asked JOIN (SELECT feature, sum(n) AS known, min_by(value, (-n, value)) AS mode, max(n) AS mode_n, count(*) AS u FROM counts GROUP BY feature) f
USING (feature) LEFT JOIN counts USING (feature, value) {{where}}"""
_CAT_CTES = dict(
    train=TRAIN,
    texts=TEXT_TRAIN,
    counts="SELECT feature, value, count(*) AS n FROM texts GROUP BY 1, 2",
    asked=Q.union_text("app", Q.APP_STRING, "SK_ID_CURR"),
)


@register("a25_category_comparison", with_tables(_CATS.format(where="WHERE u <= 15"), "app", **_CAT_CTES))
def a25(t):
    return C.compare_categories(t.app, t.train, Q.APP_STRING, K.CLIENT_KEY, K.MAX_CHART_CATEGORIES)


@register("a25_category_comparison_all", with_tables(_CATS.format(where=""), "app", **_CAT_CTES))
def a25_all(t):
    return C.compare_categories(t.app, t.train, Q.APP_STRING)


# ----------------------------------------------------------------- text columns


@register(
    "x1_tag_profile",
    f"""
SELECT 'url' AS column_name, d AS delimiter, with_delimiter, tags, {r6('tags / nullif(with_delimiter, 0)', 'tags_per_value')} FROM (
SELECT d, count(*) FILTER (WHERE contains(v, d)) AS with_delimiter,
  CAST(sum(len(list_filter(string_split(trim(v), d), lambda x: trim(x) <> ''))) FILTER (WHERE contains(v, d)) AS BIGINT) AS tags FROM
(SELECT regexp_replace(replace(url, '/', ' / '), '^https?: /  / ', '') AS v FROM pages),
(VALUES ('|'), (';'), (','), (' / ')) t(d) GROUP BY d)""",
)
def x1_profile(t):
    values = _tagged(t)
    return X.delimiter_profile(values, "v").select(
        F.lit("url").alias("column_name"), "delimiter", "with_delimiter", "tags", "tags_per_value"
    )


def _tagged(t):
    v = F.regexp_replace(F.replace("url", F.lit("/"), F.lit(" / ")), r"^https?: /  / ", "")
    return t.raw("pages").select(v.alias("v"))


@register(
    "x1_tag_frequency",
    """
SELECT trim(tag) AS tag, count(*) AS rows FROM (SELECT unnest(string_split(trim(regexp_replace(replace(url, '/', ' / '), '^https?: /  / ', '')), ' / ')) AS tag FROM pages)
WHERE trim(tag) <> '' GROUP BY 1""",
)
def x1_tags(t):
    values = _tagged(t)
    return X.tag_frequency(values, "v", X.detect_delimiter(values, "v"))


# every column but the doubles, whose text differs between engines
_SIGNED = sorted([ID, K.TARGET, "split", "DAYS_BIRTH", "DAYS_EMPLOYED", *Q.APP_STRING, *[c for c in NUM if c.startswith("FLAG_")]])
_QUOTED = (*Q.APP_STRING, "split")


def _json_cell(c: str) -> str:
    value = f"'\"' || {c} || '\"'" if c in _QUOTED else f"CAST({c} AS VARCHAR)"
    return f"'\"{c}\":' || coalesce({value}, 'null')"


@register(
    "x2_row_signature",
    with_tables(
        "SELECT SK_ID_CURR, sha256('{' || " + " || ',' || ".join(map(_json_cell, _SIGNED)) + " || '}') AS signature FROM app",
        "app",
    ),
)
def x2(t):
    df = t.app.select(*reversed(_SIGNED))
    return df.select(ID, X.row_signature(df.columns).alias("signature"))
