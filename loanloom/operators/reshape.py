"""Type narrowing, sparse-column removal, alignment to a fitted schema, coercion, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.profile import null_ratios

FLOAT_LIMIT = 3.4028234663852886e38
INTEGER_STEPS = [("byte", 2**7), ("short", 2**15), ("int", 2**31)]


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest numeric type that holds every value of the column (one aggregation).

    Whole numbers go to byte, short or int when all values lie strictly inside
    the type's limits, other numbers to float.
    """
    numeric = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    row = df.agg(
        *[F.min(S.quoted(f.name)).alias(f"lo_{f.name}") for f in numeric],
        *[F.max(S.quoted(f.name)).alias(f"hi_{f.name}") for f in numeric],
    ).first()
    target: dict[str, str] = {}
    for f in numeric:
        lo, hi = row[f"lo_{f.name}"], row[f"hi_{f.name}"]
        if lo is None:
            continue
        if isinstance(f.dataType, T.IntegralType):
            fits = [t for t, limit in INTEGER_STEPS if lo > -limit and hi < limit - 1]
            if fits:
                target[f.name] = fits[0]
        elif -FLOAT_LIMIT < lo and hi < FLOAT_LIMIT:
            target[f.name] = "float"
    return df.select(
        *[
            S.quoted(c).cast(target[c]).alias(c) if c in target else S.quoted(c)
            for c in df.columns
        ]
    )


def sparse_columns(df: DataFrame, threshold: float = 0.8) -> list[str]:
    """Columns whose share of missing values is above the threshold."""
    ratios = null_ratios(df, df.columns)
    return [c for c, share in ratios.items() if share > threshold]


def drop_sparse(
    df: DataFrame, threshold: float = 0.8, also: tuple[str, ...] = (K.CLIENT_KEY, K.TARGET)
) -> DataFrame:
    """Without sparse columns, the key and the label."""
    return df.drop(*sparse_columns(df, threshold), *[c for c in also if c in df.columns])


def column_membership(names: DataFrame, column: str, df: DataFrame) -> DataFrame:
    """``names`` with ``present``: whether ``df`` has a column of the name in ``column``."""
    return names.withColumn("present", F.col(column).isin(df.columns))


def align(df: DataFrame, fitted: T.StructType, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of a fitted schema in its order: missing ones NULL, others dropped."""
    have = set(df.columns)
    return df.select(
        *[S.quoted(c) for c in keep if c in have],
        *[
            (S.quoted(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fitted.fields
        ],
    )


def safe_number(text: Column, default: float) -> Column:
    """Text as double, or the default when it is not a number."""
    return F.coalesce(text.try_cast("double"), F.lit(float(default)))


def safe_whole(text: Column, default: int) -> Column:
    """Text as a rounded whole number, or the default."""
    return F.coalesce(G.round_even_long(text.try_cast("double")), F.lit(int(default)).cast("long"))


def coerce_types(df: DataFrame, reference: T.StructType) -> DataFrame:
    """Text columns as the reference schema's types.

    Whole-number columns are rounded half to even; text that is no finite
    number becomes NULL.
    """
    have = set(df.columns)

    def one(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        raw = S.quoted(f.name)
        if isinstance(f.dataType, T.IntegralType):
            return G.round_even_long(raw.try_cast("double")).cast(f.dataType).alias(f.name)
        if isinstance(f.dataType, T.NumericType):
            return G.finite(raw.try_cast("double")).cast(f.dataType).alias(f.name)
        return raw.cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in reference.fields])


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL in every floating column, nested ones included."""

    def clean(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return G.finite(col)
        if isinstance(kind, T.StructType):
            parts = [clean(col[f.name], f.dataType).alias(f.name) for f in kind.fields]
            return F.when(col.isNotNull(), F.struct(*parts))
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: clean(x, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(col, lambda k, v: clean(v, kind.valueType))
        return col

    return df.select(*[clean(S.quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def violations(df: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Adds ``violations`` (names of fields out of range) and ``is_valid``.

    A NULL field breaks no rule. ``ratio_outlier`` marks credit-to-income
    ratios above the limit; it does not make a record invalid.
    """
    rules = K.FIELD_RULES if rules is None else rules
    have = set(df.columns)
    checks = []
    for name, low, high in rules:
        if name not in have:
            continue
        wrong = F.lit(False)
        if low is not None:
            wrong = wrong | (S.quoted(name) < low)
        if high is not None:
            wrong = wrong | (S.quoted(name) > high)
        checks.append(F.when(wrong, F.lit(name)))
    broken = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    out = df.withColumn("violations", broken).withColumn("is_valid", F.size("violations") == 0)
    if "CREDIT_INCOME_RATIO" in have:
        limit = F.coalesce(F.col("CREDIT_INCOME_RATIO") > K.RATIO_OUTLIER_LIMIT, F.lit(False))
        out = out.withColumn("ratio_outlier", limit)
    return out


def check_request_size(n: int) -> None:
    """A scoring request carries 1 to 1000 clients."""
    if not 1 <= n <= K.MAX_REQUEST_CLIENTS:
        raise ValueError(f"a request needs 1 to {K.MAX_REQUEST_CLIENTS} clients, got {n}")


def check_threshold(threshold: float | None) -> None:
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError(f"threshold must lie in 0..1, got {threshold}")


def duplicate_keys(df: DataFrame, key: str = K.CLIENT_KEY) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def sanity_report(df: DataFrame, features: list[str], key: str = K.CLIENT_KEY, label: str = K.TARGET) -> DataFrame:
    """Label not among the features, keys unique, label binary."""
    y = F.col(label)
    checks = df.agg(
        F.count_if(y.isNotNull() & ~y.isin(0, 1)).alias("odd_labels"), F.count(key).alias("keys")
    )
    duplicated = duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("d")).scalar()
    return checks.select(
        F.lit(label not in features).alias("label_not_a_feature"),
        duplicated.alias("duplicated_keys"),
        (F.col("odd_labels") == 0).alias("label_is_binary"),
        "keys",
    )
