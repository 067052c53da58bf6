"""Reading loan tables, previews and client requests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.sources.schemas import schema_for

SOURCE_SETTING = "loanloom.source"


def resolve_source(spark: SparkSession, explicit: str | None, default: str | None) -> str:
    """Explicit location, else the session setting, else the default."""
    found = explicit or spark.conf.get(SOURCE_SETTING, None) or default
    if not found:
        raise ValueError("no data source given")
    return found


def read_source(spark: SparkSession, location: str) -> DataFrame:
    """A table by location; the format follows the extension."""
    name = location.rstrip("/").lower()
    if name.endswith((".csv", ".csv.gz")):
        return read_csv(spark, location)
    if name.endswith((".json", ".jsonl")):
        return spark.read.json(location)
    return spark.read.parquet(location)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Missing-value tokens in text columns and NaN in floating columns become NULL."""

    def one(f: T.StructField):
        col = S.quoted(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.when(col.isin(K.MISSING_TOKENS), None).otherwise(col).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.when(F.isnan(col), None).otherwise(col).alias(f.name)
        return col

    return df.select(*[one(f) for f in df.schema.fields])


def _typed(value: Column, kind: T.DataType) -> Column:
    """A text cell in its type; NULL where it does not parse. Whole numbers may be written as 1.0."""
    number = value.try_cast("double")
    number = F.when(~F.isnan(number), number)
    if isinstance(kind, T.IntegralType):
        return F.coalesce(value.try_cast("long"), G.round_even_long(number)).try_cast(kind)
    return number.cast(kind) if isinstance(kind, T.NumericType) else value.try_cast(kind)


def _read_text(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with header as text; missing-value tokens are NULL."""
    return missing_to_null(spark.read.option("header", True).csv(path))


def csv_schema(raw: DataFrame, overrides: dict | None = None) -> T.StructType:
    """Types of text columns: those declared by name, the others found from all their values.

    A column no rule names is a number when every value is one. That takes
    one pass over these columns, none if every column is named.
    """
    declared = {f.name: f for f in schema_for(raw.columns, overrides).fields}
    open_ = [c for c in raw.columns if c not in declared]
    numeric = {}
    if open_:
        known = [F.count(S.quoted(c)).alias(f"n{i}") for i, c in enumerate(open_)]
        parsed = [F.count(S.quoted(c).try_cast("double")).alias(f"p{i}") for i, c in enumerate(open_)]
        counts = raw.agg(*known, *parsed).first()  # one row
        numeric = {c: 0 < counts[f"n{i}"] == counts[f"p{i}"] for i, c in enumerate(open_)}
    return T.StructType(
        [
            declared.get(c) or T.StructField(c, T.DoubleType() if numeric[c] else T.StringType())
            for c in raw.columns
        ]
    )


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, overrides: dict | None = None
) -> DataFrame:
    """A delimited file with header, typed by name or, failing that, by its values.

    A field that does not parse is missing; :func:`unparsed_cells` counts these.
    """
    raw = _read_text(spark, path)
    schema = schema or csv_schema(raw, overrides)
    return raw.select(*[_typed(S.quoted(f.name), f.dataType).alias(f.name) for f in schema.fields])


def unparsed_cells(
    spark: SparkSession, path: str, schema: T.StructType | None = None, overrides: dict | None = None
) -> DataFrame:
    """(column, unparsed): cells with a value that its type cannot hold, one row per column."""
    raw = _read_text(spark, path)
    schema = schema or csv_schema(raw, overrides)
    lost = [
        F.count_if(S.quoted(f.name).isNotNull() & _typed(S.quoted(f.name), f.dataType).isNull()).alias(f"c{i}")
        for i, f in enumerate(schema.fields)
    ]
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.col(f"c{i}").alias("unparsed"))
        for i, f in enumerate(schema.fields)
    ]
    return raw.agg(*lost).select(F.inline(F.array(*cells)))


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path).schema  # noqa: B018  (resolving the path is the test)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def read_applications(spark: SparkSession, folder: str) -> DataFrame:
    """Train and test applications in one frame with ``split``; both files must exist."""
    paths = {
        "train": f"{folder}/{K.TABLE_FILES['application_train']}",
        "test": f"{folder}/{K.TABLE_FILES['application_test']}",
    }
    absent = [p for p in paths.values() if not table_exists(spark, p)]
    if absent:
        raise FileNotFoundError(f"application files not found: {absent}")
    train = read_csv(spark, paths["train"]).withColumn("split", F.lit("train"))
    test = read_csv(spark, paths["test"]).withColumn("split", F.lit("test"))
    return train.unionByName(test, allowMissingColumns=True)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One enrichment table by its name."""
    return read_csv(spark, f"{folder}/{K.TABLE_FILES[name]}")


def read_loan_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Applications and every enrichment table that is present."""
    tables = {"app": read_applications(spark, folder)}
    for name, file in K.TABLE_FILES.items():
        if not name.startswith("application_") and table_exists(spark, f"{folder}/{file}"):
            tables[name] = read_table(spark, folder, name)
    return tables


def preview(df: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """The first n rows; with a key the same rows every time."""
    return df.limit(n) if key is None else df.orderBy(key).limit(n)


def inventory(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Per expected table: present, rows, number of columns and their names."""
    rows = None
    spark = next(t for t in tables.values() if t is not None).sparkSession
    for name, df in tables.items():
        if df is None:
            part = spark.range(1).select(
                F.lit(name).alias("table_name"),
                F.lit(False).alias("present"),
                F.lit(0).cast("bigint").alias("rows"),
                F.lit(0).cast("bigint").alias("columns"),
                F.lit("").alias("column_names"),
            )
        else:
            part = df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("table_name"),
                F.lit(True).alias("present"),
                "rows",
                F.lit(len(df.columns)).cast("bigint").alias("columns"),
                F.lit(",".join(df.columns)).alias("column_names"),
            )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def read_batch_requests(
    df: DataFrame, body: str, schema: T.StructType, keep: list[str] | None = None, limit: int = K.MAX_REQUEST_CLIENTS
) -> tuple[DataFrame, DataFrame]:
    """Client records from JSON texts ``{"clients": [{...}, ...], "threshold": ...}``.

    Gives one typed row per client with the request's ``keep`` columns and ``threshold`` (NULL for the default),
    and the rejected requests with a ``reason``: ``clients`` where there is no list of 1 to ``limit`` clients,
    ``threshold`` where it is no number in 0..1. A batch score of a table has no such limit.
    """
    kept = [S.quoted(c) for c in keep or []]
    shape = "clients array<map<string,string>>, threshold string"
    parsed = df.select(*kept, S.quoted(body).alias("body"), F.from_json(S.quoted(body), shape).alias("_r"))
    size, threshold = F.coalesce(F.size("_r.clients"), F.lit(0)), F.col("_r.threshold").try_cast("double")
    fits = threshold.between(0, 1) | F.col("_r.threshold").isNull()
    reason = F.when((size < 1) | (size > limit), "clients").when(~F.coalesce(fits, F.lit(False)), "threshold")
    judged = parsed.withColumn("reason", reason)
    good = judged.where("reason IS NULL").select(*kept, threshold.alias("threshold"), F.explode("_r.clients").alias("features"))
    rows = good.select(*kept, "threshold", *[_field(f) for f in schema.fields])
    return rows, judged.where("reason IS NOT NULL").select(*kept, "body", "reason")


def _field(f: T.StructField) -> Column:
    """A field of ``features`` in its declared type; NULL where it does not parse."""
    raw = F.try_element_at("features", F.lit(f.name))
    if isinstance(f.dataType, T.IntegralType):
        return G.round_even_long(raw.try_cast("double")).cast(f.dataType).alias(f.name)
    if isinstance(f.dataType, T.NumericType):
        return G.finite(raw.try_cast("double")).cast(f.dataType).alias(f.name)
    return raw.try_cast(f.dataType).alias(f.name)


def read_requests(df: DataFrame, body: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Client records from JSON texts ``{"features": {...}}``.

    Gives the typed rows and the rejected texts (no features object, or an
    empty one).
    """
    parsed = df.select(
        S.quoted(body).alias("body"),
        F.from_json(S.quoted(body), "features map<string,string>")["features"].alias("features"),
    )
    usable = F.col("features").isNotNull() & (F.size("features") > 0)

    good = parsed.where(usable).select(*[_field(f) for f in schema.fields])
    return good, parsed.where(~F.coalesce(usable, F.lit(False))).select("body")
