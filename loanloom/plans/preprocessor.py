"""Missing-value-aware preprocessing fitted once and applied as one projection."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom import constants as K
from loanloom.functions import guards as G
from loanloom.functions import schema as S
from loanloom.operators.ordered import quantiles
from loanloom.operators.profile import column_stats, null_ratios
from loanloom.session import ensure_checkpoint_dir, materialize, scratch_path

LABELS = "value string, rows long, code long, feature string"
FEW_CLASSES = 256  # columns with more are joined with their labels


def class_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (feature, class); a missing value is a class of its own."""
    cell = f"coalesce(CAST({{0}} AS STRING), '{K.MISSING_CLASS}')"
    long = S.to_long(df, columns, cell=cell)
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))


def class_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Label table (feature, value, rows, code): code is the rank in sorted order.

    Classes are range-partitioned and counted per partition, so a column with
    very many classes is ranked without gathering it in one task.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = class_counts(df, columns).repartitionByRange("feature", "value")
    # the partition numbers must not change between the two uses
    placed = ordered.withColumn("part", F.spark_partition_id()).checkpoint()
    totals = placed.groupBy("feature", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("feature").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "feature", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    inside = W.partitionBy("feature", "part").orderBy("value")
    # one offset per (feature, partition)
    return placed.join(F.broadcast(offsets), ["feature", "part"]).select(
        "feature",
        "value",
        "rows",
        (F.row_number().over(inside) - 1 + F.col("base")).alias("code"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS).parquet(path)


@dataclass
class FittedColumn:
    """State of one feature: how it is encoded, filled and scaled."""

    name: str
    is_text: bool
    fill: float
    mean: float | None = None
    std: float | None = None
    unknown_code: int | None = None
    classes: int | None = None


@dataclass
class FittedState:
    columns: list[FittedColumn] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    impute: str = "median"
    scale: bool = False
    rows: int = 0
    labels_path: str | None = None
    input_schema: str | None = None


class ClientPreprocessor(Estimator):
    """Drops sparse columns, encodes text, fills missing values, optionally scales.

    Text classes get their rank in sorted order, a missing value counting as
    class ``MISSING``. A class unseen in the fit becomes ``MISSING``, and
    when the fit saw no missing value either, it gets the next free code.
    """

    def __init__(
        self,
        impute: str = "median",
        scale: bool = False,
        drop_high_nan: float = 0.8,
        quantile_method: str = "exact",
        ignore: tuple[str, ...] = (K.CLIENT_KEY, K.TARGET, "split"),
    ):
        super().__init__()
        if impute not in ("mean", "median", "most_frequent"):
            raise ValueError(f"unknown imputation strategy: {impute!r}")
        self.impute = impute
        self.scale = scale
        self.drop_high_nan = drop_high_nan
        self.quantile_method = quantile_method
        self.ignore = ignore

    def _fit(self, df: DataFrame) -> ClientPreprocessorModel:
        candidates = [c for c in df.columns if c not in self.ignore]
        ratios = null_ratios(df, candidates)
        dropped = [c for c in candidates if ratios[c] > self.drop_high_nan]
        features = [c for c in candidates if c not in dropped]
        text = [c for c in features if c in set(S.string_columns(df))]
        state = FittedState(
            columns=[FittedColumn(c, c in text, 0.0) for c in features],
            dropped=dropped + [c for c in self.ignore if c in df.columns],
            impute=self.impute,
            scale=self.scale,
            input_schema=df.select(*[S.quoted(c) for c in features]).schema.json(),
        )
        self._fit_classes(df, state, text)
        model = ClientPreprocessorModel(state)
        self._fit_fills(model.encode(df), state)
        if self.scale:
            self._fit_scale(model.filled(df), state)
        return model

    def _fit_classes(self, df: DataFrame, state: FittedState, text: list[str]) -> None:
        """Write the label table of all text columns; a value it lacks takes ``unknown_code``."""
        if not text:
            return
        state.labels_path = scratch_path(df.sparkSession, "labels")
        class_codes(df, text).write.partitionBy("feature").parquet(state.labels_path)
        labels = read_labels(df.sparkSession, state.labels_path)
        missing = F.max(F.when(F.col("value") == K.MISSING_CLASS, F.col("code")))
        unknown = F.coalesce(missing, F.count(F.lit(1))).alias("code")
        # one row per text column
        found = labels.groupBy("feature").agg(unknown, F.count(F.lit(1)).alias("classes")).collect()
        codes = {r["feature"]: (r["code"], r["classes"]) for r in found}
        for c in state.columns:
            if c.is_text:
                c.unknown_code, c.classes = codes.get(c.name, (0, 0))

    def _fit_fills(self, encoded: DataFrame, state: FittedState) -> None:
        names = [c.name for c in state.columns]
        if self.impute == "mean":
            rows = column_stats(encoded, names, {"fill": F.avg})
        elif self.impute == "median":
            rows = quantiles(encoded, names, [0.5], method=self.quantile_method)
            rows = rows.withColumnRenamed("q50", "fill")
        else:
            counts = S.to_long(encoded, names).groupBy("feature", "value").agg(
                F.count(F.lit(1)).alias("rows")
            )
            rows = counts.groupBy("feature").agg(
                F.min_by("value", F.struct(-F.col("rows"), F.col("value"))).alias("fill")
            )
        fills = {r["feature"]: r["fill"] for r in rows.collect()}  # one row per feature
        for c in state.columns:
            value = fills.get(c.name)
            c.fill = 0.0 if value is None else float(value)

    def _fit_scale(self, filled: DataFrame, state: FittedState) -> None:
        names = [c.name for c in state.columns]
        stats = column_stats(filled, names, {"mean": F.avg, "std": F.stddev_pop})
        found = {r["feature"]: r for r in stats.collect()}  # one row per feature
        for c in state.columns:
            row = found.get(c.name)
            c.mean = float(row["mean"]) if row else 0.0
            c.std = float(row["std"]) if row and row["std"] else 1.0


class ClientPreprocessorModel(Model):
    """Fitted preprocessing; applying it adds no shuffle unless a column has many classes.

    The label table lies in the scratch folder until :meth:`save` copies it to
    the model; keep the scratch folder as long as an unsaved model is in use.
    """

    def __init__(self, state: FittedState | None):
        super().__init__()
        self.state = state

    @property
    def feature_names(self) -> list[str]:
        return [c.name for c in self._fitted().columns]

    def _fitted(self) -> FittedState:
        if self.state is None:
            raise ValueError("the preprocessor must be fitted before it is applied")
        return self.state

    def _passed(self, df: DataFrame) -> list[str]:
        names = set(self.feature_names)
        return [c for c in (K.CLIENT_KEY, K.TARGET, "split") if c in df.columns and c not in names]

    def encode(self, df: DataFrame) -> DataFrame:
        """Fitted columns as doubles; NULL where a number is missing or a column absent."""
        state = self._fitted()
        have = set(df.columns)
        text = [c for c in state.columns if c.is_text and c.name in have]
        few = [c for c in text if c.classes is not None and c.classes <= FEW_CLASSES]
        if few:
            df = self._encode_few(df, few)
        for c in text:
            if c not in few:
                df = self._encode_text(df, c)

        def one(c: FittedColumn) -> Column:
            if c.name not in have:
                # an absent text column is filled like a number, not encoded as MISSING
                return F.lit(None).cast("double").alias(c.name)
            return S.quoted(c.name).cast("double").alias(c.name)

        return df.select(*[S.quoted(k) for k in self._passed(df)], *[one(c) for c in state.columns])

    def _encode_few(self, df: DataFrame, columns: list[FittedColumn]) -> DataFrame:
        """Text columns with few classes as their codes: one row of maps for all of them, no join.

        The row holds at most FEW_CLASSES entries per column.
        """
        labels = read_labels(df.sparkSession, self.state.labels_path)
        labels = labels.where(F.col("feature").isin([c.name for c in columns]))
        entry = F.struct("value", "code")
        maps = [
            F.map_from_entries(F.collect_list(F.when(F.col("feature") == c.name, entry))).alias(f"m{i}")
            for i, c in enumerate(columns)
        ]
        known = df.withColumn("_codes", labels.agg(*maps).select(F.struct("*").alias("c")).scalar())

        def code(i: int, c: FittedColumn) -> Column:
            value = F.coalesce(S.quoted(c.name).cast("string"), F.lit(K.MISSING_CLASS))
            return F.coalesce(F.try_element_at(F.col(f"_codes.m{i}"), value), F.lit(c.unknown_code)).cast("double")

        return known.withColumns({c.name: code(i, c) for i, c in enumerate(columns)}).drop("_codes")

    def _encode_text(self, df: DataFrame, c: FittedColumn) -> DataFrame:
        """A text column as its class code, by a join with the column's labels.

        Spark broadcasts the labels of a column with few classes and shuffles
        and splits the join of one with many.
        """
        labels = read_labels(df.sparkSession, self.state.labels_path).where(F.col("feature") == c.name)
        labels = labels.select(F.col("value").alias("_class"), F.col("code").alias("_code"))
        value = F.coalesce(S.quoted(c.name).cast("string"), F.lit(K.MISSING_CLASS))
        joined = df.withColumn("_class", value).join(labels, "_class", "left")
        code = F.coalesce(F.col("_code"), F.lit(c.unknown_code)).cast("double")
        return joined.withColumn(c.name, code).select(*[S.quoted(k) for k in df.columns])

    def filled(self, df: DataFrame) -> DataFrame:
        """Encoded columns with missing values replaced."""
        encoded = self.encode(df)
        return encoded.withColumns(
            {c.name: F.coalesce(S.quoted(c.name), F.lit(c.fill)) for c in self.state.columns}
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self._fitted()
        out = self.filled(df)
        if not state.scale:
            return out
        return out.withColumns(
            {
                c.name: (S.quoted(c.name) - F.lit(c.mean)) / F.lit(c.std or 1.0)
                for c in state.columns
            }
        )

    # ------------------------------------------------------------- persistence

    def save(self, spark: SparkSession, path: str) -> None:
        """State as one JSON text file, large label tables as parquet beside it."""
        state = asdict(self._fitted())
        if state["labels_path"]:
            target = f"{path}/labels"
            read_labels(spark, state["labels_path"]).write.mode("overwrite").partitionBy("feature").parquet(target)
            state["labels_path"] = target
        rows = spark.createDataFrame([(json.dumps(state, ensure_ascii=False),)], "value string")
        rows.write.mode("overwrite").text(f"{path}/state")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClientPreprocessorModel:
        text = "\n".join(r["value"] for r in spark.read.text(f"{path}/state").collect())
        raw = json.loads(text)
        raw["columns"] = [FittedColumn(**c) for c in raw["columns"]]
        return cls(FittedState(**raw))


def prepare_train_test(
    wide: DataFrame, preprocessor: ClientPreprocessor | None = None
) -> tuple[DataFrame, ClientPreprocessorModel]:
    """Fit on the train rows of the wide table and transform all of it.

    The fit takes several passes, so the joins behind the wide table are run
    once and their result is kept.
    """
    preprocessor = preprocessor or ClientPreprocessor()
    stored = materialize(wide, "wide")
    model = preprocessor.fit(stored.where(F.col("split") == "train"))
    return model.transform(stored), model
