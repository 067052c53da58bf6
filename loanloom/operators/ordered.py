"""Running totals and exact quantiles over values too many for one task.

Values are first counted, then placed in equi-depth buckets whose bounds come
from a mergeable quantile sketch. Only the bucket totals (a few per task and
group) are accumulated in one place; inside a bucket an ordinary window does
the rest, so no task ever sorts a whole column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanloom.functions import schema as S
from loanloom.functions.guards import double_array

LEAST_BUCKETS = 256
SKETCH_ACCURACY = 4096


def bucket_count(df: DataFrame) -> int:
    """Buckets per group: as many as a shuffle has partitions, and not too few."""
    return max(LEAST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sketch_bounds(value: Column, buckets: int) -> Column:
    """Aggregate: ascending equi-depth bounds between the buckets of a column."""
    points = double_array(i / buckets for i in range(1, buckets))
    return F.percentile_approx(value, points, max(SKETCH_ACCURACY, 16 * buckets))


def count_below(value: Column, bounds: Column, size: int, inclusive: bool = False) -> Column:
    """How many of an ascending array's numbers lie below the value (binary search).

    ``inclusive`` also counts numbers equal to the value. Missing bounds count
    as not below.
    """
    steps = [1 << i for i in range(max(size, 1).bit_length() - 1, -1, -1)]

    def advance(found: Column, step: Column) -> Column:
        bound = F.get(bounds, found + step - 1)
        passed = (bound <= value) if inclusive else (bound < value)
        return F.when(passed, found + step).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def add_bucket(df: DataFrame, value: str, bounds: str, buckets: int) -> DataFrame:
    """Adds ``bucket`` from a column of bounds and drops the bounds."""
    return df.withColumn("bucket", count_below(F.col(value), F.col(bounds), buckets - 1)).drop(bounds)


def attach(df: DataFrame, info: DataFrame, by: list[str]) -> DataFrame:
    """Attach each group's one row of bounds and totals."""
    if not by:
        one = info.select(F.struct("*").alias("s")).scalar()
        return df.withColumn("_s", one).select(*df.columns, "_s.*")
    # groups are features, sides or folds: as many as the schema or the chart has
    return df.join(F.broadcast(info), by)


def running_totals(
    counts: DataFrame, by: list[str], value: str, measures: list[str]
) -> DataFrame:
    """Cumulative and overall measures in value order.

    ``counts`` is an aggregation with one row per (by, value) and no other
    columns than the measures. Adds, for each measure ``m``, ``m_upto`` (values
    up to and including the row's), ``m_below`` (strictly below) and ``m_all``
    (the whole group). Callers should use every ``m_all``, see below.
    """
    buckets = bucket_count(counts)
    stats = counts.groupBy(*by).agg(
        sketch_bounds(F.col(value), buckets).alias("bounds"), *[F.sum(m).alias(f"{m}_all") for m in measures]
    )
    placed = add_bucket(attach(counts, stats, by), value, "bounds", buckets)
    # ``m_all`` refers to every part it can be read from (they agree): so no
    # branch is pruned differently, and all share one shuffle of the counts
    totals = placed.groupBy(*by, "bucket").agg(
        *[F.sum(m).alias(m) for m in measures],
        *[F.max(f"{m}_all").alias(f"{m}_whole") for m in measures],
    )
    earlier = W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *by,
        "bucket",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_base") for m in measures],
        *[f"{m}_whole" for m in measures],
    )
    upto = W.partitionBy(*by, "bucket").orderBy(value)
    upto = upto.rowsBetween(W.unboundedPreceding, W.currentRow)
    # a left join: an inner one would infer "bucket is known" and filter the
    # raw rows of this branch by it, so that its counts could not be shared
    joined = placed.join(offsets, [*by, "bucket"], "left")
    found = []
    for m in measures:
        run = F.sum(m).over(upto) + F.col(f"{m}_base")
        found += [
            run.alias(f"{m}_upto"),
            (run - F.col(m)).alias(f"{m}_below"),
            F.greatest(f"{m}_all", f"{m}_whole", f"{m}_base").alias(f"{m}_all"),
        ]
    return joined.select(*by, value, *measures, *found)


# ------------------------------------------------------------------- quantiles

DIGIT = 12
FINISH = 1 << 20  # so few values are put in order at once


def with_order_bits(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``bits``: a double as a long in the same order, from sign, exponent and mantissa.

    Both zeros are 0; NaN follows infinity. Each step is a projection of its own, which
    keeps a logarithm that is used several times from being computed several times.
    """
    own, size = F.col(value), F.abs(F.col(value))
    guess = F.greatest(F.least(F.coalesce(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023)), F.lit(-1022))
    scaled = size / F.pow(F.lit(2.0), F.col("_exponent"))
    # a logarithm near a whole number may be one off; below 2 ** -1022 the mantissa stays below 1
    up, down = F.col("_scaled") >= 2, (F.col("_scaled") < 1) & (F.col("_exponent") > -1022)
    step = F.when(up, 1).when(down, -1).otherwise(0)
    mantissa = F.when(up, F.col("_scaled") / 2).when(down, F.col("_scaled") * 2).otherwise(F.col("_scaled"))
    whole = F.col("_exponent").cast("long") + step + 1022
    bits = F.shiftleft(whole, 52) + (mantissa * F.lit(2.0**52)).cast("long")
    endless = F.lit(2047 << 52)
    found = F.when(F.isnan(own), endless + 1).when(size == float("inf"), endless).otherwise(bits)
    staged = df.withColumn("_exponent", guess).withColumn("_scaled", scaled).withColumn("bits", found)
    return staged.withColumn("bits", F.when(own < 0, -F.col("bits")).otherwise(F.col("bits"))).drop("_exponent", "_scaled")


def _name(p: float) -> str:
    return f"q{p * 100:g}".replace(".", "_")


def quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    by: list[str] | None = None,
    method: str = "exact",
) -> DataFrame:
    """Interpolated quantiles: one row per (by, feature), one column per probability.

    NULLs are skipped; a column without values gives no row. ``approximate`` takes a sketch instead.

    Exact selection by digits: a scan counts the values of each feature by the first 12 bits of
    their order inside the tasks, so a few counts per feature are shuffled, not
    its values. Only values that share the leading bits of a wanted rank are counted by their next 12 bits, until
    no more than FINISH are left, which are put in order, or until all bits are
    known: six scans at most. The first scans run when the plan is built.
    """
    by = by or []
    if method == "approximate":
        return _approximate(df, columns, probabilities, by)
    if method != "exact":
        raise ValueError(f"unknown quantile method: {method!r}")
    group = [*by, "feature"]
    long = S.to_long(df, columns, by)
    spots = [F.lit(float(p)) * (F.col("n_all") - 1) for p in probabilities]
    ranks = [rank(spot) for spot in spots for rank in (F.floor, F.ceil)]
    shift = 64 - DIGIT
    found = _digit_counts(long, group, shift, ranks, None)
    while shift and sum(r["n"] for r in found.rows if r["low"] != r["high"]) > FINISH:
        shift = max(0, shift - DIGIT)
        found = _digit_counts(_in_wanted(long, found, group), group, shift, ranks, found)
    # a bin of equal values needs none of them
    open_ = _in_wanted(long, found, group).where(~F.col("low").eqNullSafe(F.col("high")))
    bins = open_.groupBy(*group, "base", "n", "n_all").agg(F.sort_array(F.collect_list("value")).alias("values"))
    closed = found.frame.where(F.col("low").eqNullSafe(F.col("high")))
    bins = bins.unionByName(closed.select(*group, "base", "n", "n_all", F.array("low").alias("values")))

    def value_at(rank: Column) -> Column:
        place = rank - F.col("base")
        inside = (place >= 0) & (place < F.col("n"))
        return F.max(F.when(inside, F.get("values", F.least(place, F.size("values") - 1).cast("int"))))

    cells, columns_out = [], []
    for i, (p, spot) in enumerate(zip(probabilities, spots)):
        cells += [
            value_at(F.floor(spot)).alias(f"lo{i}"),
            value_at(F.ceil(spot)).alias(f"hi{i}"),
            F.max(spot - F.floor(spot)).alias(f"part{i}"),
        ]
        between = F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"part{i}")
        columns_out.append(between.alias(_name(p)))
    return bins.groupBy(*group).agg(*cells).select(*group, *columns_out)


@dataclass
class _Wanted:
    """Bins that hold a wanted rank, few per feature.

    Group, lowest and highest value, base (values before the bin), n, n_all (values of the group).
    """

    rows: list
    frame: DataFrame


def _digit_counts(
    values: DataFrame, group: list[str], shift: int, ranks: list[Column], inside: _Wanted | None
) -> _Wanted:
    """Counts by the bits above ``shift``; of these the bins with a wanted rank.

    After the first digit the values come with the bin they were ``inside``.
    """
    old = ["base", "n_all"] if inside else []
    here = F.shiftright("bits", shift).alias("bin")
    counts = (
        with_order_bits(values.select(*group, *old, "value"))
        .select(*group, *old, here, "value")
        .groupBy(*group, *old, "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    lower = W.partitionBy(*group, *old).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(lower), F.lit(0))
    if inside:
        placed = counts.withColumn("base", F.col("base") + before)
    else:
        placed = counts.withColumns({"base": before, "n_all": F.sum("n").over(W.partitionBy(*group))})
    end = F.col("base") + F.col("n")
    held = reduce(or_, [(F.col("base") <= rank) & (rank < end) for rank in ranks])
    chosen = placed.where(held).select(*group, "low", "high", "base", "n", "n_all")
    # at most two bins per probability, feature and group
    found = chosen.collect()
    return _Wanted(found, values.sparkSession.createDataFrame(found, chosen.schema))


def _in_wanted(long: DataFrame, wanted: _Wanted, group: list[str]) -> DataFrame:
    """The values that lie in a wanted bin, with that bin."""
    bins = wanted.frame.select(*[F.col(c).alias(f"_{c}") for c in group], "low", "high", "base", "n", "n_all")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    held = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    # at most two bins per probability, feature and group
    joined = long.join(F.broadcast(bins), reduce(and_, [*same, held]))
    return joined.select(*group, "value", "low", "high", "base", "n", "n_all")


def _approximate(df, columns, probabilities, by):
    points = double_array(probabilities)
    long = S.to_long(df, columns, by)
    rows = long.groupBy(*by, "feature").agg(
        F.percentile_approx("value", points, SKETCH_ACCURACY).alias("qs")
    )
    return rows.where(F.col("qs").isNotNull()).select(
        *by, "feature", *[F.col("qs")[i].alias(_name(p)) for i, p in enumerate(probabilities)]
    )
