"""Joining facts to a lookup table when a few keys own much of the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARES = 4  # a key is dealt out when it owns more than a quarter of a partition's share


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Left join of facts to a lookup with one row per key.

    ``weight`` is how many fact rows each key has (or an estimate). A key with
    more than a quarter of a partition's share is dealt out over as many salts as it
    has quarters: its facts get a salt from the row's content and its lookup row
    one copy per salt. Everything else joins once, so no key's facts end up in
    one task and no fact is lost.
    """
    parts = SHARES * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lookup.select(F.sum(weight).alias("t")).scalar()
    salts = F.ceil(F.col(weight) * parts / total).cast("int")
    # fewer than ``parts`` keys can own more than 1 / parts of the weight
    heavy = lookup.where(F.col(weight) * parts > total)
    hot = F.broadcast(heavy.select(*keys, salts.alias("_salts")))
    salt = F.pmod(F.xxhash64(*facts.columns), F.col("_salts")).cast("int")
    salted = facts.join(hot, keys, "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    spread = lookup.drop(weight).join(hot, keys, "left").withColumn("_salt", F.explode(copies))
    return salted.join(spread.drop("_salts"), [*keys, "_salt"], "left").drop("_salt")
