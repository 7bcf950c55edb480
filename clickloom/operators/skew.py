"""Options for skewed keys.

Adaptive execution splits skewed join partitions and partial aggregation combines before the exchange, so plain joins and
groupBy are the default. These forms serve where keys are known to be skewed beyond that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def broadcast_join(left: DataFrame, right: DataFrame, on: str, most_rows: int = 1_000_000) -> DataFrame:
    """Inner join that broadcasts the right side if it has at most most_rows rows, else leaves the choice to Spark."""
    small = right.limit(most_rows + 1).count() <= most_rows
    return left.join(F.broadcast(right) if small else right, on)


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int = 10, spread: Column | None = None) -> DataFrame:
    """Inner join with every key of the left split over the salts 0 to salts-1 and the right repeated for exactly those.

    spread decides a row's salt (by default a hash of the whole row), so that recomputed rows keep theirs.
    """
    salt = F.pmod(F.xxhash64(*(left.columns if spread is None else [spread])), F.lit(salts)).cast("int")
    many = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", salt).join(many, [on, "__salt"]).drop("__salt")


def hot_keys(rows: DataFrame, key: str, n: int = 1, fraction: float = 0.1, seed: int = 9, by: str | None = None) -> DataFrame:
    """The n most frequent keys of a sample, with their counts in it.

    With ``by``, a column that tells rows apart, a row is drawn if the first 16 bits of a hash of the seed and that column are below the fraction:
    the same rows whatever the partitions, and in any engine. Without, it is a Bernoulli sample.
    """
    if by is None:
        drawn = rows.sample(fraction, seed=seed)
    else:
        first = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string")).cast("binary")), 1, 4)
        drawn = rows.where(first < f"{int(fraction * 65536):04x}") if fraction < 1 else rows
    return drawn.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def heavy_hitters(rows: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """(key, n): every key that holds at least ``share`` of the rows with a key, with its exact count, most frequent first.

    A mergeable sketch of frequent items over all rows, one a task and merged by Spark, keeps at most ``tracked`` keys; it misses none whose count is
    above 3.5 / tracked of the rows, which is less than half the share. What it keeps is counted exactly in a second pass, in which every task
    adds up a bounded number of keys.
    """
    if not 1e-5 <= share <= 1:
        raise ValueError("share lies between 0.00001 and 1")
    tracked = 1 << (math.ceil(8 / share) - 1).bit_length()
    own = rows.where(F.col(key).isNotNull()).select(key)
    total = own.count()
    likely = own.agg(F.expr(f"approx_top_k(`{key}`, {tracked * 3 // 4}, {tracked})").alias("t")).select(F.explode("t").alias("t")).select(F.col("t.item").alias(key)).distinct()
    counted = own.join(F.broadcast(likely), key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))  # at most tracked keys
    return counted.where(F.col("n") >= share * total).orderBy(F.desc("n"), key)


def balanced(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt anew into partitions of Spark's advisory size, near their keys where keys are given: what is known to be wide or skewed is
    split, and small parts are joined. For writes and for inputs of costly steps; a join or an aggregation by the same keys exchanges for itself."""
    return rows.hint("rebalance", *keys)


def split_join(left: DataFrame, right: DataFrame, on: str, hot: list, salts: int = 100) -> DataFrame:
    """Inner join in which only the hot keys are salted; the union of both halves is the plain join."""
    is_hot = F.coalesce(F.col(on).isin(*hot), F.lit(False)) if hot else F.lit(False)
    busy = salted_join(left.where(is_hot), right.where(is_hot), on, salts)
    return busy.unionByName(left.where(~is_hot).join(right.where(~is_hot), on).select(*busy.columns))


def two_stage_count(rows: DataFrame, key: str, salts: int = 10) -> DataFrame:
    """Count by key in two stages, first by key and salt."""
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
    first = rows.groupBy(key, salt.alias("__salt")).agg(F.count("*").alias("n"))
    return first.groupBy(key).agg(F.sum("n").alias("n"))
