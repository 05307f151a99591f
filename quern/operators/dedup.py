"""Keeping firsts, exact splits and mixes, all with a defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by_prefix(df: DataFrame, text: str, order: str, length: int = 100) -> DataFrame:
    """The first row (by order) of each prefix; a null text is a prefix of its own.

    Done as a minimum per prefix, combined before the shuffle, and a join on it, so a prefix that a
    third of all rows share needs no window over them."""
    keep = df.groupBy(F.xxhash64(F.left(F.col(text), F.lit(length))).alias("_p"), F.left(F.col(text), F.lit(length)).alias("_t")).agg(F.min(order).alias(order)).select(order)
    return df.join(keep, order, "left_semi")


def order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def first_n(df: DataFrame, key: str, want: int, seed: int = 42) -> DataFrame:
    """df with ``chosen``: true for exactly the first ``want`` rows in a seeded order.

    The cut is found by counting rows per leading hex digits of the order, then inside one such part;
    nothing is sorted as a whole and nothing but 4096 counts is broadcast."""
    d = df.withColumn("_k", order_key(key, seed)).withColumn("_b", F.substring("_k", 1, 3))
    per = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_m"))
    before = per.withColumn("_n", F.sum("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_m"))
    d = d.join(F.broadcast(before), "_b")
    split = f"_n < {want} and _n + _m > {want}"
    inside = d.where(split).withColumn("chosen", F.row_number().over(W.partitionBy("_b").orderBy("_k", key)) + F.col("_n") <= want)
    rest = d.where(f"not ({split})").withColumn("chosen", F.col("_n") + F.col("_m") <= want)
    return rest.unionByName(inside).drop("_k", "_b", "_m", "_n")


def exact_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """df with ``part``: exactly int(n * share) rows, the first in a seeded order, are 'val', the rest 'train'."""
    done = first_n(df, key, int(df.count() * share), seed)
    return done.withColumn("part", F.when(F.col("chosen"), "val").otherwise("train")).drop("chosen")


def ratio_mix(base: DataFrame, extra: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """base and as many rows of extra, by seeded order, as make base ``ratio`` of the whole."""
    want = int(base.count() * (1 - ratio) / ratio)
    return base.unionByName(first_n(extra, key, want, seed).where("chosen").drop("chosen"))
