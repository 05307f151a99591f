"""Measures of retrieval and of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cjk_words


def hit(retrieved: Column, wanted: Column, k: int = 5) -> Column:
    """Some wanted id is among the first k retrieved; null where nothing is wanted."""
    return F.when(F.size(wanted) > 0, F.coalesce(F.arrays_overlap(F.slice(retrieved, 1, k), wanted), F.lit(False)).cast("double"))


def hit_rate(df: DataFrame, retrieved: str, wanted: str, by: list[str], k: int = 5) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.round(F.coalesce(F.avg(hit(F.col(retrieved), F.col(wanted), k)), F.lit(0.0)), 6).alias("hit_rate"))


def keyword_share(expected: Column, answer: Column) -> Column:
    """Share of the expected text's distinct words that the answer contains; 1 if it has none."""
    words = cjk_words(F.coalesce(expected, F.lit("")))
    have = F.size(F.filter(words, lambda w: F.contains(F.coalesce(answer, F.lit("")), w)))
    return F.when(F.size(words) > 0, have / F.size(words)).otherwise(1.0)


def latency(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Exact percentiles by linear interpolation."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))
    g = df.groupBy(*by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"), p.alias("p"))
    return g.select(*by, "min", "max", "mean", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))


def judge(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Mean and median of valid scores (0 or more)."""
    return df.where(F.col(score) >= 0).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.median(score), 6).alias("median"))


def improvement(base: Column, now: Column) -> Column:
    """Change in percent; 0 where the base is not positive."""
    return F.when(base > 0, F.round((now - base) / base * 100, 6)).otherwise(0.0)
