"""Fusing rankings and filling them up from further candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_rank(lists: list[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """(query, doc, score, distance, rank) from rankings (query, doc, rank), ranks from 1.

    A document scores the sum of 1 / (k + rank); ties go to the one met first (list, then rank);
    distance is 1 minus the share of the query's best score."""
    tagged = reduce(DataFrame.unionByName, [x.select("query", "doc", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    fused = tagged.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("first"))
    w = W.partitionBy("query")
    out = fused.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "first", "doc"))).withColumn("distance", F.round(1 - F.col("score") / F.max("score").over(w), 6))
    out = out.select("query", "doc", F.round("score", 6).alias("score"), "distance", F.col("rank").cast("long").alias("rank"))
    return out.where(f"rank <= {top}") if top else out


def filled(stages: list[DataFrame], k: int) -> DataFrame:
    """(query, doc, stage, rank): candidates of the first stage, then of the next those not yet there, up to k."""
    tagged = reduce(DataFrame.unionByName, [x.select("query", "doc", F.struct(F.lit(i).alias("stage"), F.col("rank")).alias("at")) for i, x in enumerate(stages)])
    first = tagged.groupBy("query", "doc").agg(F.min("at").alias("at"))
    w = W.partitionBy("query").orderBy("at", "doc")
    return first.withColumn("n", F.row_number().over(w)).where(f"n <= {k}").select("query", "doc", F.col("at.stage").alias("stage"), F.col("n").cast("long").alias("rank"))
