"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C
from .tokens import token_counts

#: Parts of the hash range in which tokens are summed before the cut is found inside one of them.
BUCKETS = 4096
#: Rows that a table of targets may have; it is a table of settings.
MOST_TARGETS = 100_000


def water_fill(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens each source gives to a mix of ``total`` tokens.

    A source can give at most its tokens times its repetitions.  Sources whose share exceeds that
    are clamped, and what they lack goes to the others in proportion to their weights, until it
    fits.  Without a total it is the largest one for which no source with tokens is clamped, so the
    target shares are met."""
    cap = {s: tokens.get(s, 0) * max(0, r) for s, w, r in targets if w > 0}
    open_ = {s: w for s, w, _ in targets if w > 0 and cap[s] > 0}
    if not open_:
        return {}
    if total is None:
        weight = sum(open_.values())
        total = min(cap[s] * weight / w for s, w in open_.items())
    out: dict[str, float] = {}
    left = total
    while open_:
        weight = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / weight > cap[s] * (1 + 1e-12)]
        if not over:
            return out | {s: left * w / weight for s, w in open_.items()}
        for s in over:
            out[s] = float(cap[s])
            left -= cap[s]
            del open_[s]
    return out


def mixed(df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", total: float | None = None, seed: int = 42, of_all: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): selection (id, source, tokens, repeats); shares per source.

    Method: capped water-filling over the sources' tokens gives each a number of tokens; whole
    repetitions take every record, and the fractional one takes records in the order of a seeded
    hash until the number is reached.  The cut in that order is found from sums over BUCKETS parts
    of the hash range and then inside one part, so no source is sorted as a whole.  To the driver
    come one sum per target.  Records with no tokens or a source without target are left out;
    a null source has no target; a null id is kept as null; repeated rows are records each; targets
    that are null or not positive, and sources without tokens, get nothing (their weight goes to the
    others); an empty table gives no rows; other columns are ignored.  ``of_all`` states the total as a
    multiple of the tokens that the sources with a target hold; a total beyond what the scarcest
    source can share in clamps that source and gives the rest of its weight to the others.
    """
    rows = C.cut(token_counts(df, id_col, text, (source,)).where("tokens > 0").withColumnRenamed(source, "source_").select("id", F.col("source_").alias("source"), "tokens"))
    goal = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("w"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("r")).limit(MOST_TARGETS + 1)
    have = {r["source"]: r["n"] for r in rows.join(F.broadcast(goal), "source").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    wanted = [(r["source"], float(r["w"]), int(r["r"])) for r in goal.collect()]
    if len(wanted) > MOST_TARGETS:
        raise ValueError("too many targets")
    give = water_fill(wanted, have, total if of_all is None else of_all * sum(have.values()))
    plan = [(s, w, r, have.get(s, 0), give.get(s, 0.0), int((give.get(s, 0.0) + 1e-6) // have[s]) if have.get(s) else 0) for s, w, r in wanted]
    spark = df.sparkSession
    plan_df = spark.createDataFrame(plan or [("", 0.0, 0, 0, 0.0, 0)], "source string, target_share double, max_repeats int, source_tokens long, goal double, whole long").where("source_tokens > 0 or goal = 0")
    if not plan:
        plan_df = plan_df.limit(0)
    h = F.xxhash64(F.lit(seed), "id", "tokens")
    all_ = rows.join(F.broadcast(plan_df), "source").withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 52))
    part = F.col("goal") - F.col("whole") * F.col("source_tokens")
    sums = all_.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"))
    at = all_.join(before, ["source", "bucket"])
    sure = at.where(F.col("before") + F.col("n") <= part + 1e-6).select("id", "source", "tokens", "whole", F.lit(1).alias("extra"))
    never = at.where((F.col("before") + F.col("n") > part + 1e-6) & (F.col("before") >= part)).select("id", "source", "tokens", "whole", F.lit(0).alias("extra"))
    edge = at.where((F.col("before") + F.col("n") > part + 1e-6) & (F.col("before") < part))
    run = F.sum("tokens").over(W.partitionBy("source").orderBy(F.shiftleft("h", 12), "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = edge.withColumn("run", F.col("before") + run).select("id", "source", "tokens", "whole", (F.col("run") - F.col("tokens") / 2 <= part + 1e-6).cast("int").alias("extra"))
    chosen = sure.unionByName(never).unionByName(edge).withColumn("repeats", F.col("whole") + F.col("extra")).where("repeats > 0").select("id", "source", "tokens", "repeats")
    chosen = C.cut(chosen)
    got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("repeats").alias("most_repeats"))
    sum_ = got.agg(F.sum("tokens").alias("all_tokens"))
    shares = plan_df.join(got, "source", "left").join(sum_, F.lit(True)).select(
        "source", "target_share", "max_repeats", "source_tokens", F.round("goal", 0).cast("long").alias("goal_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.round(F.coalesce("tokens", F.lit(0)) / F.col("all_tokens"), 6).alias("actual_share"),
    )
    return chosen.withColumnRenamed("id", "doc_id"), shares
