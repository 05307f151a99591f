"""Diagnosis by votes of symptoms, and the question asked where votes are not clear."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vote(cases: DataFrame, table: DataFrame, soft: tuple[str, ...] = ()) -> DataFrame:
    """(case, status, label, top, second, tied): cases (case, symptom), table (symptom, label, ord).

    Each distinct symptom gives every label it may mean one vote.  The leading label is the diagnosis if
    it has two votes or more, leads by one, and not all its votes are of soft symptoms; no vote at all
    is a rejection; else the leading labels are to be told apart.  Ties go to the label voted first."""
    c = cases.select("case", "symptom").distinct()
    score = c.join(F.broadcast(table), "symptom").groupBy("case", "label").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.min((F.col("symptom").isin(*soft)).cast("int")).alias("soft"))
    w = W.partitionBy("case").orderBy(F.desc("n"), "ord")
    top = score.withColumn("rn", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("n").over(w), F.lit(0))).withColumn("best", F.max("n").over(W.partitionBy("case")))
    tied = top.where("n = best").groupBy("case").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"]), ",").alias("tied"))
    clear = (F.col("n") >= 2) & (F.col("n") - F.col("second") >= 1) & (F.col("soft") == 0)
    led = top.where("rn = 1").join(tied, "case").select("case", F.when(clear, "diagnosed").otherwise("need_clarification").alias("status"), F.when(clear, F.col("label")).alias("label"), F.col("n").alias("top"), "second", F.when(clear, F.lit("")).otherwise(F.col("tied")).alias("tied"))
    none = c.select("case").distinct().join(led, "case", "left_anti").select("case", F.lit("rejected").alias("status"), F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("second"), F.lit("").alias("tied"))
    return led.unionByName(none)


def question_for(votes: DataFrame, questions: DataFrame) -> DataFrame:
    """(case, question): the first question (ord, question, label) that concerns a tied label."""
    tied = votes.where("status = 'need_clarification'").select("case", F.explode(F.split("tied", ",")).alias("label"))
    return tied.join(F.broadcast(questions), "label").groupBy("case").agg(F.min_by("question", "ord").alias("question"))


def hints(votes: DataFrame, table: DataFrame, labels: int = 2, most: int = 6) -> DataFrame:
    """(case, hints): symptoms that speak for the first tied labels, to ask about where no question fits."""
    tied = votes.where("status = 'need_clarification'").select("case", F.posexplode(F.slice(F.split("tied", ","), 1, labels)).alias("at", "label"))
    met = tied.join(F.broadcast(table), "label").groupBy("case", "symptom").agg(F.min(F.struct("at", "ord")).alias("o"))
    w = W.partitionBy("case").orderBy("o", "symptom")
    few = met.withColumn("rn", F.row_number().over(w)).where(f"rn <= {most}")
    return few.groupBy("case").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "symptom"))), lambda x: x["symptom"]), "、").alias("hints"))


def round_trip(cases: DataFrame, answers: DataFrame, table: DataFrame, soft: tuple[str, ...] = ()) -> DataFrame:
    """Votes after the symptoms that were chosen when asked have joined the cases."""
    return vote(cases.select("case", "symptom").unionByName(answers.select("case", "symptom")), table, soft)


def layered(votes: DataFrame, evidence: DataFrame, advice: DataFrame, closing: str) -> DataFrame:
    """(case, answer): direction with its evidence, advice for the label, and a closing, as sections.

    Sections whose parts are missing are left out; cases without a diagnosis get no answer."""
    e = evidence.groupBy("case").agg(F.array_join(F.array_sort(F.collect_set("symptom")), "、").alias("e"))
    v = votes.where("status = 'diagnosed'").join(e, "case", "left").join(F.broadcast(advice.select("label", "advice")), "label", "left")
    first = F.concat(F.lit("【方向】"), F.col("label"), F.coalesce(F.concat(F.lit("。依据："), F.nullif("e", F.lit(""))), F.lit("")))
    return v.select("case", F.concat_ws("\n\n", first, F.concat(F.lit("【建议】"), F.col("advice")), F.lit(closing)).alias("answer"))
