"""BM25 ranking as joins and aggregates over postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bigrams
from ..session import cut


def postings(docs: DataFrame, key: str, text: str, tokenize: Callable[[Column], Column] = bigrams) -> DataFrame:
    """(doc, term, tf, dl): term counts of each document with its length in tokens."""
    t = docs.select(F.col(key).alias("doc"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    return t.select("doc", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def top_k(
    docs: DataFrame, queries: DataFrame, doc_key: str, doc_text: str, query_key: str, query_text: str, k: int = 5, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25,
    tokenize: Callable[[Column], Column] = bigrams,
) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query by Okapi BM25.

    Negative idf is replaced by epsilon times the mean idf of the whole vocabulary; query terms count
    as often as they occur.  Ranks are by score rounded to 6 digits, then by document; scores of zero
    or less are dropped after the cut.  Only postings of terms that some query has are joined, and
    the window keeps k rows per partition before it shuffles (WindowGroupLimit)."""
    post = cut(postings(docs, doc_key, doc_text, tokenize))  # tokenised once
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    stats = n_docs.crossJoin(post.agg(F.sum("tf").alias("tokens"))).select("n", (F.coalesce("tokens", F.lit(0)) / F.greatest("n", F.lit(1))).alias("avgdl"))  # one row
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(stats))
    idf = df.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.agg(F.avg("idf").alias("mean_idf"))  # one row
    q = queries.select(F.col(query_key).alias("query"), F.explode(tokenize(F.coalesce(F.col(query_text), F.lit("")))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    weights = q.join(idf, "term").crossJoin(F.broadcast(mean)).select("query", "term", "qtf", "avgdl", F.when(F.col("idf") < 0, F.col("mean_idf") * epsilon).otherwise(F.col("idf")).alias("w"))
    part = F.col("qtf") * F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = weights.join(post, "term").groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc")))
    return ranked.where(f"rank <= {k}").where("score > 0").select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


def sql(docs: str, queries: str, doc_key: str, doc_text: str, query_key: str, query_text: str, k: int = 5, where: str = "true") -> str:
    """The same as text for DuckDB; ends with a CTE named bm25 (query, doc, score, rank)."""
    tok = lambda c: f"list_filter(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)), lambda p: NOT contains(p, ' '))"
    clean = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^0-9a-z一-鿿]+', ' ', 'g')"
    return f"""
    d0 AS (SELECT {doc_key} AS doc, {clean(doc_text)} AS t FROM {docs}),
    d1 AS (SELECT doc, {tok('t')} AS tokens FROM d0),
    post AS (SELECT doc, term, len AS dl, count(*) AS tf FROM (SELECT doc, len(tokens) AS len, unnest(tokens) AS term FROM d1) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d1),
    idf0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM post, st GROUP BY term, n),
    mean AS (SELECT avg(idf) AS m FROM idf0),
    q0 AS (SELECT {query_key} AS query, {clean(query_text)} AS t FROM {queries} WHERE {where}),
    q1 AS (SELECT query, term, count(*) AS qtf FROM (SELECT query, unnest({tok('t')}) AS term FROM q0) GROUP BY ALL),
    sc AS (SELECT query, doc, round(sum(qtf * CASE WHEN idf < 0 THEN m * 0.25 ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
           FROM q1 JOIN idf0 USING (term) JOIN post USING (term), mean, st GROUP BY query, doc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM sc),
    bm25 AS (SELECT query, doc, score, rank FROM rk WHERE rank <= {k} AND score > 0)"""
