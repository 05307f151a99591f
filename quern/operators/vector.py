"""Exact nearest neighbours of a query set, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import bigrams

#: Vectors in a block of rows and in a block of queries.
ROW_BLOCK, QUERY_BLOCK = 4096, 512


def blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Vectors packed into rows of about ``size``: (ids, flat values, dimension).

    The number of blocks follows the number of rows; a block is of bounded size, so packing it into
    one row is safe.  Null vectors are left out."""
    n = max(1, -(-df.count() // size))
    clean = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    packed = clean.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return packed.select(F.transform("rows", lambda r: r["id"]).alias(f"{name}_ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias(f"{name}_flat"))


def top_k(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, metric: str = "cosine", skip_self: bool = True) -> DataFrame:
    """(query, doc, score, rank): the k vectors most like each query vector.

    Every block of queries meets every block of rows, and one matrix product ranks them; each
    meeting yields at most k rows a query, so what is shuffled is k rows per query and block.
    Scores are rounded to 6 digits; ties go to the smaller key.  A zero vector is like none."""
    met = blocks(rows, key, vector, ROW_BLOCK, "r").crossJoin(blocks(queries, key, vector, QUERY_BLOCK, "q"))
    schema = pa.schema([("query", pa.int64()), ("doc", pa.int64()), ("score", pa.float64())])

    def rank(batches):
        for b in batches:
            for i in range(b.num_rows):
                rid, qid = (np.array(b.column(c)[i].as_py(), dtype=np.int64) for c in ("r_ids", "q_ids"))
                x = b.column("r_flat")[i].values.to_numpy(zero_copy_only=False).reshape(len(rid), -1)
                y = b.column("q_flat")[i].values.to_numpy(zero_copy_only=False).reshape(len(qid), -1)
                if metric == "cosine":
                    x, y = (m / np.where((n := np.sqrt((m * m).sum(1))) > 0, n, np.inf)[:, None] for m in (x, y))
                s = np.round(y @ x.T, 6)
                for j in range(len(qid)):
                    order = np.lexsort((rid, -s[j]))
                    order = order[rid[order] != qid[j]][:k] if skip_self else order[:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), qid[j])), pa.array(rid[order]), pa.array(s[j][order])], schema=schema)

    near = met.mapInArrow(rank, "query long, doc long, score double")
    w = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    return near.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").select("query", "doc", (F.col("score") + 0.0).alias("score"), F.col("rank").cast("long").alias("rank"))


def hashed(docs: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """(id, bucket, x): unit vectors of texts by feature hashing, in sparse form: pairs of letters are counted
    in ``dims`` buckets.  An embedder without a model; null and empty texts have no vector."""
    t = docs.select(F.col(key).alias("id"), F.explode(bigrams(F.coalesce(F.col(text), F.lit("")))).alias("token"))
    b = t.select("id", (F.conv(F.left(F.md5("token"), F.lit(6)), 16, 10).cast("long") % dims).cast("int").alias("bucket")).groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    size = b.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    return b.join(size, "id").select("id", "bucket", (F.col("n") / F.col("size")).alias("x"))


def text_top_k(docs: DataFrame, queries: DataFrame, doc_key: str, doc_text: str, query_key: str, query_text: str, k: int = 5, dims: int = 256) -> DataFrame:
    """(query, doc, score, rank): the k texts nearest to each query by the cosine of their hashed vectors.

    Vectors meet in an equi-join on their buckets, summed before the window keeps k rows a query.
    Scores are rounded to 6 digits; ties go to the smaller document."""
    d = hashed(docs, doc_key, doc_text, dims).select(F.col("id").alias("doc"), "bucket", F.col("x").alias("dx"))
    q = hashed(queries, query_key, query_text, dims).select(F.col("id").alias("query"), "bucket", F.col("x").alias("qx"))
    scored = q.join(d, "bucket").groupBy("query", "doc").agg(F.round(F.sum(F.col("qx") * F.col("dx")), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "doc")))
    return ranked.where(f"rank <= {k}").select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


def text_sql(docs: str, queries: str, doc_key: str, doc_text: str, query_key: str, query_text: str, k: int, dims: int = 256, name: str = "near") -> str:
    """The same as text for DuckDB; ends with a CTE of the given name (query, doc, score, rank)."""
    tok = "list_filter(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), lambda p: NOT contains(p, ' '))"
    clean = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^0-9a-z一-鿿]+', ' ', 'g')"
    part = lambda at, key, text, of: (
        f"{name}{at}0 AS (SELECT id, (('0x' || left(md5(token), 6))::BIGINT % {dims})::INT AS bucket, count(*) AS n FROM (SELECT id, unnest({tok}) AS token FROM (SELECT {key} AS id, {clean(text)} AS t FROM {of})) GROUP BY ALL), "
        f"{name}{at} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id))::DOUBLE AS x FROM {name}{at}0)"
    )
    return (
        f"{part('d', doc_key, doc_text, docs)}, {part('q', query_key, query_text, queries)}, {name}s AS (SELECT q.id AS query, d.id AS doc, round(sum(q.x * d.x), 6) AS score FROM {name}q q JOIN {name}d d USING (bucket) GROUP BY ALL), "
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {name}s QUALIFY rank <= {k})"
    )
