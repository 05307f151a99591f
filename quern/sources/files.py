"""Reading and writing the engine's files: JSON lines, HTML folders, tables, reports and graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_text
from ..operators.vector import text_top_k

# Schemas of the record kinds; every one may be read from and written to JSON lines or parquet.
CLAUSES = "clause_id bigint, clause_id_cn string, chapter string, original_text string"
SAMPLES = "instruction string, input string, output string, category string, book string, source string, quality string"
QUESTIONS = "id bigint, category string, question string, expected_answer string, reference_clauses array<bigint>"
ANSWERS = "id bigint, category string, focus string, question string, route_type string, retrieved_ids array<bigint>, retrieved_texts array<string>, answer string, latency double, wall double, error string"
PAGES = "pdf_name string, number int, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with a given schema; blank lines are skipped, lines that are no JSON are rows of nulls
    only where they cannot be told from data, so they are dropped."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    return raw.select(F.from_json("value", schema).alias("r")).where("r is not null").select("r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", count_by: str | None = None) -> DataFrame | None:
    """One JSON object per row, UTF-8, null fields left out; mode append adds files.

    With ``count_by`` the rows of each value of that column, as they are in the files, come back."""
    df.write.mode(mode).json(path)
    return df.sparkSession.read.schema(df.schema).json(path).groupBy(count_by).agg(F.count(F.lit(1)).alias("n")) if count_by else None


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole JSON document per file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


_NODES, _LINKS = "array<struct<id:string,type:string>>", "array<struct<source:string,target:string,relation:string,change:string>>"
#: Edges that a graph written as one JSON document may have.
MOST_JSON_EDGES = 1_000_000


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a node-link JSON document, or of the two tables that write_graph left."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/edges")
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
    doc = read_json(spark, path, f"nodes {_NODES}, links {_LINKS}")
    v = doc.select(F.explode("nodes").alias("n")).select("n.*")
    return v, doc.select(F.explode("links").alias("l")).select(F.col("l.source").alias("src"), F.col("l.target").alias("dst"), "l.relation", "l.change")


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices and edges as two tables below the path; they stay distributed."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_graph_json(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """The same as one node-link JSON document, for graphs of at most MOST_JSON_EDGES edges; others raise."""
    if edges.limit(MOST_JSON_EDGES + 1).count() > MOST_JSON_EDGES or vertices.limit(2 * MOST_JSON_EDGES + 1).count() > 2 * MOST_JSON_EDGES:
        raise ValueError("too many edges or vertices for one document; use write_graph")
    change = F.col("change") if "change" in edges.columns else F.lit(None).cast("string")
    nodes = vertices.agg(F.sort_array(F.collect_list(F.struct("id", "type"))).alias("nodes"))
    links = edges.agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "relation", change.alias("change")))).alias("links"))
    nodes.join(links, F.lit(True)).write.mode("overwrite").json(path)


def read_html(spark: SparkSession, path: str, drop: Iterable[str] = ("nav", "menu", "login", "copyright")) -> DataFrame:
    """(path, text) of the HTML files in a folder."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    return raw.select("path", html_text(F.col("value"), tuple(drop)).alias("text"))


def read_documents(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """(pdf_name, number, text): pages of binary documents through an extractor given by the caller.

    The extractor turns a file's bytes into page texts; pages are numbered from 1.  No file is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {path}")
    def pages(batches):
        for b in batches:
            rows = [(p.rsplit("/", 1)[-1], n, t) for p, c in zip(b["path"], b["content"]) for n, t in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["pdf_name", "number", "text"])

    return files.select("path", "content").mapInPandas(pages, PAGES)


def sampled_pages(pages: DataFrame, numbers: Iterable[int] = (15, 50, 100, 150, 200)) -> DataFrame:
    return pages.where(F.col("number").isin(*numbers))


def joined_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """(pdf_name, text): the pages of a file in order, parted by blank lines, empty ones left out.

    One row holds a whole file, so use it for files, not for collections without end."""
    full = pages.where(F.trim(text) != "").groupBy("pdf_name").agg(F.sort_array(F.collect_list(F.struct("number", text))).alias("p"))
    return full.select("pdf_name", F.array_join(F.transform("p", lambda x: x[text]), "\n\n").alias("text"))


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """df with a column ``embedding``: vectors of unit length from the caller's embedder, called with lists of at
    most ``batch`` texts, none of them null."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(s: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(s), batch):
            for v in embed(s.iloc[i : i + batch].fillna("").tolist()):
                n = sum(float(x) * float(x) for x in v) ** 0.5
                out.append([float(x) / n if n else 0.0 for x in v])
        return pd.Series(out)

    return df.withColumn("embedding", vectors(text))


def build_vector_store(df: DataFrame, path: str, id_prefix: str, key: str, text: str, metadata: list[str], embed: Callable[[list[str]], list[list[float]]], batch: int = 32) -> int:
    """Write (id, text, metadata, embedding), replacing what was there; the number of rows.

    An empty table is an error."""
    rows = df.select(F.concat(F.lit(id_prefix), F.col(key).cast("string")).alias("id"), F.col(text).alias("text"), F.create_map(*[x for m in metadata for x in (F.lit(m), F.col(m).cast("string"))]).alias("metadata"))
    if rows.isEmpty():
        raise ValueError("nothing to index")
    embedded(rows, "text", embed, batch).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def build_lecture_store(df: DataFrame, path: str, key: str, embed: Callable[[list[str]], list[list[float]]], text: str = "output", batch: int = 32) -> int:
    """The store of lectures (instruction, book, source, text): ids are lect_ and the key, the topic is the first 40
    characters of the instruction, and a missing source is "lecture"."""
    rows = df.select(F.col(key), F.col(text).alias("text"), F.coalesce("book", F.lit("")).alias("book"), F.left(F.coalesce("instruction", F.lit("")), F.lit(40)).alias("topic"), F.coalesce("source", F.lit("lecture")).alias("source"))
    return build_vector_store(rows, path, "lect_", key, "text", ["book", "topic", "source"], embed, batch)


def probed(spark: SparkSession, path: str, chars: int = 12, k: int = 5) -> str:
    """Check a store by itself: its first text's first characters must find that text among the k nearest;
    the id is returned, a miss raises."""
    store = spark.read.parquet(path).where(F.length("text") > 0)
    first = store.orderBy("id").select("id", F.left("text", F.lit(chars)).alias("search")).limit(1)
    hits = text_top_k(store, first, "id", "text", "id", "search", k)
    want = first.first()
    if want is None or want["id"] not in {r["doc"] for r in hits.select("doc").collect()}:
        raise RuntimeError(f"the store {path} does not find its own first text")
    return want["id"]


def report_json(df: DataFrame) -> DataFrame:
    """Rows as JSON strings, for small reports."""
    return df.select(F.to_json(F.struct("*")).alias("report"))
