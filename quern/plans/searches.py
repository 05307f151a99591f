"""Catalog: ranking, fusing, looking up and walking the graph."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicon as X
from ..operators import bm25, fusion, graph, vector, votes
from . import lexicons as L
from . import rag
from .common import lit, table, words

_EVAL = "eval_rigor_results_v1_pre_guard"
_NAME = "[一-鿿]{2}[汤散丸饮煎]"
LEXICONS = rag.LEXICONS


def _bm25(s, d, k=5):
    return bm25.top_k(table(s, d, "clauses"), table(s, d, _EVAL).where("id % 100 = 0"), "clause_id", "original_text", "id", "question", k)


def _near(s, d, k=5, metric="cosine"):
    e = table(s, d, "embeddings")
    return vector.top_k(e, e.where("vec_id % 100 = 0"), "vec_id", "embedding", k, metric)


def _named(s, d):
    """Clauses that hold a formula named in the question, ranked by their id."""
    q = table(s, d, _EVAL).where("id % 100 = 0").select(F.col("id").alias("query"), F.explode(F.array_distinct(F.regexp_extract_all("question", F.lit(_NAME), F.lit(0)))).alias("name"))
    c = table(s, d, "clauses").select(F.col("clause_id").alias("doc"), F.explode(F.array_distinct(F.regexp_extract_all("original_text", F.lit(_NAME), F.lit(0)))).alias("name"))
    hit = q.join(c, "name").select("query", "doc").distinct()
    return hit.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("doc")))


def _edges(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    return li


def _property_graph(s, d):
    o = table(s, d, "orders")
    name = lambda c, k: F.concat(F.lit(k), F.col(c).cast("string"))
    return graph.build([
        (_edges(s, d).select(name("o", "order ").alias("src"), name("p", "part ").alias("dst")), "contains", "order", "part"),
        (o.select(name("o_orderkey", "order ").alias("src"), F.col("o_orderpriority").alias("dst")), "treats", "order", "priority"),
        (o.select(name("o_orderkey", "order ").alias("src"), name("o_custkey", "customer ").alias("dst")), "appears_in", "order", "customer"),
    ])


def _order_pairs(s, d):
    o = table(s, d, "orders").where("o_orderkey % 100 = 0").select(F.col("o_orderkey").alias("a"))
    return o.withColumn("b", F.col("a") + 1)


def _wanted(s, d):
    """For every hundredth order, its two least parts as a set that other orders must hold."""
    e = _edges(s, d).where("o % 100 = 0")
    two = e.withColumn("rn", F.row_number().over(W.partitionBy("o").orderBy("p"))).where("rn <= 2")
    return two.select(F.col("o").alias("query"), F.col("p").alias("member"))


def _cases(s, d):
    return table(s, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("case"), F.col("event_type").alias("symptom"))


def _votes(s, d):
    return votes.vote(_cases(s, d), X.lexicon(s, L.VOTES, "symptom string, label string"), ("error",))


def _retrieved(s, d):
    c = table(s, d, "clauses")
    q = rag.understood(table(s, d, _EVAL).where("id % 100 = 0"), LEXICONS)
    return rag.retrieved(q, c, rag.formulas_of(c, L.HERBS, L.MERIDIANS), LEXICONS)


def _answers(s, d):
    lectures = table(s, d, "chapters").select(F.col("chapter_id").alias("id"), F.col("pdf_name").alias("book"), F.col("content").alias("text"))
    return rag.answer_contexts(table(s, d, _EVAL).where("id % 100 = 0"), table(s, d, "clauses"), lectures, LEXICONS)


def queries() -> dict:
    t = table
    return {
        "bm25_topk": _bm25,
        "vector_topk_cosine": _near,
        "vector_topk_dot": lambda s, d: _near(s, d, 5, "dot"),
        "rrf_fusion": lambda s, d: fusion.reciprocal_rank([_near(s, d, 10), _near(s, d, 10, "dot")], 60, 5).select("query", "doc", "score", "rank"),
        "prioritized_fill": lambda s, d: fusion.filled([_named(s, d), _bm25(s, d, 10)], 5),
        "hybrid_search": lambda s, d: fusion.reciprocal_rank([_bm25(s, d, 10), _named(s, d)], 60, 5).select("query", "doc", "score", "distance", "rank"),
        "rag_pipeline": _answers,
        "hybrid_retrieval": _retrieved,
        "side_channel": lambda s, d: rag.side_channel(rag.understood(t(s, d, _EVAL), LEXICONS), rag.formulas_of(t(s, d, "clauses"), L.HERBS, L.MERIDIANS), LEXICONS),
        "question_kinds": lambda s, d: rag.understood(t(s, d, _EVAL), LEXICONS).select("query", "status", "kind", "concept", F.array_join("entities", ",").alias("entities"), F.array_join("symptoms", ",").alias("symptoms"), "core", "longer"),
        "question_votes": lambda s, d: rag.diagnosed(rag.understood(t(s, d, _EVAL), LEXICONS), LEXICONS).select("query", "verdict", "label", "tied", F.array_join("evidence", ",").alias("evidence")),
        "text_vectors": lambda s, d: vector.text_top_k(t(s, d, "clauses"), t(s, d, _EVAL).where("id % 100 = 0"), "clause_id", "original_text", "id", "question", 5),
        "pk_lookup": lambda s, d: t(s, d, _EVAL).select("id", F.posexplode("retrieved_ids").alias("pos", "clause_id")).join(t(s, d, "clauses").select("clause_id", "chapter", "original_text"), "clause_id"),
        "clause_formula_join": lambda s, d: t(s, d, "clauses").select("clause_id", F.explode(F.array_distinct(F.regexp_extract_all("original_text", F.lit(_NAME), F.lit(0)))).alias("name")).join(t(s, d, "chapters").select("chapter_id", F.regexp_extract("title", r"^\d+ (.+)$", 1).alias("name")).where("name != ''"), "name"),
        "inverted_index": lambda s, d: graph.neighbours(_edges(s, d), "p", "o").select(F.col("key").alias("part"), "n", F.col("list").alias("orders")),
        "graph_neighbors": lambda s, d: graph.neighbours(_edges(s, d), "o", "p").select(F.col("key").alias("order_key"), "n", F.col("list").alias("parts")),
        "graph_stats": lambda s, d: graph.stats(*_property_graph(s, d)),
        "graph_compare": lambda s, d: graph.compare(_edges(s, d), _order_pairs(s, d), "o", "p"),
        "graph_k_intersection": lambda s, d: graph.holding_all(_edges(s, d), _wanted(s, d), "o", "p").select(F.col("query").alias("of_order"), F.col("g").alias("order_key")),
        "graph_two_hop": lambda s, d: graph.two_hop(_edges(s, d).select(F.col("p").alias("src"), F.col("o").alias("mid")), t(s, d, "orders").select(F.col("o_orderkey").alias("mid"), F.col("o_custkey").alias("dst"))).select(F.col("src").alias("part"), F.col("mids").alias("orders"), F.col("ends").alias("customers")),
        "graph_fuzzy_two_hop": lambda s, d: graph.two_hop(t(s, d, "orders").where(F.contains("o_orderpriority", F.lit("H"))).select(F.col("o_orderpriority").alias("src"), F.col("o_orderkey").alias("mid")), _edges(s, d).select(F.col("o").alias("mid"), F.col("p").alias("dst"))).select(F.col("src").alias("priority"), F.col("mids").alias("orders"), F.col("ends").alias("parts")),
        "herb_pairs": lambda s, d: graph.pairs_sharing(_edges(s, d), "o", "p", 2),
        "vote_diagnosis": _votes,
        "clarify_pick": lambda s, d: votes.question_for(_votes(s, d), s.createDataFrame(list(L.QUESTIONS), "ord int, question string, label string")),
    }


_E = "e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"


def _vec(k: int, metric: str, name: str) -> str:
    dot = "list_inner_product(a.v, b.v)"
    score = f"{dot} / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))" if metric == "cosine" else dot
    return f"{name}0 AS (SELECT a.vec_id AS query, b.vec_id AS doc, round({score}, 6) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id), {name} AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM {name}0 QUALIFY rank <= {k})"


def _votes_sql(again: str | None = None) -> str:
    """Votes over the cases as CTEs, the last one vt; with a CTE ``again`` of further (case, symptom) rows, once
    more over all of them, the last one vt2."""
    table_ = ", ".join(f"({i}, {lit(a)}, {lit(b)})" for i, (a, b) in enumerate(L.VOTES))

    votes = votes_ctes
    first = f"""WITH c AS (SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS "case", event_type AS symptom FROM events), tb(ord, symptom, label) AS (VALUES {table_}),
    {votes("")}"""
    return first + (f""", {again}, c2 AS (SELECT "case", symptom FROM c UNION SELECT "case", symptom FROM again), {votes("2")}""" if again else "")


def votes_ctes(n: str, soft: tuple[str, ...] = ("error",)) -> str:
    """Votes over cases c{n} ("case", symptom) and the table tb (ord, symptom, label), as CTEs ending with vt{n}."""
    return f"""sc{n} AS (SELECT "case", label, count(*) AS n, min(ord) AS ord, bool_and(list_contains({words(soft)}, symptom)) AS soft FROM c{n} JOIN tb USING (symptom) GROUP BY ALL),
    rk{n} AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(n) OVER w, 0) AS second, max(n) OVER (PARTITION BY "case") AS best FROM sc{n} WINDOW w AS (PARTITION BY "case" ORDER BY n DESC, ord)),
    td{n} AS (SELECT "case", string_agg(label, ',' ORDER BY ord) AS tied FROM rk{n} WHERE n = best GROUP BY 1),
    led{n} AS (SELECT "case", n >= 2 AND n - second >= 1 AND NOT soft AS clear, label, n, second, tied FROM rk{n} JOIN td{n} USING ("case") WHERE rn = 1),
    vt{n} AS (SELECT "case", CASE WHEN clear THEN 'diagnosed' ELSE 'need_clarification' END AS status, CASE WHEN clear THEN label END AS label, n AS top, second, CASE WHEN clear THEN '' ELSE tied END AS tied FROM led{n}
    UNION ALL SELECT DISTINCT "case", 'rejected', NULL, 0, 0, '' FROM c{n} WHERE "case" NOT IN (SELECT "case" FROM led{n}))"""


def oracle_sql() -> dict[str, str]:
    b = lambda k: bm25.sql("clauses", _EVAL, "clause_id", "original_text", "id", "question", k, "id % 100 = 0")
    v = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"
    name = f"regexp_extract_all(%s, {lit(_NAME)})"
    named = f"nm AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc) AS rank FROM (SELECT DISTINCT query, doc FROM (SELECT id AS query, unnest({name % 'question'}) AS name FROM {_EVAL} WHERE id % 100 = 0) JOIN (SELECT clause_id AS doc, unnest({name % 'original_text'}) AS name FROM clauses) USING (name)))"
    fuse = lambda x, y, k: f"al AS (SELECT query, doc, rank, 0 AS l FROM {x} UNION ALL SELECT query, doc, rank, 1 FROM {y}), fu AS (SELECT query, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS sc, min(l * 1000000 + rank) AS f FROM al GROUP BY ALL), rr AS (SELECT query, doc, round(sc, 6) AS score, round(1 - sc / max(sc) OVER (PARTITION BY query), 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY sc DESC, f, doc) AS rank FROM fu QUALIFY rank <= {k})"
    text = "array_to_string(list_sort(%s), ',')"
    q = ", ".join(f"({i}, {lit(x)}, {lit(y)})" for i, x, y in L.QUESTIONS)
    return {
        "bm25_topk": f"WITH {b(5)} SELECT query, doc, score, rank FROM bm25",
        "vector_topk_cosine": f"WITH {v}, {_vec(5, 'cosine', 'x')} SELECT query, doc, score, rank FROM x",
        "vector_topk_dot": f"WITH {v}, {_vec(5, 'dot', 'x')} SELECT query, doc, score, rank FROM x",
        "rrf_fusion": f"WITH {v}, {_vec(10, 'cosine', 'x')}, {_vec(10, 'dot', 'y')}, {fuse('x', 'y', 5)} SELECT query, doc, score, rank FROM rr",
        "prioritized_fill": f"WITH {b(10)}, {named}, al AS (SELECT query, doc, 0 AS stage, rank FROM nm UNION ALL SELECT query, doc, 1, rank FROM bm25), f AS (SELECT query, doc, min(stage * 1000000 + rank) AS pos FROM al GROUP BY ALL) SELECT query, doc, (pos // 1000000)::INT AS stage, row_number() OVER (PARTITION BY query ORDER BY pos, doc) AS rank FROM f QUALIFY rank <= 5",
        "hybrid_search": f"WITH {b(10)}, {named}, {fuse('bm25', 'nm', 5)} SELECT query, doc, score, distance, rank FROM rr",
        "pk_lookup": f"SELECT r.id, r.pos::INT AS pos, c.clause_id, c.chapter, c.original_text FROM (SELECT id, unnest(retrieved_ids) AS clause_id, generate_subscripts(retrieved_ids, 1) - 1 AS pos FROM {_EVAL}) r JOIN clauses c USING (clause_id)",
        "clause_formula_join": f"SELECT a.name, clause_id, chapter_id FROM (SELECT DISTINCT clause_id, unnest({name % 'original_text'}) AS name FROM clauses) a JOIN (SELECT chapter_id, regexp_extract(title, '^\\d+ (.+)$', 1) AS name FROM chapters WHERE title IS NOT NULL) b ON a.name = b.name AND b.name <> ''",
        "inverted_index": f"WITH {_E} SELECT p AS part, count(*) AS n, {text % 'list(o)'} AS orders FROM e GROUP BY 1",
        "graph_neighbors": f"WITH {_E} SELECT o AS order_key, count(*) AS n, {text % 'list(p)'} AS parts FROM e GROUP BY 1",
        "graph_stats": f"WITH {_E} SELECT 'edge' AS kind, 'contains' AS name, (SELECT count(*) FROM e) AS n UNION ALL SELECT 'edge', 'treats', count(*) FROM orders UNION ALL SELECT 'edge', 'appears_in', count(*) FROM orders UNION ALL SELECT 'vertex', 'order', (SELECT count(*) FROM (SELECT o FROM e UNION SELECT o_orderkey FROM orders)) UNION ALL SELECT 'vertex', 'part', (SELECT count(DISTINCT p) FROM e) UNION ALL SELECT 'vertex', 'priority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'vertex', 'customer', count(DISTINCT o_custkey) FROM orders",
        "graph_compare": f"WITH {_E}, s AS (SELECT o, list(p) AS s FROM e GROUP BY 1) SELECT x.o AS a, y.o AS b, {text % 'list_filter(x.s, lambda i: list_contains(y.s, i))'} AS common, {text % 'list_filter(x.s, lambda i: NOT list_contains(y.s, i))'} AS only_a, {text % 'list_filter(y.s, lambda i: NOT list_contains(x.s, i))'} AS only_b FROM orders JOIN s x ON x.o = o_orderkey JOIN s y ON y.o = o_orderkey + 1 WHERE o_orderkey % 100 = 0",
        "graph_k_intersection": f"WITH {_E}, w AS (SELECT o AS query, p FROM e WHERE o % 100 = 0 QUALIFY row_number() OVER (PARTITION BY o ORDER BY p) <= 2), k AS (SELECT query, count(*) AS k FROM w GROUP BY 1) SELECT query AS of_order, o AS order_key FROM w JOIN e USING (p) JOIN k USING (query) GROUP BY query, o, k HAVING count(*) = k",
        "graph_two_hop": f"WITH {_E} SELECT p AS part, count(DISTINCT o) AS orders, count(DISTINCT o_custkey) AS customers FROM e LEFT JOIN orders ON o_orderkey = o GROUP BY 1",
        "graph_fuzzy_two_hop": f"WITH {_E} SELECT o_orderpriority AS priority, count(DISTINCT o_orderkey) AS orders, count(DISTINCT p) AS parts FROM orders LEFT JOIN e ON o = o_orderkey WHERE contains(o_orderpriority, 'H') GROUP BY 1",
        "herb_pairs": f"WITH {_E} SELECT x.p AS a, y.p AS b, count(*) AS n FROM e x JOIN e y ON x.o = y.o AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2",
        "vote_diagnosis": _votes_sql() + ' SELECT "case", status, label, top, second, tied FROM vt',
        "clarify_pick": _votes_sql() + f", qs(ord, question, label) AS (VALUES {q}), u AS (SELECT \"case\", unnest(string_split(tied, ',')) AS label FROM vt WHERE status = 'need_clarification') SELECT \"case\", arg_min(question, ord) AS question FROM u JOIN qs USING (label) GROUP BY 1",
    }
