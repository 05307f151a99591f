import json

import pytest
from pyspark.sql import functions as F

from quern.operators import bm25, dedup, fusion, graph, samples, vector, votes
from quern.plans import rag
from quern.sources import files

CLAUSES = [(1, "太阳之为病，脉浮，头项强痛而恶寒。"), (12, "太阳中风，发热恶寒，桂枝汤主之。"), (35, "太阳病，头痛发热，恶风无汗而喘者，麻黄汤主之。"), (40, None)]


def clauses(spark):
    return spark.createDataFrame(CLAUSES, "clause_id bigint, original_text string")


def test_bm25_finds_the_clause(spark):
    q = spark.createDataFrame([(1, "桂枝汤主治什么"), (2, "麻黄汤主治什么"), (3, ""), (4, None)], "id bigint, q string")
    best = {r["query"]: r["doc"] for r in bm25.top_k(clauses(spark), q, "clause_id", "original_text", "id", "q").where("rank = 1").collect()}
    assert best == {1: 12, 2: 35}


def test_bm25_empty(spark):
    q = spark.createDataFrame([], "id bigint, q string")
    assert bm25.top_k(clauses(spark), q, "clause_id", "original_text", "id", "q").count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id bigint, v array<float>")
    got = vector.top_k(v, v.where("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [2, 3]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query bigint, doc bigint, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query bigint, doc bigint, rank int")
    got = fusion.reciprocal_rank([a, b]).orderBy("rank").collect()
    assert [r["doc"] for r in got] == [11, 10, 12]
    assert got[0]["score"] == pytest.approx(1 / 61 + 1 / 62, abs=1e-6) and got[0]["distance"] == 0


def test_fill_keeps_the_first_stage(spark):
    a = spark.createDataFrame([(1, 10, 1)], "query bigint, doc bigint, rank int")
    b = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "query bigint, doc bigint, rank int")
    got = fusion.filled([a, b], 2).orderBy("rank").collect()
    assert [(r["doc"], r["stage"]) for r in got] == [(10, 0), (11, 1)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "y"), ("c", "y")], "src string, dst string")
    v, edges = graph.build([(e, "contains", "formula", "herb")])
    assert {(r["kind"], r["name"]): r["n"] for r in graph.stats(v, edges).collect()} == {("vertex", "formula"): 3, ("vertex", "herb"): 2, ("edge", "contains"): 5}
    want = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "z")], "query int, member string")
    assert {(r["query"], r["g"]) for r in graph.holding_all(edges, want, "src", "dst").collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")}
    assert [tuple(r) for r in graph.pairs_sharing(edges, "src", "dst").collect()] == [("x", "y", 2)]
    pair = spark.createDataFrame([("a", "c")], "a string, b string")
    assert tuple(graph.compare(edges, pair, "src", "dst").first()) == ("a", "c", "y", "x", "")


def test_votes(spark):
    t = spark.createDataFrame([(0, "s1", "A"), (1, "s1", "B"), (2, "s2", "A"), (3, "soft", "C"), (4, "soft2", "C")], "ord int, symptom string, label string")
    c = spark.createDataFrame([(1, "s1"), (1, "s2"), (2, "s1"), (3, "none"), (4, "soft"), (4, "soft2")], "case int, symptom string")
    got = {r["case"]: (r["status"], r["label"], r["tied"]) for r in votes.vote(c, t, ("soft", "soft2")).collect()}
    assert got == {1: ("diagnosed", "A", ""), 2: ("need_clarification", None, "A,B"), 3: ("rejected", None, ""), 4: ("need_clarification", None, "C")}


def test_first_by_prefix_and_split(spark):
    df = spark.createDataFrame([(3, "aaa1"), (1, "aaa2"), (2, "b"), (4, None), (5, None)], "id bigint, t string")
    assert sorted(r["id"] for r in dedup.first_by_prefix(df, "t", "id", 3).collect()) == [1, 2, 4]
    n = dedup.exact_split(spark.range(1000), "id", 0.1).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in n} == {"val": 100, "train": 900}


def test_labels(spark):
    r = spark.createDataFrame([([1, 2, 3, 4, 5], 2)], "ids array<int>, p int").select(samples.masked_labels(F.col("ids"), F.col("p"), 4).alias("l")).first()
    assert r["l"] == [-100, -100, 3, 4]


def test_pipeline_stops_and_routes(spark):
    q = spark.createDataFrame([(1, "第12条原文是什么？"), (2, "桂枝吃多少克？"), (3, "麻黄汤的组成是什么？"), (4, " "), (5, "insulin是什么")], "id bigint, question string")
    got = {r["query"]: r for r in rag.answer_contexts(q, clauses(spark)).collect()}
    assert [got[i]["status"] for i in range(1, 6)] == ["ok", "dose", "ok", "invalid", "out_of_scope"]
    assert got[1]["route"] == "clause" and got[1]["docs"].split(",")[0] == "12"
    assert got[3]["route"] == "formula" and got[3]["docs"].split(",")[0] == "35"
    assert got[2]["prompt"] is None and got[2]["docs"] == ""


def test_files(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text("\n".join([json.dumps({"clause_id": 1, "original_text": "甲"}, ensure_ascii=False), "", "{broken", json.dumps({"clause_id": 2})]))
    df = files.read_jsonl(spark, str(p), files.CLAUSES).where("clause_id is not null")
    assert [r["clause_id"] for r in df.orderBy("clause_id").collect()] == [1, 2]
    out = str(tmp_path / "out")
    files.write_jsonl(df, out)
    files.write_jsonl(df, out, "append")
    assert files.read_jsonl(spark, out, files.CLAUSES).count() == 4
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"nodes": [{"id": "a", "type": "x"}], "links": [{"source": "a", "target": "a", "relation": "r"}]}, indent=1))
    v, e = files.read_graph(spark, str(g))
    assert v.count() == 1 and e.first()["relation"] == "r"


def test_vector_store_replaces(spark, tmp_path):
    path = str(tmp_path / "store")
    embed = lambda ts: [[float(len(t or "")), 1.0] for t in ts]
    for _ in range(2):
        assert files.build_vector_store(clauses(spark), path, "clause_", "clause_id", "original_text", ["clause_id"], embed) == 4
    with pytest.raises(ValueError):
        files.build_vector_store(clauses(spark).limit(0), path, "c_", "clause_id", "original_text", [], embed)


def test_documents(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    got = files.read_documents(spark, str(tmp_path), lambda b: b.decode().split("\f")).collect()
    assert [(r["pdf_name"], r["number"], r["text"]) for r in got] == [("a.pdf", 1, "one"), ("a.pdf", 2, "two")]
    with pytest.raises(FileNotFoundError):
        files.read_documents(spark, str(tmp_path), bytes.split, "*.none")


def test_closure_of_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)]
    got = {(r["src"], r["dst"]): r["hops"] for r in graph.closure(spark.createDataFrame(chain, "src bigint, dst bigint")).collect()}
    assert all(got[i, j] == j - i for i in range(20) for j in range(i + 1, 21)) and got[100, 100] == 3 and got[101, 100] == 2 and got[7, 7] == 1
    assert {r["hops"] for r in graph.closure(spark.createDataFrame(chain, "src bigint, dst bigint"), 2).collect()} == {1, 2}


def test_pairs_of_a_hub_in_parts(spark, monkeypatch):
    monkeypatch.setattr(graph, "PART", 3)
    rows = [(g, m) for g in ("x", "y") for m in range(12)] + [("z", 99), ("z", 1)]
    got = {(r["a"], r["b"], r["n"]) for r in graph.pairs_sharing(spark.createDataFrame(rows, "g string, m bigint"), "g", "m").collect()}
    assert got == {(a, b, 2) for a in range(12) for b in range(a + 1, 12)}
